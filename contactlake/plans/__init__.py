"""Whole jobs and reports, composed of the operators."""
