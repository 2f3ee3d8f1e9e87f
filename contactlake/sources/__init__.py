"""Readers of the feeds and writers of the tables."""
