"""Column-level building blocks: cleaners, score, similarity."""
