"""Column functions: text, scores and stemming."""
