"""Column functions: text measures, edit distance, statistics."""
