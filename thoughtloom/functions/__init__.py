"""Column expressions: text rules, scores, labels and rounding."""
