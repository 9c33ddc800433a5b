"""Scalar functions: text, numbers, fuzzy ratios."""
