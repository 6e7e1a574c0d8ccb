"""Operators for large training-data corpora: ten document operators and their queries."""
