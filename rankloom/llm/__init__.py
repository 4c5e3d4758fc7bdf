"""Operators on texts: leakage of held-out material, mixing to target weights, spam pages."""
