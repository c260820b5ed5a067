"""Operators for large training corpora: one module per operator, all usable on any DataFrame."""
