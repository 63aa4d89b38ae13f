"""Operators for large text corpora: one module per operator, thin queries in ``queries``."""
