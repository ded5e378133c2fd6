"""Operators for building training corpora: one module per operator, and queries.py for their queries."""
