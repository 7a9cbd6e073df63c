"""Operators that prepare training text: one module each, registered by queries.py."""
