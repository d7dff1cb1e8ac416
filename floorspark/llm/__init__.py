"""Operators for preparing training text: dedup, filtering, counting, mixing."""
