"""Operators for preparing training text, independent of the rest of the library."""
