"""Operators for preparing training text; nothing outside of this package imports it."""
