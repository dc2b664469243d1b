"""Operators for building training text; nothing outside this package imports it."""
