"""Relational operators: generate, join, rank, aggregate."""
