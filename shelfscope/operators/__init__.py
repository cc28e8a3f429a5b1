"""Operators that are more than one expression."""
