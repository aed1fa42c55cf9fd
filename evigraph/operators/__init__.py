"""Operators over graph tables."""
