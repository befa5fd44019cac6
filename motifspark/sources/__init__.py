"""Readers of text and pattern files."""
