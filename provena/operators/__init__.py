"""Relational operators over evidence."""
