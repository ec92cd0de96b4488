"""Operators over the document tables."""
