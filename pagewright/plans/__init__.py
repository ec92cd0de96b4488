"""Staged batch runs."""
