"""Lazy relations and the choice of access path."""
