"""Expressions: conditions, aggregates, the packed tuple format."""
