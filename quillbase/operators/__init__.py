"""Relational operators; each takes and gives lazy relations."""

from quillbase.operators.aggregate import aggregate
from quillbase.operators.basic import filter_, project
from quillbase.operators.joins import bnl_join, gh_join, inl_join

__all__ = ["aggregate", "bnl_join", "filter_", "gh_join", "inl_join", "project"]
