"""A relational engine on PySpark: catalog, versioned tables with lasting row identifiers, indexes, lazy operators."""

from quillbase.errors import EngineError
from quillbase.operators import aggregate, bnl_join, filter_, gh_join, inl_join, project
from quillbase.plans.relation import Relation
from quillbase.session import Engine
from quillbase.types import AggregateOp, Attribute, AttrType, CompOp, Condition, Value

__all__ = ["AggregateOp", "AttrType", "Attribute", "CompOp", "Condition", "Engine", "EngineError", "Relation", "Value", "aggregate", "bnl_join", "filter_", "gh_join", "inl_join", "project"]
