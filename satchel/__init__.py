"""Schemaless items in DataFrames: predicate queries, hierarchies, versions and conversions."""

from satchel.operators.predicates import (
    UnknownPropertyError,
    all_,
    all_of,
    and_,
    any_,
    any_of,
    eq,
    ge,
    gt,
    id_,
    is_null,
    kind,
    le,
    lt,
    ne,
    none,
    not_null,
    or_,
    xor,
)
from satchel.operators.query import Direction, PreparedQuery, Query

__all__ = [
    "Direction",
    "PreparedQuery",
    "Query",
    "UnknownPropertyError",
    "all_",
    "all_of",
    "and_",
    "any_",
    "any_of",
    "eq",
    "ge",
    "gt",
    "id_",
    "is_null",
    "kind",
    "le",
    "lt",
    "ne",
    "none",
    "not_null",
    "or_",
    "xor",
]
