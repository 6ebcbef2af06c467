"""Filter trees over items, and their translation to Column expressions.

A property is a column; a multi-valued property is an array column, and a comparison holds for it if
some element satisfies it.  Filters are row-wise, so no item is ever returned twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

ID, KIND = "__ID__", "__KIND__"


class UnknownPropertyError(ValueError):
    """No item ever had the property."""


class Op(Enum):
    EQUAL = "="
    NOT_EQUAL = "!="
    GREATER = ">"
    GREATER_OR_EQUAL = ">="
    LESS = "<"
    LESS_OR_EQUAL = "<="
    IS_NULL = "is null"
    NOT_NULL = "is not null"
    NONE = "none"
    AND = "and"
    OR = "or"


class Quantifier(Enum):
    SOME = "any"
    ALL = "all"


_COMPARE = {Op.EQUAL, Op.NOT_EQUAL, Op.GREATER, Op.GREATER_OR_EQUAL, Op.LESS, Op.LESS_OR_EQUAL, Op.NONE}
_NULLS = {Op.IS_NULL, Op.NOT_NULL}


@dataclass(frozen=True)
class Values:
    quantifier: Quantifier
    values: tuple[Any, ...]

    def __str__(self) -> str:
        return f"{self.quantifier.value}({', '.join(map(repr, self.values))})"


def any_of(*values: Any) -> Values:
    return Values(Quantifier.SOME, values)


def all_of(*values: Any) -> Values:
    return Values(Quantifier.ALL, values)


@dataclass(frozen=True)
class Predicate:
    op: Op
    property: str | None = None
    values: Values | None = None
    clauses: tuple[Predicate, ...] = ()

    def __post_init__(self):
        if self.op in (Op.AND, Op.OR):
            if not self.clauses:
                raise ValueError(f"{self.op.value} needs a clause")
            if self.property is not None or self.values is not None:
                raise ValueError(f"{self.op.value} takes clauses only")
            if not all(isinstance(c, Predicate) for c in self.clauses):
                raise ValueError("clauses must be predicates")
            return
        if not self.property:
            raise ValueError("a property is needed")
        if self.op in _NULLS and self.values is not None:
            raise ValueError(f"{self.op.value} takes no value")
        if self.op in _COMPARE and self.values is None:
            raise ValueError(f"{self.op.value} needs values")
        if self.clauses:
            raise ValueError(f"{self.op.value} takes no clauses")

    def __str__(self) -> str:
        if self.clauses:
            return "(" + f" {self.op.value} ".join(map(str, self.clauses)) + ")"
        if self.op in _NULLS:
            return f"{self.property} {self.op.value}"
        one = len(self.values.values) == 1
        return f"{self.property} {self.op.value} {self.values.values[0]!r}" if one else f"{self.property} {self.op.value} {self.values}"

    def __and__(self, other: Predicate) -> Predicate:
        return and_(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return or_(self, other)

    def conjuncts(self) -> tuple[Predicate, ...]:
        """The clauses of a top-level AND, else this alone."""
        return self.clauses if self.op is Op.AND else (self,)


def _compare(op: Op, name: str, value: Any) -> Predicate:
    if value is None:
        raise ValueError("use is_null or not_null for null")
    return Predicate(op, name, value if isinstance(value, Values) else any_of(value))


def eq(name: str, value: Any) -> Predicate:
    return _compare(Op.EQUAL, name, value)


def ne(name: str, value: Any) -> Predicate:
    """The property is present and some value of it differs."""
    return _compare(Op.NOT_EQUAL, name, value)


def gt(name: str, value: Any) -> Predicate:
    return _compare(Op.GREATER, name, value)


def ge(name: str, value: Any) -> Predicate:
    return _compare(Op.GREATER_OR_EQUAL, name, value)


def lt(name: str, value: Any) -> Predicate:
    return _compare(Op.LESS, name, value)


def le(name: str, value: Any) -> Predicate:
    return _compare(Op.LESS_OR_EQUAL, name, value)


def any_(name: str, *values: Any) -> Predicate:
    """Some value of the property is among ``values``; no values match nothing."""
    return Predicate(Op.EQUAL, name, any_of(*values))


def all_(name: str, *values: Any) -> Predicate:
    """The property has every one of ``values``; no values match nothing."""
    return Predicate(Op.EQUAL, name, all_of(*values))


def xor(name: str, *values: Any) -> Predicate:
    """Some listed value for which ``ne`` holds; the name is historical, it is no exclusive or."""
    return Predicate(Op.NOT_EQUAL, name, any_of(*values))


def none(name: str, *values: Any) -> Predicate:
    """The property is present and has none of ``values`` (an extension)."""
    return Predicate(Op.NONE, name, all_of(*values))


def is_null(name: str) -> Predicate:
    """The property is absent or null."""
    return Predicate(Op.IS_NULL, name)


def not_null(name: str) -> Predicate:
    return Predicate(Op.NOT_NULL, name)


def and_(*clauses: Predicate) -> Predicate:
    return clauses[0] if len(clauses) == 1 else Predicate(Op.AND, clauses=tuple(clauses))


def or_(*clauses: Predicate) -> Predicate:
    return clauses[0] if len(clauses) == 1 else Predicate(Op.OR, clauses=tuple(clauses))


def id_(identifier: str) -> Predicate:
    return eq(ID, identifier)


def kind(value: str) -> Predicate:
    return eq(KIND, value)


def _leaf(op: Op, element: Column, value: Any) -> Column:
    v = F.lit(value)
    return {
        Op.EQUAL: lambda: element == v,
        Op.NOT_EQUAL: lambda: element != v,
        Op.GREATER: lambda: element > v,
        Op.GREATER_OR_EQUAL: lambda: element >= v,
        Op.LESS: lambda: element < v,
        Op.LESS_OR_EQUAL: lambda: element <= v,
    }[op]()


def _test(op: Op, value: Any) -> Callable[[Column], Column]:
    return lambda element: _leaf(op, element, value)


def _combine(parts: Iterable[Column], op) -> Column:
    return reduce(op, parts)


def compile_predicate(p: Predicate, schema: StructType) -> Column:
    """A boolean Column; rows for which it is null do not match."""
    if p.op is Op.AND:
        return _combine((compile_predicate(c, schema) for c in p.clauses), lambda a, b: a & b)
    if p.op is Op.OR:
        return _combine((compile_predicate(c, schema) for c in p.clauses), lambda a, b: a | b)
    if p.property not in schema.names:
        raise UnknownPropertyError(f"no item has the property {p.property!r}")
    kind_of = schema[p.property].dataType
    column = F.col(f"`{p.property}`")
    if p.op is Op.IS_NULL:
        return column.isNull()
    if p.op is Op.NOT_NULL:
        return column.isNotNull()
    if isinstance(kind_of, MapType | StructType | VariantType):
        raise ValueError(f"{p.property} is of a type that can't be compared")
    values, multi = p.values.values, isinstance(kind_of, ArrayType)
    if not values:
        return F.lit(False)
    if p.op is Op.NONE:
        return ~F.arrays_overlap(column, F.array(*map(F.lit, values))) if multi else ~column.isin(*values)
    if p.op is Op.EQUAL and p.values.quantifier is Quantifier.SOME and len(values) > 1:
        return F.arrays_overlap(column, F.array(*map(F.lit, values))) if multi else column.isin(*values)
    if p.op in (Op.GREATER, Op.GREATER_OR_EQUAL, Op.LESS, Op.LESS_OR_EQUAL):
        values = values[:1]
    if multi:
        parts = [F.array_contains(column, F.lit(v)) if p.op is Op.EQUAL else F.exists(column, _test(p.op, v)) for v in values]
    else:
        parts = [_leaf(p.op, column, v) for v in values]
    both = p.values.quantifier is Quantifier.ALL
    return _combine(parts, (lambda a, b: a & b) if both else (lambda a, b: a | b))
