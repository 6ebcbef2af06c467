"""A filter and a sort order, and what can be asked of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from satchel.functions.paths import order_key
from satchel.operators.predicates import ID, Op, Predicate, UnknownPropertyError, _compare, and_, compile_predicate


class Direction(Enum):
    ASCENDING = "asc"
    DESCENDING = "desc"


@dataclass(frozen=True)
class Sort:
    name: str
    direction: Direction = Direction.ASCENDING

    def __post_init__(self):
        if not self.name or not isinstance(self.direction, Direction):
            raise ValueError("a sort key needs a property and a direction")

    def column(self) -> Column:
        """Null is the smallest value: first ascending, last descending."""
        c = F.col(f"`{self.name}`")
        return c.asc_nulls_first() if self.direction is Direction.ASCENDING else c.desc_nulls_last()


@dataclass(frozen=True)
class Query:
    """Immutable; each method returns a new query."""

    predicate: Predicate | None = None
    sorts: tuple[Sort, ...] = field(default=())

    def where(self, predicate: Predicate) -> Query:
        """Replaces the filter."""
        return replace(self, predicate=predicate)

    def add_filter(self, name: str | Predicate, op: Op | None = None, value=None) -> Query:
        """Adds a condition to the filter, which all must hold."""
        more = name if isinstance(name, Predicate) else Predicate(op, name) if op in (Op.IS_NULL, Op.NOT_NULL) else _compare(op, name, value)
        return replace(self, predicate=more if self.predicate is None else and_(*self.predicate.conjuncts(), more))

    def order_by(self, name: str, direction: Direction = Direction.ASCENDING) -> Query:
        return replace(self, sorts=(*self.sorts, Sort(name, direction)))

    add_sort = order_by

    def filter_predicates(self) -> tuple[Predicate, ...]:
        return () if self.predicate is None else self.predicate.conjuncts()

    def prepare(self, items: DataFrame) -> PreparedQuery:
        return PreparedQuery(self, items)


class PreparedQuery:
    """A query on an item frame.  Nothing runs before a terminal method is called."""

    def __init__(self, query: Query, items: DataFrame):
        self.query, self.items = query, items

    def df(self) -> DataFrame:
        items, q = self.items, self.query
        out = items if q.predicate is None else items.filter(compile_predicate(q.predicate, items.schema))
        for s in q.sorts:
            if s.name not in items.columns:
                raise UnknownPropertyError(f"no item has the property {s.name!r}")
        return out.orderBy(*(s.column() for s in q.sorts)) if q.sorts else out

    def by_identifier(self) -> DataFrame:
        """In identifier order: by ancestors, then depth, then name."""
        return self.df().orderBy(*order_key(F.col(ID)))

    def list(self) -> list[Row]:
        return self.df().collect()

    def item(self) -> Row | None:
        return self.df().first()

    def count(self) -> int:
        return PreparedQuery(replace(self.query, sorts=()), self.items).df().count()

    def identifiers(self) -> DataFrame:
        return self.df().select(ID)

    def iterate(self, prefetch: bool = True) -> Iterator[Row]:
        return self.df().toLocalIterator(prefetchPartitions=prefetch)
