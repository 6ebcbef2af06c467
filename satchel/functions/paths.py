"""Identifiers: slash-separated paths in string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), "^/+|/+$", "")


def segments(path: Column | str) -> Column:
    return F.split(_c(path), "/")


def depth(path: Column | str) -> Column:
    return F.size(segments(path))


def name(path: Column | str) -> Column:
    return F.element_at(segments(path), -1)


def parent(path: Column | str) -> Column:
    """Null for a root."""
    return F.nullif(F.regexp_replace(_c(path), "/?[^/]*$", ""), F.lit(""))


def child(of: Column | str, named: Column | str) -> Column:
    return F.concat_ws("/", _c(of), _c(named))


def is_ancestor(of: Column | str, path: Column | str) -> Column:
    """Whether ``of`` is strictly above ``path``."""
    return F.startswith(_c(path), F.concat(_c(of), F.lit("/")))


def ancestors(path: Column | str) -> Column:
    """All strict ancestors, the nearest last."""
    s = segments(path)
    above = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda n: F.concat_ws("/", F.slice(s, F.lit(1), n)))
    return F.when(F.size(s) > 1, above).otherwise(F.array().cast("array<string>"))


def order_key(path: Column | str) -> tuple[Column, Column]:
    """Sort columns of identifier order: ancestors segment by segment, shallower first, then name."""
    s = segments(path)
    return F.slice(s, F.lit(1), F.size(s) - 1), F.element_at(s, -1)


def revision_number(path: Column | str) -> Column:
    """The integer after the first hyphen of the name, else -1."""
    return F.coalesce(F.regexp_extract(name(path), "^[^-]*-(.*)$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def random_child(of: Column | str | None = None) -> Column:
    return F.uuid() if of is None else child(of, F.uuid())
