"""Navigation of the hierarchy that identifiers make."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.paths import is_ancestor, parent
from satchel.operators.predicates import ID


def fetch_children(items: DataFrame, path: str) -> DataFrame:
    """The items directly under ``path``.

    The prefix test prunes by the statistics of a scan before the parent is compared.
    """
    path = path.strip("/")
    return items.filter(F.col(ID).startswith(path + "/") & (parent(ID) == path))


def list_children(items: DataFrame, path: str) -> DataFrame:
    return fetch_children(items, path).select(ID)


def fetch_children_of(items: DataFrame, paths: DataFrame) -> DataFrame:
    """Children of many paths: the items with ``path``, from the column of that name."""
    return items.withColumn("path", parent(ID)).join(paths.select("path").distinct(), "path")


def list_children_of(items: DataFrame, paths: DataFrame | Iterable[str]) -> DataFrame:
    """path, children: a sorted array, empty for a path that has none."""
    if not isinstance(paths, DataFrame):
        paths = items.sparkSession.createDataFrame([(p.strip("/"),) for p in paths], "path string")
    found = fetch_children_of(items, paths).groupBy("path").agg(F.sort_array(F.collect_list(ID)).alias("children"))
    return paths.distinct().join(found, "path", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def delete_children(items: DataFrame, path: str) -> DataFrame:
    """Without the direct children; what is below them stays."""
    path = path.strip("/")
    return items.filter(~F.coalesce(parent(ID) == path, F.lit(False)))


def fetch_descendants(items: DataFrame, path: str) -> DataFrame:
    return items.filter(F.col(ID).startswith(path.strip("/") + "/"))


def fetch_ancestors(items: DataFrame, path: str) -> DataFrame:
    """Items above ``path``, whether or not an item stands at it."""
    return items.filter(is_ancestor(F.col(ID), F.lit(path.strip("/"))))
