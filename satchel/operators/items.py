"""Item frames: one row an item, one column a property."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators.predicates import ID, KIND

PROPS, UNINDEXED = "__PROPS__", "__UNINDEXED__"


def items_of(df: DataFrame, kind: str, identifier: Column, unindexed: Iterable[str] = ()) -> DataFrame:
    """A table as items of one kind."""
    names = [c for c in df.columns if c not in (ID, KIND, PROPS, UNINDEXED)]
    listed = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    return df.select(identifier.cast("string").alias(ID), F.lit(kind).alias(KIND), *names, listed(names).alias(PROPS), listed(sorted(unindexed)).alias(UNINDEXED))


def union_items(*frames: DataFrame) -> DataFrame:
    """Items of several kinds together; a property keeps one type or the union is refused."""
    types: dict[str, str] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            if types.setdefault(name, kind) != kind:
                raise TypeError(f"{name} is {types[name]} and {kind}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def has_property(name: str) -> Column:
    """True for a property that is present, even if null."""
    return F.array_contains(PROPS, name)


def is_indexed(name: str) -> Column:
    return has_property(name) & ~F.array_contains(UNINDEXED, name)


def set_property(items: DataFrame, name: str, value: Column, indexed: bool = True) -> DataFrame:
    """Sets a property of every item; indexed and unindexed exclude each other."""
    marked = F.array_union(F.col(UNINDEXED), F.array(F.lit(name))) if not indexed else F.array_remove(UNINDEXED, name)
    return items.withColumns({name: value, PROPS: F.array_union(F.col(PROPS), F.array(F.lit(name))), UNINDEXED: marked})


def remove_property(items: DataFrame, name: str) -> DataFrame:
    return items.withColumns({PROPS: F.array_remove(PROPS, name), UNINDEXED: F.array_remove(UNINDEXED, name)}).drop(name)


def all_properties(items: DataFrame, which: str = "all") -> DataFrame:
    """Identifier and a JSON object of the properties present, nulls included; ``which`` may be
    "indexed" or "unindexed".  Items that don't track presence have the properties that are not null."""
    names = [c for c in items.columns if c not in (ID, KIND, PROPS, UNINDEXED)]
    wanted = {"all": has_property, "indexed": is_indexed, "unindexed": lambda c: has_property(c) & ~is_indexed(c)}[which]
    pairs = [F.struct(F.lit(c).alias("key"), F.to_json(F.array(F.col(c)), {"ignoreNullFields": "false"}).alias("value"), (wanted(c) if PROPS in items.columns else F.col(c).isNotNull()).alias("present")) for c in names]
    # a value in its array, without the brackets
    texts = F.transform(F.filter(F.array(*pairs), lambda p: p["present"]), lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), F.substring(p["value"], F.lit(2), F.length(p["value"]) - 2)))
    return items.select(ID, F.concat(F.lit("{"), F.concat_ws(",", texts), F.lit("}")).alias("properties"))


def copy_items(items: DataFrame, identifier: Column) -> DataFrame:
    return items.withColumn(ID, identifier)


def fetch(items: DataFrame, identifier: str) -> DataFrame:
    return items.filter(F.col(ID) == identifier)


def fetch_many(items: DataFrame, identifiers: DataFrame | list[str]) -> DataFrame:
    """One row for each wanted identifier, in column ``pos`` order; nulls where there is no item."""
    if not isinstance(identifiers, DataFrame):
        rows = list(enumerate(identifiers))
        identifiers = items.sparkSession.createDataFrame(rows, "pos int, wanted string")
    return identifiers.join(items, identifiers["wanted"] == items[ID], "left")


def reference_join(items: DataFrame, name: str, referenced: DataFrame) -> DataFrame:
    """Items whose property ``name`` refers to one of ``referenced``; a multi-valued one to any."""
    ids = referenced.select(F.col(ID).alias("_to")).distinct()
    if items.schema[name].dataType.typeName() != "array":
        return items.join(ids, items[name] == ids["_to"], "left_semi")
    hits = items.select(F.col(ID).alias("_from"), F.explode(name).alias("_to")).join(ids, "_to", "left_semi").select("_from").distinct()
    return items.join(hits, items[ID] == hits["_from"], "left_semi")


def item_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Items from Python dictionaries; missing properties are null."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
