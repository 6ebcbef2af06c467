"""An ordered key and value set over a frame with columns ``key`` and ``value``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class OrderedSet:
    def __init__(self, frame: DataFrame):
        self.frame = frame

    def put(self, key: Any, value: Any) -> OrderedSet:
        """Inserts or overwrites; a null key is refused."""
        if key is None:
            raise ValueError("a key is needed")
        row = self.frame.sparkSession.createDataFrame([(key, value)], self.frame.schema)
        return OrderedSet(self.frame.filter(F.col("key") != F.lit(key)).union(row))

    def put_all(self, rows: DataFrame) -> OrderedSet:
        """Rows replace those with their keys; null keys are refused when they are read."""
        rows = rows.select(F.coalesce("key", F.raise_error(F.lit("a key is needed")).cast(rows.schema["key"].dataType)).alias("key"), "value")
        return OrderedSet(self.frame.join(rows, "key", "left_anti").select("key", "value").union(rows))

    def remove(self, key: Any) -> OrderedSet:
        return OrderedSet(self.frame.filter(F.col("key") != F.lit(key)))

    def find(self, key: Any) -> Row | None:
        return self.frame.filter(F.col("key") == F.lit(key)).first()

    def seek(self, key: Any, reverse: bool = False) -> Row | None:
        """The entry at ``key`` or the next one in the direction."""
        return self.nearest(key, reverse).first()

    def nearest(self, key: Any, reverse: bool = False) -> DataFrame:
        """``seek`` as a frame of one row at most."""
        c = F.col("key")
        return self.frame.filter(c <= F.lit(key) if reverse else c >= F.lit(key)).orderBy(c.desc() if reverse else c.asc()).limit(1)

    def ordered(self, reverse: bool = False) -> DataFrame:
        c = F.col("key")
        return self.frame.orderBy(c.desc() if reverse else c.asc())

    def in_range(self, low: Any, high: Any) -> DataFrame:
        """(key, id) for the ids in the values, lists or single ones, of keys from ``low`` up to ``high``."""
        found = self.frame.filter(F.col("key").between(F.lit(low), F.lit(high)))
        many = self.frame.schema["value"].dataType.typeName() == "array"
        return found.select("key", F.explode("value").alias("id") if many else F.col("value").alias("id"))

    def clear(self) -> OrderedSet:
        return OrderedSet(self.frame.limit(0))

    def is_empty(self) -> bool:
        return self.frame.isEmpty()
