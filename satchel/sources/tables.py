"""Reading item frames and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items written by ``write_items``; kinds with different properties are merged."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_items(items: DataFrame, path: str, mode: str = "append") -> None:
    """By kind, so that a filter on the kind reads only its files."""
    items.write.mode(mode).partitionBy("__KIND__").parquet(path)


def list_objects(spark: SparkSession, prefix: str, limit: int | None = None) -> DataFrame:
    """path, modificationTime and length of the objects under a prefix or glob, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix).select("path", "modificationTime", "length")
    return files if limit is None else files.orderBy("path").limit(limit)
