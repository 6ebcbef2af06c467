"""Following a store as a stream: journal rows of revisions as they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def journal_stream(spark: SparkSession, root: str, files_per_trigger: int = 100) -> DataFrame:
    """id, kind, rev of each change.  A revision may not be committed yet: join with the commits."""
    return (
        spark.readStream.schema("id string, kind string, rev long")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{root.rstrip('/')}/data/journal")
    )
