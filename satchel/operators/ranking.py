"""Places in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.plans.shared import checkpoint

_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def with_places(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Adds the 1-based place of each row in ``order``, which should leave no ties.

    Rows are sorted by ranges.  A row's place is its own in its partition after the sizes of the
    partitions before; those sizes, one row a partition, are all that is summed in one task.
    """
    sorted_ = checkpoint(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _BITS)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = sorted_.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _BITS) - 1) + 1).drop("_part", "_at", "_before")
