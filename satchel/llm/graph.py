"""Connected components of an undirected graph by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.plans.shared import checkpoint


def stars(pairs: np.ndarray) -> np.ndarray:
    """Edges that connect what ``pairs`` (n x 2) connect, each from a node to the smallest it reaches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for u, v in pairs.tolist():
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return np.array([(x, r) for x in list(root) if (r := find(x)) != x], np.int64).reshape(-1, 2)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u long, v long); root is the smallest node.

    Minima are aggregated before they are joined back, so a node with many edges is spread by the
    join, not gathered.  Null ends and loops are left out; no edges give no rows.
    """
    edges = checkpoint(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())
    seen = mark(edges)
    for _ in range(rounds if seen[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written minima leave a plain shuffle on either side of the joins, which can then split a hub
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpoint(large)
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = checkpoint(small)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
