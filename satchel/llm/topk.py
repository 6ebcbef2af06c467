"""Operator 5: exact top-k by inner product over an impact-ordered index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.plans.shared import written

#: Vectors of an index block and queries of a group of queries at most, the bounds of one task's work.
BLOCK, QUERIES = 1 << 16, 1 << 16
#: Queries that are streamed past an index together.
AT_ONCE = 64
#: Quantised impacts.
LEVELS = 16
#: Rows that may be members, in multiples of k, at which a query is rescored.
FEW = 4
_LONG = (1 << 63) - 1


class ImpactIndex:
    """Posting segments of a block of integer vectors, in the order of quantised impact.

    A posting is a row and its value in a component; its impact is the value's size, quantised to LEVELS
    steps.  A segment has the postings of one component and one impact.  Segments are processed from the
    largest impact on, adding to a score for each row.  What a row's later postings can still add or take
    is at most their norm times that of the query, so its score is known to lie in an interval.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.vectors = ids, rows, vectors
        size = np.abs(vectors.astype(float))
        n, d = vectors.shape
        top = size.max(initial=0)
        impact = np.ceil(size * (LEVELS / top)).astype(np.int8) if top else np.zeros((n, d), np.int8)
        component, row = np.nonzero(impact.T)
        order = np.argsort(-impact[row, component], kind="stable")  # then by component, then by row
        component, row = component[order].astype(np.int32), row[order].astype(np.int32)
        self.row, self.value = row, vectors[row, component].astype(float)
        level = impact[row, component].astype(np.int64)
        cut = np.r_[0, np.flatnonzero((np.diff(level) != 0) | (np.diff(component) != 0)) + 1, len(level)] if len(level) else np.zeros(1, np.int64)
        #: Of each impact, from the largest: segments (component, first and one past the last posting), and
        #: of each row the norm of the postings of smaller impact.
        self.levels: list[tuple[list[tuple[int, int, int]], np.ndarray]] = []
        energy, left = size**2, np.sqrt((size**2).sum(axis=1))
        for k in range(LEVELS, 0, -1):
            mine = [(int(component[a]), int(a), int(z)) for a, z in zip(cut[:-1], cut[1:], strict=True) if level[a] == k]
            if mine:
                rest = np.sqrt(np.where(impact < k, energy, 0).sum(axis=1)) + left * 1e-12
                self.levels.append((mine, rest))

    def exact(self, query: np.ndarray, rows: np.ndarray) -> list[int]:
        part = self.vectors[rows]
        if float(np.abs(part).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(part.shape[1], 1) < 2**62:
            return (part @ query).tolist()
        whole = [sum(x * y for x, y in zip(v, query.tolist(), strict=True)) for v in part.tolist()]
        return [max(-_LONG - 1, min(_LONG, s)) for s in whole]

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[list[tuple[int, int]]]:
        """The k best (score, id) of each query, ties to the smaller id; the row ``own`` is no candidate."""
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        for s in range(0, len(queries), AT_ONCE):
            self._search(queries[s : s + AT_ONCE], k, own[s : s + AT_ONCE], out, s)
        return out

    def _search(self, queries: np.ndarray, k: int, own: np.ndarray, out: list, first: int) -> None:
        n = len(self.ids)
        todo, q = np.arange(len(queries)), np.ascontiguousarray(queries.T, dtype=float)
        norm = np.sqrt((q**2).sum(axis=0)) * (1 + 1e-9)
        partial = np.zeros((n, len(queries)))
        at, of = np.nonzero(self.rows[:, None] == own[None, :])
        partial[at, of] = -np.inf
        last = len(self.levels) - 1
        for no, (segments, rest) in enumerate(self.levels or [([], np.zeros(n))]):
            for c, a, z in segments:
                partial[self.row[a:z]] += self.value[a:z, None] * q[c]
            slack = rest[:, None] * norm[todo]
            low = partial - slack
            bar = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(todo), -np.inf)
            possible = partial + slack >= bar
            # proof: no other row can be a member; after the last segments all that may be one are rescored
            ready = (possible.sum(axis=0) <= FEW * k) | (no >= last)
            for i in np.flatnonzero(ready):
                rows = np.flatnonzero(possible[:, i] & (partial[:, i] > -np.inf))
                scores = self.exact(queries[todo[i]], rows)
                best = sorted(zip([-x for x in scores], self.ids[rows].tolist(), strict=True))[:k]
                out[first + todo[i]] = [(-x, j) for x, j in best]
            if ready.all():
                return
            if ready.any():
                todo, partial, q = todo[~ready], np.ascontiguousarray(partial[:, ~ready]), np.ascontiguousarray(q[:, ~ready])


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, v array<long> (floor(1024 x)) and row, a number for each row, written once so that it stays.

    Rows with a null or non-finite component, or no vector or id, are left out.  A component beyond the
    range of long is its end.
    """
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))")
    made = F.expr("transform(embedding, x -> cast(floor(1024 * cast(x as double)) as long))")
    return written(embeddings.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), made.alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists as rows, filled with 0 or cut to ``width``, by default that of the longest."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    keep = place < width
    out[row[keep], place[keep]] = np.asarray(lists.flatten(), np.int64)[keep]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, per: int = QUERIES) -> DataFrame:
    """The k largest inner products of each query: query_id, rank, vec_id, score.

    vectors, queries: (vec_id long, v array<long>, row long).  Rows are told apart by ``row``: a query is
    compared with every vector but that of its own row, and rows that repeat a vec_id are queries and
    candidates each.  Each index block is built for a group of up to ``per`` queries, which are streamed
    past it; vectors are copied once for each such group.  Vectors of another length are compared up to
    the shorter one.  Ties go to the smaller vec_id.  Scores beyond the range of long are its ends.  No
    rows give no rows.
    """
    n, q = vectors.count(), queries.count()
    spread_over = 2 * vectors.sparkSession.sparkContext.defaultParallelism  # small tables use all tasks
    nb, nq = max(1, -(-n // block), min(spread_over, -(-n // 1024))), max(1, -(-q // per))
    spread = lambda m: F.pmod(F.xxhash64("vec_id", "row"), F.lit(m)).cast("int")
    left = vectors.select("vec_id", "v", "row", spread(nb).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"))
    # names of their own: the two sides may be one table, whose columns Spark would confuse
    right = queries.select(F.col("vec_id").alias("asked_id"), F.col("v").alias("asked"), F.col("row").alias("asked_row"), spread(nq).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b"))
    names = ("row", "query_id", "vec_id", "score")

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in names}
        if rows.num_rows and asked.num_rows:
            grid, own = _matrix(rows.column("v")), np.asarray(asked.column("asked_row"), np.int64)
            index = ImpactIndex(np.asarray(rows.column("vec_id"), np.int64), np.asarray(rows.column("row"), np.int64), grid)
            found = index.search(_matrix(asked.column("asked"), grid.shape[1]), k, own)
            for row, qid, best in zip(own.tolist(), asked.column("asked_id").to_pylist(), found, strict=True):
                for score, i in best:
                    for c, v in zip(names, (row, qid, i, score), strict=True):
                        out[c].append(v)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_query(embeddings: DataFrame) -> DataFrame:
    vectors = quantised(embeddings)
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


#: Rows are told apart by their place, not by vec_id, which may repeat.
TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row_id <> c.row_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
