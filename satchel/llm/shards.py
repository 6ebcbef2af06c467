"""Documents in shards: groups of about equal size, packed and compressed before they are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from satchel.llm.common import give_back, shard_of, split_by, tidy

_OPTIONS = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()


def packed(docs: DataFrame, n: int) -> DataFrame:
    """(shard int, rows binary): rows of ``docs`` by shard, many in one compressed value."""

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.asarray(batch.column("_shard"))
            rest = batch.select([c for c in batch.schema.names if c != "_shard"])
            keys, blobs = [], []
            for key, (rows,) in split_by(shard, np.arange(len(shard))):
                keys.append(key)
                blobs.append(to_ipc(rest.take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "rows"])

    return docs.withColumn("_shard", shard_of(n)).mapInArrow(tidy(pack_rows), "shard int, rows binary")


def by_shard(docs: DataFrame, other: DataFrame, n: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the documents of each shard and the rows of ``other`` that carry its number."""
    empty = pa.schema([])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = from_ipc(left.column("rows").to_pylist()) if left.num_rows else pa.table({}, schema=empty)
        found = work(docs, right)
        give_back(docs.nbytes)
        return found

    return packed(docs, n).groupBy("shard").cogroup(other.groupBy("shard")).applyInArrow(run, schema)
