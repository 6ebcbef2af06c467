"""Helpers shared by the operators of this subpackage.

Rows that repeat both ``doc_id`` and ``text`` are one document given several times.  A null
``doc_id`` sorts before every other one; a null text is an empty one unless an operator says
otherwise.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of documents aims at.
SHARD_BYTES = 4 << 20
NULL_ID = np.iinfo(np.int64).min


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bare(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def whole_row(docs: DataFrame, without: tuple[str, ...] = ()):
    """All columns as one, so that names of any kind clash with none."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in without]).alias("row")


def columns_of(docs: DataFrame, made: dict) -> list:
    """The columns of ``docs`` from its ``row``, but for those that are ``made`` anew."""
    return [(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns]


def n_shards(docs: DataFrame, column: str = "text", per: int = SHARD_BYTES) -> int:
    """How many groups of about ``per`` bytes the texts make."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return int(total // per) + 1


def shard_of(n: int):
    """The group of a document: by id and text, so that rows sharing an id or none spread out."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")


# ---------------------------------------------------------------- memory of workers
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others give back by themselves
#: Bytes of groups after which a worker gives back what it has freed.
GIVE_BACK = 16 << 20
_done = 0


def give_back(done: int = GIVE_BACK) -> None:
    """What this process has freed goes back to the system, once ``done`` bytes of groups add up.  Workers live
    on between tasks and stages, several beside one JVM, and would each keep the most that they ever needed."""
    global _done
    _done += done
    if _done >= GIVE_BACK:
        _done = 0
        pa.default_memory_pool().release_unused()
        if _TRIM:
            _TRIM(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` for mapInArrow that gives memory back at its end."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def tidy_group(work: Callable[[pa.Table], pa.Table]):
    """``work`` for applyInArrow that gives memory back after every ``GIVE_BACK`` bytes of groups."""

    def run(group):
        found = work(group)
        give_back(group.nbytes)
        return found

    return run


# ---------------------------------------------------------------- arrays in binary columns
_LEVEL = 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes; ``unpack`` needs their types."""
    return zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    kinds = [np.dtype(k) for k in kinds]
    n, at, out = len(raw) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * k.itemsize
    return out


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return starts, np.r_[starts[1:], len(key)]


def split_by(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(key, slices) for each value of ``key``, rows in their old order."""
    order = np.argsort(key, kind="stable")
    key, arrays = key[order], [a[order] for a in arrays]
    for s, e in zip(*runs(key), strict=True):
        yield key[s].item(), [a[s:e] for a in arrays]


# ---------------------------------------------------------------- texts of an Arrow batch
def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column: pa.Array) -> np.ndarray:
    """Integer ids with ``NULL_ID`` for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.fill_null(NULL_ID) if column.null_count else column, dtype=np.int64)


def ids_column(ids: np.ndarray) -> pa.Array:
    ids = np.asarray(ids, np.int64)
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about ``most``; a larger one stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ---------------------------------------------------------------- hashing, the same in every process
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_HASH = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16) * 5 // 4, np.uint64(base))
        full[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(full)
    return have[:n]


class Rolling:
    """Hashes of any stretch of an array of symbols, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(_BASE, n), out=self.sums[1:])

    def fixed(self, size: int) -> np.ndarray:
        """Of every stretch of ``size`` symbols."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * powers(_INVERSE, max(n, 0))) if n > 0 else np.zeros(0, np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of given stretches; the length is part of the hash."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * powers(_INVERSE, int(starts.max()) + 1)[starts] + mix((ends - starts).astype(np.uint64)))


# White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a batch of texts: where each starts and ends, its document, its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~space[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.r_[False, inside[:-1]] & ~cut[:-1] if len(data) else inside
        self.starts = np.flatnonzero(inside & ~before)
        after = np.r_[inside[1:], False] & ~cut[1:] if len(data) else inside
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Words of document i: bounds[i] up to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = Rolling(BYTE_HASH[self.data]).of(self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        return self._hash

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def default_tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
