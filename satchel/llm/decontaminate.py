"""Operator 2: benchmark items inside documents, by size-partitioned MinHash containment search.

An item of n shingles is in a document if at least 0.8 n of them are, so at most m = n - ceil(0.8 n)
are missing, and of the m + 1 shingles with the smallest hashes one must be there.  Those make the
item's sketch.  Items are partitioned by size, each partition with the sketch length of its largest
item; documents of any length are probed with all their shingles, so no item is missed, and each pair
found is verified by exact shingle containment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import LOWER, Rolling, Words, bare, columns_of, slices, text_buffer, tidy, whole_row

#: Items of a block, which is what a pass over the documents gets broadcast at most.
ITEMS = 50_000
#: Bytes of the items of a block at most; an item that is longer stands alone.
ITEM_BYTES = 32 << 20
SLICE = 1 << 20

# words of items and documents: letters, digits and all that is not ASCII, lower-cased
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_TABLE = bytes(int(LOWER[b]) if not _APART[b] else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """Distinct k-word shingles; of fewer words, all of them as one; of none, none."""
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each place where k words follow one another."""
    words = Words(LOWER[data], offsets, space=_APART)
    h = words.hash
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), words.counts())
    whole = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
    return doc[whole], Rolling(h).fixed(k)[whole]


def size_class(n: np.ndarray) -> np.ndarray:
    """Partitions by size, each with sizes up to 1.25 times those of the one before."""
    return np.ceil(np.log(np.maximum(n, 1)) / np.log(1.25)).astype(np.int64)


@dataclass
class Sketches:
    """Sketch hashes of a block of items, by how many words their shingles have."""

    items: list[tuple[int, frozenset]]
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # sorted hashes, items, filter
    k: int
    num: int
    den: int


def sketch(rows: list[tuple[int, bytes]], k: int, num: int, den: int) -> Sketches:
    items = [(i, frozenset(s)) for i, t in rows if (s := shingles(words_of(t), k))]
    size = np.array([len(s) for _, s in items], np.int64)
    missing = size - -(-size * num // den)
    part = size_class(size)
    deepest = {c: int(missing[part == c].max()) for c in np.unique(part).tolist()}
    found: dict[int, tuple[list, list]] = {}
    for at, (_, own) in enumerate(items):
        width = len(next(iter(own)))
        texts = [b" ".join(s) for s in own]
        data = np.frombuffer(b"".join(texts), np.uint8)
        _, h = hashes(data, np.cumsum([0, *map(len, texts)]), width)
        low = np.sort(h)[: deepest[int(part[at])] + 1]
        pair = found.setdefault(width, ([], []))
        pair[0].append(low)
        pair[1].append(np.full(len(low), at))
    by_width = {}
    for width, (hs, ats) in found.items():
        h, at = np.concatenate(hs), np.concatenate(ats)
        order = np.argsort(h, kind="stable")
        likely = np.zeros(1 << 16, bool)
        likely[(h >> np.uint64(48)).astype(np.int64)] = True
        by_width[width] = (h[order], at[order], likely)
    return Sketches(items, by_width, k, num, den)


def matches(s: Sketches, column: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, item, shingles of the item, how many of them the text has) of verified pairs."""
    data, offsets = text_buffer(column)
    pairs = set()
    for a, z in slices(np.diff(offsets), SLICE):
        part, off = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        for width, (h, at, likely) in s.by_width.items():
            doc, own = hashes(part, off, width)
            maybe = np.flatnonzero(likely[(own >> np.uint64(48)).astype(np.int64)])
            doc, own = doc[maybe], own[maybe]
            first, last = np.searchsorted(h, own), np.searchsorted(h, own, "right")
            hit = np.flatnonzero(last > first)
            keys = np.unique(np.stack([own[hit].view(np.int64), doc[hit]], axis=1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
            for key, d in keys.tolist():
                x = np.uint64(key & (1 << 64) - 1)
                pairs.update((d + a, int(i)) for i in at[np.searchsorted(h, x) : np.searchsorted(h, x, "right")])
    out, last, have = [], -1, {}
    for row, item in sorted(pairs):
        if row != last:
            last, have, words = row, {}, words_of(data[offsets[row] : offsets[row + 1]].tobytes())
        own = s.items[item][1]
        width = len(next(iter(own)))
        if width not in have:
            have[width] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        n = len(own & have[width])
        if s.den * n >= s.num * len(own):
            out.append((row, item, len(own), n))
    return out


def blocks(benchmark: DataFrame, k: int, num: int, den: int) -> Iterator[Sketches]:
    """Sketches of the items, block by block; rows without text have none.  Equal items count once each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // ITEMS), -(-size // ITEM_BYTES))
    for part in range(parts):
        # a block: about ITEMS items or ITEM_BYTES bytes, by hash
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield sketch(sorted(((r.item_id, r.text.encode()) for r in rows), key=lambda r: (r[0] is not None, r)), k, num, den)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of each document and item in it.

    Shingles of ``k`` words, of an item with fewer words all of them; items without words are in
    nothing, and neither is anything in a null or empty text.  Each row of ``docs`` and of
    ``benchmark`` counts for itself.  Containment is n_shared / n_item, at least num / den.
    """
    docs, schema = bare(docs), "doc_id long, item_id long, n_item long, n_shared long, containment double"
    out = docs.sparkSession.createDataFrame([], schema)
    for s in blocks(benchmark, k, num, den):
        shared = docs.sparkSession.sparkContext.broadcast(s)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for batch in batches:
                rows = matches(s, batch.column("text"))
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([s.items[r[1]][0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[3] / r[2] for r in rows], pa.float64())],
                    ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                )

        out = out.union(docs.mapInArrow(tidy(find), schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    whole, docs = docs, docs.select(F.col("text").cast("string").alias("text"), whole_row(docs, ("text",)))
    for s in blocks(benchmark, k, num, den):
        shared = docs.sparkSession.sparkContext.broadcast(s)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in matches(shared.value, batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs.select(*columns_of(whole, {"text": F.col("text")}))
