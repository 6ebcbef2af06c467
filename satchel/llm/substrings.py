"""Operators 1 and 6: removal of repeated stretches of words, and of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from satchel.llm.automaton import SuffixAutomaton
from satchel.llm.common import bare, columns_of, ids_column, runs, sha256, whole_row
from satchel.llm.repeats import Slice, Task, remove_repeats

WORDS, BYTES = 20, 200


# ---------------------------------------------------------------- operator 1
def earlier_by_automaton(hulls: list[bytes], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows that an earlier one of some different texts has too.

    The texts, in order of place, make the suffix automaton of a reference shard, whose states know where
    they first end; each text is then streamed against it, and wherever its matching statistic reaches the
    window the first occurrence is looked up.
    """
    texts = [h.split(b" ") for h in hulls]
    automaton, owner = SuffixAutomaton(), []
    for k, words in enumerate(texts):
        automaton.add(words, len(owner))
        owner += [k] * len(words)
    out = []
    for k, words in enumerate(texts):
        mask = np.zeros(len(words) - window + 1, bool)
        for i, end in automaton.statistics(words, window):
            mask[i - window + 1] = owner[end] < k
        out.append((mask, np.zeros(len(mask), bool)))
    return out


def word_task(window: int = WORDS) -> Task:
    return Task(True, window, max(1, window // 2), "first", earlier_by_automaton)


def _kept_words(s: Slice, i: int, removed: np.ndarray) -> bytes:
    a, z = s.bounds[i], s.bounds[i + 1]
    if a == z:
        return b""
    raw = s.data[s.starts[a] : s.ends[z - 1]].tobytes().split()
    gone = removed[a:z]
    return b" ".join(raw) if not gone.any() else b" ".join([w for w, g in zip(raw, gone.tolist(), strict=True) if not g])


def substring_dedup(docs: DataFrame, window: int = WORDS, count: str = "n_removed") -> DataFrame:
    """All rows with ``text`` without the words of windows that start earlier elsewhere, and
    ``n_removed`` (``count`` may give it another name), in place of a column of that name.

    Kept words are joined by one space where any was removed; other texts stay as they are, null too.
    Earlier means a smaller doc_id, or the same document and an earlier start; rows that repeat doc_id
    and words are one document.  A text of fewer than ``window`` words loses nothing.
    """
    docs = docs.drop(count)
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole_row(docs, ("text",)))
    names = ["doc_id", "text", "row"]
    schema = StructType([*inner.schema.fields, StructField("n_removed", LongType())])

    def emit(table: pa.Table, parts: list) -> pa.Table:
        texts, counts = [], []
        have = table.column("text").to_pylist() if table.num_rows else []
        for base, s, removed in parts:
            per = np.add.reduceat(np.r_[removed, False].astype(np.int64), s.bounds[:-1]) * (np.diff(s.bounds) > 0)
            for i, n in enumerate(per.tolist()):
                texts.append(_kept_words(s, i, removed).decode() if n else have[base + i])
                counts.append(n)
        kept = {"text": pa.array(texts, pa.string()), "n_removed": pa.array(counts, pa.int64())}
        return pa.table({c: kept.get(c) if c in kept else table.column(c) if table.num_rows else pa.nulls(0) for c in [*names, "n_removed"]})

    found = remove_repeats(inner, word_task(window), emit, schema)
    return found.select(*columns_of(docs, {"text": F.col("text")}), F.col("n_removed").alias(count))


def substring_dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; a null text has no words."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def emit(table: pa.Table, parts: list) -> pa.Table:
        ids, n, gone, kept = [np.zeros(0, np.int64)], [], [], []
        for _, s, removed in parts:
            ids.append(s.ids)
            n += np.diff(s.bounds).tolist()
            gone += (np.add.reduceat(np.r_[removed, False].astype(np.int64), s.bounds[:-1]) * (np.diff(s.bounds) > 0)).tolist()
            kept += [sha256(_kept_words(s, i, removed)) for i in range(len(s.ids))]
        return pa.table({"doc_id": ids_column(np.concatenate(ids)), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    return remove_repeats(bare(docs), word_task(), emit, schema)


# ---------------------------------------------------------------- operator 6
class Suffixes:
    """The suffixes of some bytes, told apart by their first ``size`` bytes: prefix doubling.

    levels: (width, a number for each suffix, equal where the first ``width`` bytes are); order is that of
    the last one.
    """

    def __init__(self, data: np.ndarray, size: int):
        n, self.size = len(data), size
        value = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
        self.levels: list[tuple[int, np.ndarray]] = [(1, value[:n])]
        width = 1
        while width * 2 <= min(size, 8):
            wide = np.r_[self.levels[-1][1], np.zeros(width, np.uint64)]
            self.levels.append((width * 2, wide[:n] << np.uint64(8 * width) | wide[width : n + width]))
            width *= 2
        rank = _ranked(self.levels[-1][1])
        while width < size:
            step = min(width, size - width)
            after = np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
            rank = _ranked(rank.astype(np.uint64) * np.uint64(int(rank.max(initial=0)) + 2) + after.astype(np.uint64))
            width += step
            self.levels.append((width, rank))
        self.rank = rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes that have ``size`` bytes, ``size`` at most."""
        size = np.zeros(len(i), np.int64)
        for width, number in reversed(self.levels):
            fits = size + width <= self.size
            a, b = np.where(fits, i + size, 0), np.where(fits, j + size, 0)
            size += width * (fits & (number[a] == number[b]))
        return size


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]]) if len(key) else 0
    return rank


def nearest_smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element the nearest smaller ones before and after it, -1 for none."""

    def before(x: np.ndarray) -> np.ndarray:
        at = np.arange(-1, len(x) - 1)
        open_ = np.arange(len(x))
        while len(open_):
            # what lies between an element and its candidate is larger; so is what lies before that up to its own
            open_ = open_[at[open_] >= 0]
            open_ = open_[x[at[open_]] >= x[open_]]
            at[open_] = at[at[open_]]
        return at

    after = before(x[::-1])[::-1]
    return before(x), np.where(after < 0, -1, len(x) - 1 - after)


def longest_previous_factors(suffixes: Suffixes, starts: np.ndarray, mirrored: bool = False) -> np.ndarray:
    """For each of ``starts`` the length, up to the suffixes' size, of its longest match at an earlier start
    (mirrored: at a later one).

    In suffix order the longest match that begins earlier is with the previous or the next suffix whose
    position is smaller.
    """
    order = np.lexsort((starts, suffixes.rank[starts]))
    place = starts[order]
    out = np.zeros(len(starts), np.int64)
    for near in nearest_smaller(-place if mirrored else place):
        has = np.flatnonzero(near >= 0)
        out[order[has]] = np.maximum(out[order[has]], suffixes.common(place[has], place[near[has]]))
    return out


def repeated_by_suffix_array(hulls: list[bytes], window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of some different texts, in order of place, that have a match at an earlier and at a later one."""
    sizes = np.array([len(h) for h in hulls])
    base = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    starts = np.repeat(base, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = Suffixes(np.frombuffer(b"".join(hulls), np.uint8), window)
    cuts = np.cumsum(counts)[:-1]
    earlier, later = (np.split(longest_previous_factors(suffixes, starts, m) >= window, cuts) for m in (False, True))
    return list(zip(earlier, later, strict=True))


def byte_task(window: int = BYTES, keep: str = "none") -> Task:
    return Task(False, window, max(1, window * 16 // 25), keep, repeated_by_suffix_array)


def suffix_array_dedup(docs: DataFrame, window: int = BYTES, keep: str = "first") -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start,end>>, kept binary of every row.

    A byte goes if a string of ``window`` bytes over it also starts earlier (keep="first": smaller
    doc_id, or the same document and an earlier start) or anywhere else (keep="none").  A null text is
    empty.  Rows that repeat doc_id and text are one document.
    """
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def emit(table: pa.Table, parts: list) -> pa.Table:
        ids, n, spans, kept = [np.zeros(0, np.int64)], [], [], []
        for _, s, removed in parts:
            ids.append(s.ids)
            n += np.diff(s.bounds).tolist()
            for a, z in zip(s.bounds[:-1], s.bounds[1:], strict=True):
                gone = removed[a:z]
                if gone.any():
                    x, y = runs(gone)
                    spans.append([{"start": int(i), "end": int(j)} for i, j in zip(x, y, strict=True) if gone[i]])
                    kept.append(s.data[a:z][~gone].tobytes())
                else:
                    spans.append([])
                    kept.append(s.data[a:z].tobytes())
        return pa.table({"doc_id": ids_column(np.concatenate(ids)), "n_bytes": pa.array(n, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return remove_repeats(bare(docs), byte_task(window, keep), emit, schema)


def suffix_array_dedup_query(docs: DataFrame) -> DataFrame:
    found = suffix_array_dedup(docs, keep="none")
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
