"""Windows of W symbols that stand in more than one place, for operators 1 and 6.

Of the k-symbol stretches in a window, the one with the smallest hash (the leftmost of equals) is its
anchor, so equal windows have equal anchors at equal offsets.  Each document's windows fall into runs
that share an anchor; a run's hull is the text of all its windows.

1. Routing: hashes of anchors are gathered by anchor.  A run whose anchor stands once has no repeated
   window.  The other runs' anchors go back to the shards that have them.
2. Each shard takes the hulls of those runs.  Of hulls that are equal, by their bytes, it sends one, with
   its first place, to the anchor's bucket.  That is a reference shard: its hulls, in the order of
   their places, are what the operator's own method (a suffix automaton, a suffix array) is made of, and
   all of them are read against it.  Hulls that are equal across shards, by their bytes, are read once.
3. An anchor with more than ``hot`` different hulls is parted before step 2: its runs are taken window by
   window.  Hashes of the windows route once more, and of those that stand in several places each shard
   sends one text to the bucket of that window.
4. Spans found go back to their documents.

Hashes only choose where texts meet; texts decide.  A bucket gets at most one hull of a kind from a
shard.  Places are ordered by (doc_id, hash of the text, start); rows that repeat id and text are one
document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import BYTE_HASH, Rolling, Words, bare, ids_of, mix, n_shards, pack, runs, slices, split_by, text_buffer, tidy, tidy_group, unpack
from satchel.llm.shards import by_shard, shard_of
from satchel.plans.shared import checkpoint

_PLACE = 24  # bits of a position within a slice
SLICE = 1 << 19
#: Places of a filter that tells which anchors may be hot.
FILTER = 1 << 24
#: Symbols of the hulls that one automaton or suffix array is made of, about.
TOGETHER = 1 << 18


@dataclass(frozen=True)
class Task:
    """words: whether symbols are words or bytes; keep: "first" (later windows repeat) or "none" (all
    that stand in several places do); find(hulls, W) -> for each of some different hulls, masks of the
    windows that an earlier hull has too, and of those that a later one has."""

    words: bool
    window: int
    anchor: int
    keep: str
    find: Callable[[list[bytes], int], list[tuple[np.ndarray, np.ndarray]]]
    hot: int = 4096


@dataclass
class Slice:
    """Some neighbouring documents of a table."""

    ids: np.ndarray
    tags: np.ndarray  # a hash of each text
    data: np.ndarray  # bytes
    bounds: np.ndarray  # of the documents, in symbols
    starts: np.ndarray | None  # of words, in bytes
    ends: np.ndarray | None
    symbols: np.ndarray  # a hash of each symbol

    def text(self, a: int, z: int) -> bytes:
        """Symbols a up to z; words are joined by one space."""
        if self.starts is None:
            return self.data[a:z].tobytes()
        return b" ".join(self.data[self.starts[a] : self.ends[z - 1]].tobytes().split())


def sliced(table: pa.Table | pa.RecordBatch, words: bool) -> Iterator[Slice]:
    data, offsets = text_buffer(table.column("text"))
    ids = ids_of(table.column("doc_id"))
    for s, e in slices(np.diff(offsets), SLICE):
        part, off = data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
        letters = BYTE_HASH[part]
        tags = Rolling(letters).of(off[:-1], off[1:])
        if words:
            w = Words(part, off)
            yield Slice(ids[s:e], tags, part, w.bounds, w.starts, w.ends, w.hash)
        else:
            yield Slice(ids[s:e], tags, part, off, None, None, letters)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


@dataclass
class Runs:
    doc: np.ndarray  # in the slice
    lo: np.ndarray  # first window, in the slice
    hi: np.ndarray  # last window
    anchor: np.ndarray
    hull: np.ndarray


def runs_of(s: Slice, window: int, anchor: int) -> tuple[Runs, Rolling]:
    roll = Rolling(s.symbols)
    n = len(s.symbols)
    empty = np.zeros(0, np.int64)
    out = Runs(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    if n < window:
        return out, roll
    h = roll.fixed(anchor)
    parts = []
    reach = (1 << _PLACE) - window  # a slice that is longer is taken in stretches
    for at in range(0, n - window + 1, reach):
        own = h[at : at + reach + window - anchor]
        key = (own >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(own), dtype=np.uint64)
        parts.append((sliding_min(key, window - anchor + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)[:reach] + at)
    owner = np.concatenate(parts)
    doc = np.repeat(np.arange(len(s.ids), dtype=np.int32), np.diff(s.bounds))
    valid = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    a, z = runs(owner[valid])
    if not len(a):
        return out, roll
    lo, hi, at = valid[a], valid[z - 1], owner[valid[a]]
    own = doc[lo].astype(np.int64)
    hull = mix(roll.of(lo, hi + window) + (at - lo).astype(np.uint64))
    return Runs(own, lo, hi, h[at], hull), roll


def _emit(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def routes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash as its bucket of n, in the upper half, and 32 bits more."""
    return (h % np.uint64(n)) << np.uint64(32) | (h // np.uint64(n)) & np.uint64(0xFFFFFFFF)


def _route_table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(bucket, blob) of routes, with a number and the shard of each; equal ones once, times 2 for more."""
    route, hull, shard = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((shard, hull, route))
    route, hull, shard = route[order], hull[order], shard[order]
    first = np.flatnonzero(_changes(route, hull, shard))
    times = np.minimum(np.diff(np.r_[first, len(route)]), 2).astype(np.uint8)
    keys, blobs = [], []
    for key, arrays in split_by((route[first] >> np.uint64(32)).astype(np.int32), route[first].astype(np.uint32), hull[first], shard[first], times):
        keys.append(key)
        blobs.append(pack(*arrays))
    return _emit({"bucket": (keys, pa.int32()), "blob": (blobs, pa.binary())})


def gather(docs: DataFrame, task: Task, n: int, by_window: Callable | None = None) -> DataFrame:
    """(shard, blob): for each shard, the routes of its anchors that stand in several places, and whether they
    are hot; those that are, once more for shard -1.  by_window: a filter of anchors, of which the windows are
    taken in the place of anchors."""
    W = task.window

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, parts, base = np.asarray(batch.column("_shard")).astype(np.int32), [], 0
            for s in sliced(batch, task.words):
                r, roll = runs_of(s, W, task.anchor)
                if by_window is None:
                    parts.append((routes(r.anchor, n), r.hull.astype(np.uint32), shard[base + r.doc]))
                else:
                    i = np.flatnonzero(by_window(routes(r.anchor, n)))
                    w = _ranges(r.lo[i], r.hi[i] + 1)
                    parts.append((routes(roll.of(w, w + W), n), np.zeros(len(w), np.uint32), shard[base + np.repeat(r.doc[i], r.hi[i] + 1 - r.lo[i])]))
                base += len(s.ids)
            if parts:
                yield _route_table(parts)

    def settle(group: pa.Table) -> pa.Table:
        bucket = np.uint64(group.column("bucket")[0].as_py()) << np.uint64(32)
        route, hull, shard, times = (np.concatenate(x) for x in zip(*[unpack(b, "u4", "u4", "i4", "u1") for b in group.column("blob").to_pylist()], strict=True))
        order = np.lexsort((hull, route))
        route, hull, shard, times = route[order], hull[order], shard[order], times[order]
        a, z = runs(route)
        several = np.add.reduceat(times.astype(np.int64), a) > 1
        hot = np.add.reduceat(_changes(route, hull).astype(np.int64), a) > task.hot
        keep, is_hot = np.repeat(several, z - a), np.repeat(hot, z - a)
        route, shard, is_hot = route[keep], shard[keep], is_hot[keep]
        order = np.lexsort((route, shard))
        kept = order[_changes(shard[order], route[order])]
        keys, blobs = [], []
        for key, arrays in split_by(shard[kept], route[kept] | bucket, is_hot[kept].astype(np.uint8)):
            keys.append(key)
            blobs.append(pack(*arrays))
        if hot.any():
            of_hot = np.unique(route[is_hot]) | bucket
            keys.append(-1)
            blobs.append(pack(of_hot, np.ones(len(of_hot), np.uint8)))
        return pa.table({"shard": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    found = docs.withColumn("_shard", shard_of(n)).mapInArrow(tidy(hashes), "bucket int, blob binary")
    return found.groupBy("bucket").applyInArrow(tidy_group(settle), "shard int, blob binary")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    return np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def hot_filter(states: DataFrame) -> Callable | None:
    """Whether routes may be those of hot anchors: a bit map of FILTER places; None if no anchor is hot."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array((mix(unpack(blob, "u8", "u1")[0]) % np.uint64(FILTER)).astype(np.int64))], ["place"])

    found = np.asarray(states.filter("shard < 0").mapInArrow(tidy(places), "place long").distinct().toArrow().column("place"))  # FILTER of them at most
    if not len(found):
        return None
    bits = np.zeros(FILTER, bool)
    bits[found] = True
    shared = states.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def likely(route: np.ndarray) -> np.ndarray:
        at = (mix(route) % np.uint64(FILTER)).astype(np.int64)
        return shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0

    return likely


# ---------------------------------------------------------------- what a shard sends
_ROWS = "bucket int, kind int, shard int, blob binary, texts binary"
_SPAN, _TEXT = 0, 1


class Hulls:
    """Texts of a shard by the key that routes them, each with all its places."""

    def __init__(self, task: Task):
        self.task, self.places = task, {}

    def add(self, key: int, text: bytes, place: tuple[int, int, int]) -> None:
        self.places.setdefault((key, text), []).append(place)

    def rows(self, shard: int) -> Iterator[tuple[int, int, int, bytes, bytes | None]]:
        """Of each text one, to the bucket of its key; spans that are known already stay with the shard."""
        task, spans, sent = self.task, [], []
        for (key, text), places in self.places.items():
            first, several = min(places), len(places) > 1
            size = (text.count(b" ") + 1 if task.words else len(text)) if text else 0
            if several:  # equal texts of this shard
                spans += [(*p, size) for p in places if task.keep == "none" or p != first]
            sent.append((key >> 32, key, *first, not (several and task.keep == "none"), several, text))
        if spans:
            yield shard, _SPAN, shard, pack_spans(*(np.array(x, t) for x, t in zip(zip(*spans, strict=True), _SPAN_TYPES, strict=True))), None
        sent.sort(key=lambda r: r[:5])
        for s, e in zip(*runs(np.array([r[0] for r in sent])), strict=True):
            part = sent[s:e]
            key, doc, tag, pos, asks, several = (np.array([r[k] for r in part], t) for k, t in ((1, np.uint64), (2, np.int64), (3, np.uint64), (4, np.int64), (5, np.uint8), (6, np.uint8)))
            size = np.array([len(r[7]) for r in part], np.int32)
            yield part[0][0], _TEXT, shard, pack(key, doc, tag, pos, asks, several, size), zstandard.ZstdCompressor(level=3).compress(b"".join([r[7] for r in part]))


_SPAN_TYPES = (np.int64, np.uint64, np.int64, np.int64)


def pack_spans(*columns: np.ndarray) -> bytes:
    return pack(*(c.astype(t) for c, t in zip(columns, _SPAN_TYPES, strict=True)))


def unpack_spans(blobs: list[bytes]) -> list[np.ndarray]:
    """doc_id, tag, position, size of spans."""
    if not blobs:
        return [np.zeros(0, t) for t in _SPAN_TYPES]
    return [np.concatenate(x) for x in zip(*[unpack(b, "i8", "u8", "i8", "i8") for b in blobs], strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({c.split()[0]: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(_ROWS.split(", "), kinds, strict=True))})


def _among(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in sorted ``known``, -1 for nowhere."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def select(docs: DataFrame, states: DataFrame, windows: DataFrame | None, task: Task, n: int) -> DataFrame:
    """Hulls by the bucket of their anchor, windows of hot ones by theirs, and spans by shard."""
    W = task.window
    known = states.filter("shard >= 0").withColumn("kind", F.lit(0))
    if windows is not None:
        known = known.union(windows.filter("shard >= 0").withColumn("kind", F.lit(1)))

    def routes_of(right: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = zip(right.column("blob").to_pylist(), right.column("kind").to_pylist(), strict=True) if right.num_rows else ()
        parts = [unpack(b, "u8", "u1") for b, k in rows if k == kind]
        route, hot = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        order = np.argsort(route)
        return route[order], hot[order] > 0

    def work(table: pa.Table, right: pa.Table) -> pa.Table:
        anchors, hot = routes_of(right, 0)
        wanted, _ = routes_of(right, 1)
        if not len(anchors) or not table.num_rows:
            return _table([])
        hulls, seen = Hulls(task), set()
        for s in sliced(table, task.words):
            new = np.zeros(len(s.ids), bool)  # rows that repeat a document are passed over
            for i, key in enumerate(zip(s.ids.tolist(), s.tags.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            r, roll = runs_of(s, W, task.anchor)
            route = routes(r.anchor, n)
            at = _among(anchors, route)
            hit = np.flatnonzero((at >= 0) & new[r.doc]) if len(at) else at
            ids, tags, bounds = s.ids.tolist(), s.tags.tolist(), s.bounds.tolist()
            rows = zip(hit.tolist(), route[hit].tolist(), r.doc[hit].tolist(), r.lo[hit].tolist(), r.hi[hit].tolist(), hot[at[hit]].tolist(), strict=True)
            for _, key, d, lo, hi, warm in rows:
                if not warm:
                    hulls.add(key, s.text(lo, hi + W), (ids[d], tags[d], lo - bounds[d]))
                    continue
                w = np.arange(lo, hi + 1)
                h = routes(roll.of(w, w + W), n)
                for j in np.flatnonzero(_among(wanted, h) >= 0).tolist():
                    hulls.add(int(h[j]), s.text(lo + j, lo + j + W), (ids[d], tags[d], lo + j - bounds[d]))
        return _table(list(hulls.rows(right.column("shard")[0].as_py())))

    return by_shard(docs, known, n, work, _ROWS)


# ---------------------------------------------------------------- what a bucket finds
def verify(rows: DataFrame, task: Task) -> DataFrame:
    """(shard, blob): spans, from the settled ones and from each bucket's own."""
    W, all_ = task.window, task.keep == "none"

    def work(group: pa.Table) -> pa.Table:
        kind, shard = np.asarray(group.column("kind")), np.asarray(group.column("shard"))
        blobs, packed = group.column("blob").to_pylist(), group.column("texts").to_pylist()
        keys = [int(shard[i]) for i in np.flatnonzero(kind == _SPAN)]
        out = [blobs[i] for i in np.flatnonzero(kind == _SPAN)]
        at = np.flatnonzero(kind == _TEXT).tolist()
        if at:
            parts = [unpack(blobs[i], "u8", "i8", "u8", "i8", "u1", "u1", "i4") for i in at]
            key, doc, tag, pos, asks, several, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            home, texts = np.repeat(shard[at], [len(p[0]) for p in parts]), []
            for i, p in zip(at, parts, strict=True):
                raw, ends = zstandard.ZstdDecompressor().decompress(packed[i]), np.cumsum(p[6]).tolist()
                texts += [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]
            order = np.lexsort((pos, tag, doc, key))
            found = []
            for group_ in _batches(key[order], size[order]):
                own = order[group_]
                # different texts, in the order of their places within a key
                number: dict[tuple[int, bytes], int] = {}
                of = [number.setdefault((int(key[i]), texts[i]), len(number)) for i in own.tolist()]
                times = np.bincount(of, 1 + several[own].astype(np.int64), len(number))
                first = np.zeros(len(own), bool)
                first[np.unique(of, return_index=True)[1]] = True
                of_key = np.array([k for k, _ in number], np.uint64)
                a, z = runs(of_key)
                open_ = np.repeat(z - a > 1, z - a)  # keys with several texts
                hulls = [t for (_, t), o in zip(number, open_.tolist(), strict=True) if o]
                masks = dict(zip(np.flatnonzero(open_).tolist(), task.find(hulls, W), strict=True)) if hulls else {}
                for j, i in enumerate(own.tolist()):
                    if not asks[i]:
                        continue
                    k = of[j]
                    if (times[k] > 1) if all_ else not first[j]:
                        length = texts[i].count(b" ") + 1 if task.words else len(texts[i])
                        found.append((home[i], doc[i], tag[i], pos[i], length))
                    elif k in masks:
                        earlier, later = masks[k]
                        mask = earlier | later if all_ else earlier
                        if mask.any():
                            for x, y in zip(*_stretches(mask), strict=True):
                                found.append((home[i], doc[i], tag[i], pos[i] + x, y - x + W - 1))
            if found:
                home, *spans = (np.array(x) for x in zip(*found, strict=True))
                for k, arrays in split_by(home.astype(np.int32), *(x.astype(t) for x, t in zip(spans, _SPAN_TYPES, strict=True))):
                    keys.append(k)
                    out.append(pack_spans(*arrays))
        return pa.table({"shard": pa.array(keys, pa.int32()), "blob": pa.array(out, pa.binary())})

    return rows.groupBy("bucket").applyInArrow(tidy_group(work), "shard int, blob binary")


def _batches(key: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Whole groups of equal keys, about TOGETHER bytes at a time."""
    a, z = runs(key)
    total = np.add.reduceat(size.astype(np.int64), a)
    for s, e in slices(total, TOGETHER):
        yield np.arange(a[s], z[e - 1])


def _stretches(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return edge[::2].tolist(), edge[1::2].tolist()


def apply_spans(docs: DataFrame, spans: DataFrame, task: Task, n: int, emit: Callable[[pa.Table, list[tuple[int, Slice, np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """``emit`` gets the rows of a shard and, of each run of rows, (first row, slice, removed symbols)."""

    def work(table: pa.Table, right: pa.Table) -> pa.Table:
        if not table.num_rows:
            return emit(table, [])
        d, tag, p, e = unpack_spans(right.column("blob").to_pylist() if right.num_rows else [])
        order = np.lexsort((tag, d))
        d, tag, p, e = d[order], tag[order], p[order], e[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (tag[1:] != tag[:-1])]) if len(d) else np.zeros(0, np.int64)
        of = {key: (a, z) for key, a, z in zip(zip(d[first].tolist(), tag[first].tolist(), strict=True), first.tolist(), [*first[1:].tolist(), len(d)], strict=True)}
        parts, base = [], 0
        for s in sliced(table, task.words):
            removed = np.zeros(len(s.symbols) + 1, np.int32)
            for i, key in enumerate(zip(s.ids.tolist(), s.tags.tolist(), strict=True)):
                if (k := of.get(key)) is not None:
                    start = s.bounds[i] + p[k[0] : k[1]]
                    np.add.at(removed, start, np.int32(1))
                    np.add.at(removed, start + e[k[0] : k[1]], np.int32(-1))
            parts.append((base, s, np.cumsum(removed)[:-1] > 0))
            base += len(s.ids)
        return emit(table, parts)

    return by_shard(docs, spans, n, work, schema)


def remove_repeats(docs: DataFrame, task: Task, emit, schema: str) -> DataFrame:
    """Find the repeated windows of ``docs`` (doc_id, text and more) and let ``emit`` make the result."""
    own = bare(docs)
    n = n_shards(own)
    states = checkpoint(gather(own, task, n))
    hot = hot_filter(states)
    windows = gather(own, task, n, hot) if hot else None
    return apply_spans(docs, verify(select(own, states, windows, task, n), task), task, n, emit, schema)


__all__ = ["Slice", "Task", "remove_repeats"]
