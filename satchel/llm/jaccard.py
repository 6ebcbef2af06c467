"""Operator 3: documents linked by the Jaccard similarity of their shingle sets.

1 - similarity is a metric.  At distance 1 from every pivot, where most pairs of documents are, pivots
cannot part documents, so the first regions come from exact filters.  Sets that are linked differ in at
most D elements, so of D + 1 or more classes of elements (by hash) they agree in one: documents that agree
in a class are a group of candidates.  The parities of a set's elements in some places differ in no more
places than the sets do: within a group, sets whose parities differ in more than D places are parted.  The
connected components of what is left are the regions of the metric join:

* A region of more than ``limit`` hashes is parted by several pivots into Voronoi regions.  A document goes
  to its nearest pivot and, where it is within 2 t of that distance (t: the threshold), to others.  Those
  within t of a pivot are linked with it and go no further, unless one outside may reach them.  The regions
  are parted again until they are small.  Where windows copy more than pivots part, a region is taken in
  pairs of blocks, which is exact and bounded at any size.
* A small region is joined in one task.  A pivot is linked with all inside t; those are one class, and
  no pair of them is looked at again.  Documents outside are compared with the inside ones whose distance
  to the pivot is within t of their own (the triangle inequality rules out the others), and among
  themselves with a new pivot.

Texts are read once for what the filters need (written, with a number for each row), and once more for the
sets of the documents in regions.  Sets are of 64-bit hashes of shingles; equal sets are joined once, as a
node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import Rolling, Words, bare, columns_of, mix, n_shards, pack, runs, slices, split_by, text_buffer, tidy, tidy_group, unpack, whole_row
from satchel.llm.graph import components, stars
from satchel.plans.shared import checkpoint, written

SLICE = 1 << 19
#: Hashes in a region that one task joins.
LIMIT = 1 << 17
PIVOTS = 8
#: Nodes of a group of candidates that are compared by their parities; a larger group is a region as it is.
GROUP = 4096


@dataclass(frozen=True)
class Measure:
    """Linked when den * intersection >= num * union."""

    shingle: int = 5
    num: int = 80
    den: int = 100

    def linked(self, both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (n + m - both)

    @property
    def reach(self) -> float:
        return 1 - self.num / self.den + 1e-9

    def classes(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size classes up to ``most``: first size, largest difference of a linked pair whose larger
        set is in the class, and number of element classes.  Linked sets are at most one size class
        apart."""
        low = [1]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, -(-low[-1] * self.den // self.num)))
        low.append(max(low[-1] + 1, -(-low[-1] * self.den // self.num)))
        low = np.array(low, np.int64)
        differ = (self.den - self.num) * 2 * (low[1:] - 1) // (self.den + self.num)
        return low[:-1], differ, differ + 3 + differ // 16


@dataclass
class Sets:
    """Shingle sets of some documents: elements[at[i]:at[i + 1]], sorted, and a 64-bit key of each."""

    at: np.ndarray
    elements: np.ndarray
    key: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.at)


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> Sets:
    words = Words(data, offsets, lower=True)
    n = len(words.hash)
    roll, counts = Rolling(words.hash), words.counts()
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(doc[: max(n - k + 1, 0)] == doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    h = np.concatenate([roll.fixed(k)[whole] if n >= k else np.zeros(0, np.uint64), roll.of(words.bounds[short], words.bounds[short + 1])])
    owner = np.concatenate([doc[whole], short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
        h, owner = h[new], owner[new]
    at = np.searchsorted(owner, np.arange(len(counts) + 1))
    key = np.add.reduceat(np.r_[mix(h), np.uint64(0)], at[:-1]) * (np.diff(at) > 0).astype(np.uint64) if len(counts) else np.zeros(0, np.uint64)
    return Sets(at, h, mix(key + np.diff(at).astype(np.uint64)))


def _each_slice(batch, k: int) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = text_buffer(batch.column("text"))
    for s, e in slices(np.diff(offsets), SLICE):
        yield s, e, sets_of(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], k)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _blobs(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The values of each of n owners as bytes."""
    order = np.argsort(owner, kind="stable")
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values[order].tobytes())])


def described(docs: DataFrame, measure: Measure) -> DataFrame:
    """doc_id, h (hash of the text), n (size of the set), node (key of the set), its parities and signatures,
    and rid, a number for each row; written."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, sets in _each_slice(batch, measure.shingle):
                part, (sig, owner) = batch.slice(s, e - s), signatures(sets, measure)
                columns = [part.column("doc_id"), part.column("h"), pa.array(sets.size), pa.array(_signed(sets.key)), pa.array(parities(sets), pa.binary()), _blobs(sig, owner, e - s)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "node", "bits", "signatures"])

    made = docs.withColumn("h", F.xxhash64("text")).mapInArrow(tidy(describe), "doc_id long, h long, n long, node long, bits binary, signatures binary")
    return written(made.withColumn("rid", F.monotonically_increasing_id()), "sets")


def signatures(sets: Sets, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) of each class of elements of each set, for both size classes of a
    larger partner.  Empty classes count only for sets that have so many of them that the others might all
    differ."""
    size = sets.size
    low, differ, parts = measure.classes(int(size.max(initial=1)))
    own = np.searchsorted(low, size, "right") - 1
    value, place = mix(sets.elements ^ np.uint64(0xA5A5A5A55A5A5A5A)), mix(sets.elements ^ np.uint64(0x3C3C3C3CC3C3C3C3)) >> np.uint64(32)
    doc = np.repeat(np.arange(len(size)), size)
    out: tuple[list, list] = ([], [])
    for step in (0, 1):
        level = own + step
        m = np.where((size > 0) & (differ[np.minimum(level, len(differ) - 1)] > 0), parts[np.minimum(level, len(parts) - 1)], 0)
        base = np.cumsum(m) - m
        use = m[doc] > 0
        cell = base[doc[use]] + (place[use] % np.maximum(m, 1).astype(np.uint64)[doc[use]]).astype(np.int64)
        total, filled = np.zeros(m.sum(), np.uint64), np.zeros(m.sum(), bool)
        np.add.at(total, cell, value[use])
        filled[cell] = True
        of = np.repeat(np.arange(len(m)), m)
        no = np.arange(len(of)) - base[of]
        n_filled = np.bincount(of[filled], minlength=len(m))
        emit = filled | (n_filled <= differ[np.minimum(level, len(differ) - 1)])[of]
        label = (level[of].astype(np.uint64) << np.uint64(40)) | no.astype(np.uint64)
        out[0].append(mix(total + mix(label))[emit])
        out[1].append(of[emit])
    return np.concatenate(out[0]), np.concatenate(out[1])


def parities(sets: Sets) -> list[bytes]:
    """For each set the parity of its elements in each of 64 to 32,768 places, about one an element."""
    size = sets.size
    places = np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 6, 15)
    base = np.cumsum(places) - places
    doc = np.repeat(np.arange(len(size)), size)
    at = (mix(sets.elements ^ np.uint64(0x9D2C5680CAFEF00D)) & (places[doc] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(base[doc] + at, minlength=int(places.sum())) & 1).astype(np.uint8), bitorder="little")
    return [bits[a : a + n].tobytes() for a, n in zip(base // 8, places // 8, strict=True)]


def parity_links(sizes: np.ndarray, bits: list[bytes], measure: Measure) -> list[tuple[int, int]]:
    """Links that connect all sets of a group that their parities allow to be linked."""
    width = min(map(len, bits)) // 8
    rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), axis=0) for b in bits])
    links, rest = [], np.arange(1, len(bits))
    todo = [0]
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
            continue
        i = todo.pop()
        apart = np.bitwise_count(rows[rest] ^ rows[i]).sum(axis=1)
        near = apart <= (measure.den - measure.num) * (sizes[rest] + sizes[i]) // (measure.den + measure.num)
        found = rest[near].tolist()
        links += [(i, j) for j in found]
        todo += found
        rest = rest[~near]
    return links


def candidates(sets: DataFrame, nodes: DataFrame, measure: Measure, n: int, most: int = GROUP) -> DataFrame:
    """Edges (u, v) between nodes that connect all that may be linked.  sets: as ``described``; nodes: (node,
    rid) with one row of each node."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("signatures"))
            sig, key = data.view(np.uint64), np.repeat(np.asarray(batch.column("node")), np.diff(offsets) // 8)
            keys, blobs = [], []
            for bucket, arrays in split_by((sig % np.uint64(n)).astype(np.int32), sig, key):
                keys.append(bucket)
                blobs.append(pack(*arrays))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def groups(group: pa.Table) -> pa.Table:
        """Each set of nodes that share a signature, once; of a large one, edges to its smallest node."""
        sig, key = (np.concatenate(x) for x in zip(*[unpack(b, "u8", "i8") for b in group.column("blob").to_pylist()], strict=True))
        order = np.argsort(sig, kind="stable")
        a, z = runs(sig[order])
        order = order[np.repeat(z - a > 1, z - a)]
        sig, key = sig[order], key[order]
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])] if len(sig) else np.zeros(0, bool)
        sig, key = sig[new], key[new]
        a, z = runs(sig)
        a, z = a[z - a > 1], z[z - a > 1]
        label = np.array([], np.uint64)
        if len(a):
            total = np.r_[np.uint64(0), np.cumsum(mix(key.view(np.uint64)))]
            label = mix(total[z] - total[a] + mix((z - a).astype(np.uint64)))
            label, first = np.unique(label, return_index=True)
            a, z = a[first], z[first]
        large = z - a > most
        u = [key[i + 1 : j] for i, j in zip(a[large], z[large], strict=True)]
        v = [np.full(j - i - 1, key[i]) for i, j in zip(a[large], z[large], strict=True)]
        edges = np.concatenate([*u, np.zeros(0, np.int64)]), np.concatenate([*v, np.zeros(0, np.int64)])
        few = ~large
        none = pa.nulls(int(few.sum()), pa.int64())
        lists = pa.array([key[i:j] for i, j in zip(a[few], z[few], strict=True)], pa.list_(pa.int64()))
        k = len(edges[0])
        return pa.table(
            {
                "label": pa.concat_arrays([pa.array(_signed(label[few])), pa.nulls(k, pa.int64())]),
                "nodes": pa.concat_arrays([lists, pa.nulls(k, pa.list_(pa.int64()))]),
                "u": pa.concat_arrays([none, pa.array(edges[0])]),
                "v": pa.concat_arrays([none, pa.array(edges[1])]),
            }
        )

    def link(group: pa.Table) -> pa.Table:
        label, node, size = (np.asarray(group.column(c)) for c in ("label", "node", "n"))
        order = np.argsort(label, kind="stable")
        bits, out = group.column("bits").to_pylist(), []
        for a, z in zip(*runs(label[order]), strict=True):
            own = order[a:z]
            out += [(node[own[i]], node[own[j]]) for i, j in parity_links(size[own], [bits[i] for i in own], measure)]
        pairs = stars(np.array(out, np.int64).reshape(-1, 2))
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    shared = checkpoint(sets.select("node", "signatures").mapInArrow(tidy(emit), "bucket int, blob binary").groupBy("bucket").applyInArrow(tidy_group(groups), "label long, nodes array<long>, u long, v long"))
    some = shared.filter("label is not null").select("label", F.explode("nodes").alias("node")).distinct()
    members = some.join(nodes.select("node", "rid"), "node").join(sets.select("rid", "n", "bits"), "rid").select("label", "node", "n", "bits")
    linked = members.groupBy(F.pmod("label", F.lit(n)).alias("bucket")).applyInArrow(link, "u long, v long")
    return linked.union(shared.filter("u is not null").select("u", "v"))


# ---------------------------------------------------------------- joining a region
def shared(pivot: np.ndarray, elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Size of the intersection of ``pivot`` with each of several sets, none empty."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    hit = pivot[np.minimum(np.searchsorted(pivot, elements), len(pivot) - 1)] == elements
    return np.add.reduceat(hit.astype(np.int64), at[:-1])


def region_links(sets: list[np.ndarray], measure: Measure) -> list[tuple[int, int]]:
    """Links that connect what all links connect, found from pivots."""
    size = np.array([len(s) for s in sets])
    links: list[tuple[int, int]] = []

    def against(i: int, others: np.ndarray) -> np.ndarray:
        part = [sets[j] for j in others]
        return shared(sets[i], np.concatenate(part), np.r_[0, np.cumsum(size[others])]) if part else np.zeros(0, np.int64)

    rest = np.argsort(-size, kind="stable")
    while len(rest) > 1:
        pivot, rest = int(rest[0]), rest[1:]
        both = against(pivot, rest)
        distance = 1 - both / (size[rest] + size[pivot] - both)
        inside = measure.linked(both, size[rest], size[pivot])
        links += [(pivot, int(i)) for i in rest[inside]]
        near, d_near = rest[inside], distance[inside]
        reached = ~inside & (distance <= d_near.max(initial=-1) + measure.reach)  # the others' windows are empty
        for y, d in zip(rest[reached], distance[reached], strict=True):
            window = near[d_near >= d - measure.reach]
            window = window[(measure.den * np.minimum(size[window], size[y]) >= measure.num * np.maximum(size[window], size[y]))]
            if len(window):
                hit = measure.linked(against(int(y), window), size[window], size[y])
                links += [(int(i), int(y)) for i in window[hit][:1]]  # all of them are one class
        rest = rest[~inside]
    return links


_MEMBERS = "region long, node long, elements binary"


def _array(blob) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _join_small(members: DataFrame, measure: Measure) -> DataFrame:
    def work(group: pa.Table) -> pa.Table:
        node = np.asarray(group.column("node"))
        _, first = np.unique(node, return_index=True)
        blobs = group.column("elements")
        links = region_links([_array(blobs[int(i)].as_py()) for i in first], measure)
        pairs = stars(node[first][np.array(links, np.int64).reshape(-1, 2)])
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return members.groupBy("region").applyInArrow(tidy_group(work), "u long, v long")


def _salted(left: DataFrame, by_region: DataFrame, salts: int = 16) -> DataFrame:
    """Join with a table of one row a region; a large region is spread over several tasks."""
    copies = by_region.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(copies, ["region", "_salt"]).drop("_salt")


def _part(members: DataFrame, measure: Measure, turn: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi regions of several pivots: links found, and members of the regions that are left."""
    luck = F.xxhash64("node", F.lit(turn))
    picked = members.groupBy("region", F.pmod(luck, F.lit(PIVOTS)).alias("salt")).agg(F.min(F.struct(luck.alias("luck"), "node", "elements")).alias("p"))
    pivots = picked.groupBy("region").agg(F.collect_list("p").alias("pivots"))  # PIVOTS of them at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("region", "node", "elements", "pivot", "distance", "inside")}
            rows = zip(*(batch.column(c).to_pylist() for c in ("region", "node", "elements", "pivots")), strict=True)
            for region, node, blob, pivots in rows:
                own = _array(blob)
                sets = [_array(p["elements"]) for p in pivots]
                size = np.array([len(s) for s in sets])
                both = shared(own, np.concatenate(sets), np.r_[0, np.cumsum(size)])
                d = 1 - both / (size + len(own) - both)
                inside = measure.linked(both, size, np.int64(len(own)))
                for j in np.flatnonzero(d <= d.min() + 2 * measure.reach):
                    for c, v in zip(out, (region, node, blob, pivots[j]["node"], float(d[j]), bool(inside[j])), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["region"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["elements"], pa.binary()), pa.array(out["pivot"], pa.int64()), pa.array(out["distance"], pa.float64()), pa.array(out["inside"], pa.bool_())], list(out))

    placed = _salted(members, pivots).select("region", "node", "elements", "pivots").mapInArrow(tidy(place), "region long, node long, elements binary, pivot long, distance double, inside boolean")
    placed = checkpoint(placed.withColumn("region", F.xxhash64("region", "pivot", F.lit(turn))))
    links = placed.filter("inside and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    outside = placed.filter("not inside").groupBy("region").agg(F.min("distance").alias("edge"))
    # inside ones that no outside one can reach are done
    left = _salted(placed, outside).filter(f"not inside or distance >= edge - {measure.reach!r}")
    return links, left.select("region", "node", "elements")


def _pairs_of_blocks(members: DataFrame, sizes: DataFrame, limit: int, turn: int) -> DataFrame:
    """Each region as regions of two of its blocks, so that every pair of members meets."""
    blocks = F.ceil(2 * F.col("total") / F.lit(limit)).cast("int") + 1
    placed = members.join(sizes, "region").withColumn("k", blocks).withColumn("b", F.pmod(F.xxhash64("node", F.lit(-turn)), F.col("k")).cast("int"))
    other = placed.withColumn("o", F.explode(F.expr("sequence(0, k - 1)")))
    return other.select(F.xxhash64("region", F.least("b", "o"), F.greatest("b", "o"), F.lit(turn)).alias("region"), "node", "elements")


def jaccard_links(docs: DataFrame, sets: DataFrame, nodes: DataFrame, measure: Measure, n: int, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) between nodes that connect exactly what all links connect."""
    regions = checkpoint(components(candidates(sets, nodes, measure, n)))
    wanted = nodes.join(regions, "node").join(sets.select("rid", "doc_id", "h"), "rid").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "node", "root", "copies")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, own in _each_slice(batch, measure.shingle):
                part = batch.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("node"), _blobs(own.elements, np.repeat(np.arange(e - s), own.size), e - s)], ["region", "node", "elements"])

    keyed = docs.withColumn("h", F.xxhash64("text"))
    found = keyed.join(wanted, (keyed["h"] == wanted["_h"]) & keyed["doc_id"].eqNullSafe(wanted["_id"])).select("root", "node", "text", "copies")
    # rows that repeat id and text bring their node again; only nodes of many rows may have many of those
    few = found.filter("copies <= 16").drop("copies").mapInArrow(tidy(fetch), _MEMBERS)
    many = found.filter("copies > 16").dropDuplicates(["node"]).drop("copies").mapInArrow(tidy(fetch), _MEMBERS)
    members = checkpoint(few.union(many))
    links, turn, last = [], 0, None
    while True:
        sizes = members.groupBy("region").agg((F.sum(F.octet_length("elements")) / 8).alias("total"))
        large = checkpoint(sizes.filter(F.col("total") > limit))
        now = large.agg(F.sum("total")).first()[0]
        if not now:
            break
        links.append(_join_small(members.join(large, "region", "left_anti"), measure))
        members = members.join(large.select("region"), "region", "left_semi")
        if last is not None and now > 0.7 * last:
            members = checkpoint(_pairs_of_blocks(members, large, limit, turn))
            break
        found, members = _part(members, measure, turn)
        links.append(found)
        members, last, turn = checkpoint(members), now, turn + 1
    links.append(_join_small(members, measure))
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _joined(docs: DataFrame, measure: Measure, limit: int) -> tuple[DataFrame, DataFrame]:
    """(sets, (node, root, least): of each node its class and the smallest doc_id of its rows)."""
    sets = described(docs, measure)
    nodes = checkpoint(sets.filter("n > 0").groupBy("node").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = components(jaccard_links(docs, sets, nodes, measure, n_shards(docs), limit))
    return sets, nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")


def jaccard_classes(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are lower-cased (A-Z) and parted by white space.  A document of fewer words than a shingle
    has them all as one; one without words, or a null text, has no shingle, is linked with nothing and
    is its own component.  component_id is the smallest doc_id that links reach, ids that are null
    passed over (null if there is no other).  Repeated rows have equal sets and so one component.
    """
    sets, of = _joined(bare(docs), Measure(shingle, num, den), limit)
    # written, so that the join can split the members of one large component
    whole = checkpoint(of.groupBy("root").agg(F.min("least").alias("component_id")))
    of_node = of.join(whole, "root").select("node", "component_id")
    joined = sets.select("doc_id", "n", "node").join(of_node, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, whatever their columns, without all but one of each class.

    The row with the smallest doc_id stays (a null one counts as the largest), of equal ids that whose text
    has the smallest hash, and of rows that repeat both, one.  Rows without words stay, all of them.
    """
    sets, of = _joined(bare(docs), Measure(shingle, num, den), limit)
    rows = sets.filter("n > 0").select("doc_id", "h", "node").join(of.select("node", "root"), "node")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    first = checkpoint(rows.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h")))
    is_first = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    keys = rows.join(first, "root").withColumn("stays", is_first).groupBy("doc_id", "h", "stays").agg(F.count(F.lit(1)).alias("times"))
    marks = checkpoint(keys.filter("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("stays").alias("_once")))
    keyed = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    joined = keyed.join(marks, (F.col("_text") == F.col("_h")) & F.col("_own").eqNullSafe(F.col("_id")), "left")
    repeated = joined.filter("_once").dropDuplicates(["_own", "_text"])
    return joined.filter("_once is null").union(repeated).select(*columns_of(docs, {}))


def jaccard_query(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs, 3, 90, 100)
