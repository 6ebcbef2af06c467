"""Operator 8: language-model scores by logistic mixing of context bit predictors.

A token is coded in BITS binary decisions, the top bits of its hash, and then within the bucket that
they name.  Each decision is predicted in three contexts: none, the token before (hashed, its slots grow
with the input) and the class of the shortest of the last tokens, which tells languages apart.  A
predictor's logit comes from the counts of both outcomes in its context at the decision's node.

* Mixing: the logits are added with weights.  A gate, how often the token before has been seen, selects
  where they start; from there they follow each document as it is read.
* Refinement: the mixed logit of each decision is scaled by a factor that follows the document too.
* Within the bucket a token's share is its count there, drawn towards its count after the token before.

Counts come from all training documents.  Each task sends the tokens of its partition once; each shard
sends its distinct (token before, token) pairs, which are counted in buckets by context, and gets the
counts of its own pairs back.  Tokens so frequent that their followers would fill a bucket (a share of
1 / MANY or more, MANY at most) are parted by the first half of the follower's decisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import Words, bare, ids_column, ids_of, mix, n_shards, pack, runs, slices, split_by, text_buffer, tidy, tidy_group, unpack
from satchel.llm.shards import by_shard, from_ipc, packed
from satchel.plans.shared import checkpoint

BITS = 12
HALF = BITS // 2
REST = 16  # bits that tell apart tokens of one bucket after the same token
CLASSES = 64
MANY = 4096
RECENT = 8
BLOCK = 64  # tokens between two updates of a document's weights
RATE = 0.01
STEP = 0.4  # of the logits that go back to the shards
#: Weights at a document's start (no context, token before, class), by the gate: how many of GATES the
#: count of the token before reaches.
GATES = np.array([1, 4, 64])
START = ((0.1, 0.0, 0.9), (0.1, 0.3, 0.8), (0.1, 0.4, 0.7), (0.1, 0.7, 0.5))
REFINE = 0.002
SLICE = 1 << 19
PRIOR = 1.0  # tokens that the share within a bucket counts for in a context
END = np.uint64(0x9D39247E33776D41)
_SPLIT = np.uint64(0x9E3779B97F4A7C15)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, where each document's begin, length of each token); one END closes each."""
    words = Words(data, offsets, lower=True)
    counts = words.counts()
    at = np.r_[0, np.cumsum(counts + 1)]
    h = np.full(at[-1], END)
    size = np.full(at[-1], 255, np.int16)
    place = np.arange(len(words.hash)) + np.repeat(np.arange(len(counts)), counts)
    h[place], size[place] = words.hash, np.minimum(words.ends - words.starts, 255)
    return h, at, size


def contexts(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the token before, and class of the shortest of the last ones (the latest of equals)."""
    n = len(h)
    into = (np.arange(n) - np.repeat(at[:-1], np.diff(at))).astype(np.int32)
    before = np.zeros(n, np.uint64)
    before[1:] = h[:-1]
    before[into == 0] = 0
    # the length and, below it, how far back: the smallest is the shortest and the latest of those
    far = np.int16(1 << 14)
    best = np.full(n, far)
    for k in range(1, min(RECENT, n - 1) + 1):
        own = np.where(into[k:] >= k, size[: n - k] << 4 | k, far)
        np.minimum(best[k:], own, out=best[k:])
    has = np.flatnonzero(best < far)
    shortest = np.zeros(n, np.uint64)
    shortest[has] = h[has - (best[has] & 15)]
    return before, (mix(shortest ^ np.uint64(0x51ED270B)) % np.uint64(CLASSES)).astype(np.int32)


class Layout:
    """Keys of pairs: the slot of the context, the decisions, and bits of what is left of the token.  The
    slots are 2 ** 22 for each bucket, so that they grow with the input."""

    def __init__(self, n: int):
        self.n, self.slot_bits = n, min(22 + int(n - 1).bit_length(), 36)

    def key(self, context: np.ndarray, code: np.ndarray, rest: np.ndarray) -> np.ndarray:
        slot = context >> np.uint64(64 - self.slot_bits)
        return slot << np.uint64(BITS + REST) | code << np.uint64(REST) | rest

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """Rises with the key."""
        return ((key >> np.uint64(BITS + REST)) * np.uint64(self.n) >> np.uint64(self.slot_bits)).astype(np.int32)

    def pairs(self, h: np.ndarray, before: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, whether the token before is frequent).  The first len(h) keys are those of the tokens;
        after a frequent one they have only the second half of the decisions, under a slot of its own for
        the first half, and one more key for each such token, in order, has the first half."""
        code = h >> np.uint64(64 - BITS)
        first, second = code >> np.uint64(BITS - HALF), (code & np.uint64((1 << HALF) - 1)) << np.uint64(HALF)
        context, rest = mix(before), h & np.uint64((1 << REST) - 1)
        often = np.isin(before, frequent)
        own = self.key(np.where(often, mix(context + (first + np.uint64(1)) * _SPLIT), context), np.where(often, second, code), rest)
        zero = np.zeros(int(often.sum()), np.uint64)
        return np.concatenate([own, self.key(context[often], first[often] << np.uint64(HALF), zero)]), often


def _planes(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint8).reshape(-1, x.itemsize).T.reshape(-1)


def _from_planes(raw: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_pairs(key: np.ndarray, weight: np.ndarray) -> bytes:
    """Sorted keys as differences; the bytes of one weight lie together."""
    return pack(_planes(np.diff(key, prepend=np.uint64(0))), _planes(weight.astype(np.uint32)))


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = unpack(blob, "u1")[0]
    n = len(raw) // 12
    return np.cumsum(_from_planes(raw[: 8 * n], np.uint64), dtype=np.uint64), _from_planes(raw[8 * n :], np.uint32)


NODES = BITS + 2  # a context, the nodes after each decision, the token


def node_counts(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each pair of a bucket, given once by each shard that has it: the counts of its context, of the
    nodes on the way to its bucket of tokens, and of itself."""
    order = np.argsort(key, kind="stable")
    key, total = key[order], np.r_[0, np.cumsum(weight[order].astype(np.int64))]
    out = np.empty((NODES, len(key)), np.int64)
    for k in range(NODES):
        node = key >> np.uint64(REST + BITS - k) if k <= BITS else key
        at = np.r_[np.flatnonzero(np.r_[True, node[1:] != node[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
        out[k, order] = np.repeat(np.diff(total[at]), np.diff(at))
    return out


def odds(counts: np.ndarray) -> np.ndarray:
    """Logits of the outcomes taken, from counts of the nodes on the way."""
    taken = counts[1:].astype(np.float32)
    return np.log((taken + np.float32(0.4)) / ((counts[:-1] - counts[1:]).astype(np.float32) + np.float32(0.4)))


def pack_counts(counts: np.ndarray) -> bytes:
    """What a shard gets of its pairs: the logits of the decisions in steps of STEP (rounding is the same for
    either outcome, so they still add up to 1), the gate, and the counts of the bucket and of the token,
    a byte each and whole where they exceed it."""
    logits = np.clip(np.round(odds(counts[: BITS + 1]) / np.float32(STEP)), -127, 127).astype(np.int8)
    gate = np.searchsorted(GATES, counts[:1], "right").astype(np.uint8)
    last = counts[BITS:]
    small = pack(np.concatenate([logits.view(np.uint8), gate, np.minimum(last, 255).astype(np.uint8)]))
    return len(small).to_bytes(8, "little") + small + pack(last[last >= 255])


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits in steps, gates, counts of bucket and token)"""
    cut = 8 + int.from_bytes(blob[:8], "little")
    rows = unpack(blob[8:cut], "u1")[0].reshape(BITS + 3, -1)
    last = rows[BITS + 1 :].astype(np.int64)
    last[last == 255] = unpack(blob[cut:], "i8")[0]
    return rows[:BITS].view(np.int8), rows[BITS], last


def each_slice(table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(table.column("text"))
    for s, e in slices(np.diff(offsets), SLICE):
        yield s, e, *tokens_of(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])


def added(h: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sums of their numbers."""
    h, c = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, np.uint64), (c, np.int64)))
    order = np.argsort(h)
    h, c = h[order], c[order]
    a, _ = runs(h)
    return h[a], np.add.reduceat(c, a) if len(a) else c


# ---------------------------------------------------------------- what is gathered from the corpus
def vocabulary(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training tokens and types of each code, training tokens of each class and code, and the hashes of the
    frequent tokens, sorted: all of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, counts, waiting = [], [], 0
        table = np.zeros(CLASSES << BITS, np.int64)
        for batch in batches:
            held = np.asarray(batch.column("held"))
            for s, e, h, at, size in each_slice(batch):
                use = np.repeat(~held[s:e], np.diff(at))
                _, own = contexts(h, at, size)
                table += np.bincount(own[use] << BITS | (h[use] >> np.uint64(64 - BITS)).astype(np.int32), minlength=len(table))
                k, c = added([h[use]], [np.ones(int(use.sum()), np.int64)])
                kinds.append(k)
                counts.append(c)
                waiting += len(k)
                if waiting > 1 << 22:
                    k, c = added(kinds, counts)
                    kinds, counts, waiting = [k], [c], 0
        h, c = added(kinds, counts)
        keys, blobs = [], []
        for key, arrays in split_by(((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32), h, c):
            keys.append(key)
            blobs.append(pack(*arrays))
        for k, row in enumerate(table.reshape(CLASSES, -1)):
            if row.any():
                keys.append(-1 - k)
                blobs.append(pack(row))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    names = ("code", "types", "tokens", "frequent", "class", "blob")

    def total(group: pa.Table) -> pa.Table:
        bucket, blobs = group.column("bucket")[0].as_py(), group.column("blob").to_pylist()
        columns: dict[str, list] = {c: [] for c in names}
        if bucket < 0:
            whole = np.zeros(1 << BITS, np.int64)
            for b in blobs:
                whole += unpack(b, "i8")[0]
            rows = [(None, None, None, None, -1 - bucket, pack(whole))]
        else:
            h, c = added(*zip(*(unpack(b, "u8", "i8") for b in blobs), strict=True))
            code = (h >> np.uint64(64 - BITS)).astype(np.int64)
            a, z = runs(code)
            rows = [(int(code[i]), int(j - i), int(c[i:j].sum()), None, None, None) for i, j in zip(a, z, strict=True)]
            often = np.flatnonzero(c * MANY >= c.sum())
            rows += [(None, None, int(x), int(y), None, None) for x, y in zip(c[often], h.view(np.int64)[often], strict=True)]
        for row in rows:
            for name, v in zip(names, row, strict=True):
                columns[name].append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({c: pa.array(columns[c], k) for c, k in zip(names, kinds, strict=True)})

    sent = docs.mapInArrow(tidy(count), "bucket int, blob binary").groupBy("bucket")
    summed = checkpoint(sent.applyInArrow(tidy_group(total), "code int, types long, tokens long, frequent long, class int, blob binary"))
    tokens, types, table = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), np.zeros((CLASSES, 1 << BITS), np.int64)
    for r in summed.filter("code is not null").groupBy("code").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect():  # 2 ** BITS rows at most
        tokens[r.code], types[r.code] = r.tokens, r.types
    for r in summed.filter("class is not null").select("class", "blob").collect():  # CLASSES rows at most
        table[r["class"]] = unpack(bytes(r.blob), "i8")[0]
    often = summed.filter("frequent is not null").filter(F.col("tokens") * MANY >= int(tokens.sum())).orderBy(F.desc("tokens"), "frequent").limit(MANY)
    frequent = np.array(sorted(r.frequent for r in often.select("frequent").collect()), np.int64).view(np.uint64)
    return tokens, types, table, np.sort(frequent)


class Shard:
    """The distinct tokens and pairs of a shard's texts, in an order that the texts alone decide."""

    def __init__(self, table: pa.Table, layout: Layout, frequent: np.ndarray):
        self.held = np.asarray(table.column("held"))
        self.parts, keys, self.layout = [], [], layout
        for s, e, h, at, size in each_slice(table):
            before, own = contexts(h, at, size)
            key, often = layout.pairs(h, before, frequent)
            self.parts.append((s, e, h, at, own, often))
            keys.append(key)
        self.key = np.concatenate(keys)
        self.order = np.argsort(self.key, kind="stable")
        self.starts, _ = runs(self.key[self.order])
        self.pairs = self.key[self.order][self.starts]
        self.kinds, self.kind = np.unique(np.concatenate([p[2] for p in self.parts]), return_inverse=True)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Training tokens of each distinct token and of each distinct pair."""
        own, pairs = [], []
        for s, e, _, at, _, often in self.parts:
            use = np.repeat(~self.held[s:e], np.diff(at))
            own.append(use)
            pairs += [use, use[often]]
        return np.bincount(self.kind, np.concatenate(own), len(self.kinds)).astype(np.int64), np.add.reduceat(np.concatenate(pairs)[self.order].astype(np.int64), self.starts)

    def places(self) -> np.ndarray:
        """Of each key, the number among the distinct pairs."""
        new = np.zeros(len(self.order), np.int32)
        new[self.starts[1:]] = 1
        out = np.empty(len(self.order), np.int32)
        out[self.order] = np.cumsum(new, dtype=np.int32)
        return out


def counts_by_shard(docs: DataFrame, layout: Layout, frequent: np.ndarray) -> DataFrame:
    """(shard, bucket, blob of the counts of the shard's tokens in the bucket, pairs: blob of those of its
    pairs), each in the order of the shard's distinct ones."""
    n = layout.n
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def own(group: pa.Table) -> pa.Table:
        shard, number = Shard(from_ipc(group.column("rows").to_pylist()), layout, shared.value), group.column("shard")[0].as_py()
        c, w = shard.weights()
        tokens = {key: pack(*arrays) for key, arrays in split_by((shard.kinds % np.uint64(n)).astype(np.int32), shard.kinds, c)}
        pairs = {key: pack_pairs(*arrays) for key, arrays in split_by(layout.bucket(shard.pairs), shard.pairs, w)}
        keys = sorted({*tokens, *pairs})
        columns = {"blob": [tokens.get(k, pack(c[:0], c[:0])) for k in keys], "pairs": [pairs.get(k, pack()) for k in keys]}
        return pa.table({"bucket": pa.array(keys, pa.int32()), "shard": pa.array([number] * len(keys), pa.int32()), **{k: pa.array(x, pa.binary()) for k, x in columns.items()}})

    def total(group: pa.Table) -> pa.Table:
        parts = [unpack(b, "u8", "i8") for b in group.column("blob").to_pylist()]
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, of = np.unique(h, return_inverse=True)
        sums = np.bincount(of, c) if len(of) else np.zeros(0)
        cuts = np.cumsum([0, *(len(x) for x, _ in parts)])
        blobs = [pack(sums[of[s:e]].astype(np.int64)) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        pairs = [unpack_pairs(b) for b in group.column("pairs").to_pylist()]
        cuts = np.cumsum([0, *(len(p[0]) for p in pairs)])
        counts = node_counts(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        return pa.table(
            {
                "shard": group.column("shard"),
                "bucket": group.column("bucket"),
                "blob": pa.array(blobs, pa.binary()),
                "pairs": pa.array([pack_counts(counts[:, s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    counted = packed(docs, n).groupBy("shard").applyInArrow(tidy_group(own), "bucket int, shard int, blob binary, pairs binary")
    return counted.groupBy("bucket").applyInArrow(tidy_group(total), "shard int, bucket int, blob binary, pairs binary")


# ---------------------------------------------------------------- scoring
def paths(tokens: np.ndarray) -> np.ndarray:
    """Of each code, the counts of the nodes on the way to it, along the last axis of ``tokens``."""
    size = tokens.shape[-1]
    nodes = [tokens.reshape(*tokens.shape[:-1], 1 << b, -1).sum(axis=-1) for b in range(BITS + 1)]
    return np.stack([np.repeat(x, size // x.shape[-1], axis=-1) for x in nodes])


class Mixer:
    """Logits of the predictors, and the loss of tokens as weights follow each document."""

    def __init__(self, tokens: np.ndarray, types: np.ndarray, table: np.ndarray):
        #: Of each code: logits of its decisions without context, and in each class.
        self.table = odds(paths(tokens))
        self.classes = odds(paths(table)).reshape(BITS, -1)
        self.in_bucket = tokens.astype(float) + 0.5 * (types + 1)

    def code_bits(self, code: np.ndarray, at: np.ndarray, own: np.ndarray, before: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Bits that each token's decisions take.

        code, own (class), gate: of each token; before: of each decision and token, the logit after the
        token before, in steps.  Blocks of a document are read in turn, those of all documents side by side.
        """
        counts = np.diff(at)
        blocks = -(-counts // BLOCK)
        doc = np.repeat(np.arange(len(counts)), blocks)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        order = np.argsort(step, kind="stable")
        doc, step = doc[order], step[order]
        token = (at[doc] + step * BLOCK)[:, None] + np.arange(BLOCK)
        real = token < at[doc + 1][:, None]
        token[~real] = 0
        codes, cell, start = code[token], (own[token] << BITS) | code[token], np.array(START, np.float32).T[:, gate[token]]
        x = np.empty((3, BITS, *token.shape), np.float32)
        for b in range(BITS):
            np.take(self.table[b], codes, out=x[0, b])
            x[1, b] = before[b][token]
            np.take(self.classes[b], cell, out=x[2, b])
        x[1] *= np.float32(STEP)
        x *= real
        drift = np.zeros((3, BITS, len(counts)), np.float32)  # of the weights, since the document's start
        scale = np.ones((BITS, len(counts)), np.float32)
        loss = np.empty(token.shape, np.float32)
        for a, z in zip(*runs(step), strict=True):
            own_x, d = x[:, :, a:z], doc[a:z]
            w = drift[:, :, d]
            mixed = (start[0, a:z] + w[0, ..., None]) * own_x[0]
            for k in (1, 2):
                mixed += (start[k, a:z] + w[k, ..., None]) * own_x[k]
            s = scale[:, d]
            odds = mixed * -s[..., None]
            np.exp(np.minimum(odds, np.float32(30), out=odds), out=odds)
            loss[a:z] = np.log1p(odds).sum(axis=0)
            odds /= 1 + odds  # 1 - what the outcome was given
            drift[:, :, d] = w + np.float32(RATE) * np.einsum("kbnj,bnj->kbn", own_x, odds)
            scale[:, d] = np.clip(s + np.float32(REFINE) * np.einsum("bnj,bnj->bn", mixed, odds), 0.25, 4)
        bits = np.empty(len(code), np.float32)
        bits[token[real]] = loss[real]
        return bits / np.float32(np.log(2))

    def log10(self, h: np.ndarray, at: np.ndarray, own: np.ndarray, often: np.ndarray, count: np.ndarray, place: np.ndarray, logits: np.ndarray, gate: np.ndarray, last: np.ndarray) -> np.ndarray:
        code = (h >> np.uint64(64 - BITS)).astype(np.int64)
        second = place[: len(h)]
        first = second.copy()
        first[often] = place[len(h) :]
        before = np.concatenate([logits[:HALF, first], logits[HALF:, second]])
        # after a frequent token the second half has a slot of its own
        before[HALF:, often] = logits[:HALF, second[often]]
        share = (count + 0.5) / self.in_bucket[code]
        share = (last[1, second] + PRIOR * share) / (last[0, second] + PRIOR)
        return np.log10(share) - self.code_bits(code, at, own, before, gate[first]) * np.log10(2)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Training documents are those that are not held out; an id that is null is not.  A null or empty
    text is its END alone.  Rows count once each, repeated ones too; without training documents every
    token is unknown.  As in base_score, the tokens of a bucket that no training document has count as one
    type.  bits_per_byte is null where there are no bytes.  Tokens are told apart by 64-bit hashes.
    """
    docs = bare(docs)
    n = n_shards(docs)
    layout, marked = Layout(n), docs.withColumn("held", held_out())
    tokens, types, table, frequent = vocabulary(marked, n)
    counts = counts_by_shard(marked, layout, frequent)
    N, V = int(tokens.sum()), int(types.sum())
    shared = docs.sparkSession.sparkContext.broadcast((Mixer(tokens, types, table), frequent))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    floor = np.log10(N + 0.5 * (V + 1))

    def score(table: pa.Table, right: pa.Table) -> pa.Table:
        model, often = shared.value
        shard, size = Shard(table, layout, often), np.diff(text_buffer(table.column("text"))[1])
        out: list[list] = [[], [], [], []]
        c = np.empty(len(shard.kinds), np.int64)
        back = dict(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True))
        for bucket, (where,) in split_by((shard.kinds % np.uint64(n)).astype(np.int32), np.arange(len(shard.kinds))):
            c[where] = unpack(back[bucket], "i8")[0]
        back = dict(zip(right.column("bucket").to_pylist(), right.column("pairs").to_pylist(), strict=True))
        got = [unpack_counts(back[bucket]) for bucket in np.unique(layout.bucket(shard.pairs)).tolist()]
        model_of = [np.concatenate(x, axis=-1) for x in zip(*got, strict=True)]
        places, count = shard.places(), c[shard.kind]
        t = k = 0
        for _, _, h, at, own, often in shard.parts:
            has, place = count[t : t + len(h)], places[k : k + len(h) + int(often.sum())]
            t, k = t + len(h), k + len(place)
            sums = [np.add.reduceat(x, at[:-1]) for x in ((has > 0).astype(np.int64), np.log10(has + 0.5) - floor, model.log10(h, at, own, often, has, place, *model_of))]
            for column, x in zip(out, (np.diff(at), *sums), strict=True):
                column += x.tolist()
        bits = np.array(out[3]) / -np.log10(2)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        n_tokens, n_known, base, total = (pa.array(x, t) for x, t in zip(out, kinds, strict=True))
        return pa.table(
            {
                "doc_id": ids_column(ids_of(table.column("doc_id"))),
                "held_out": pa.array(shard.held, pa.bool_()),
                "n_tokens": n_tokens,
                "n_known": n_known,
                "train_tokens": pa.array(np.full(len(size), N), pa.int64()),
                "base_score": base,
                "score": total,
                "bits_per_byte": pa.array(bits / np.maximum(size, 1), pa.float64(), mask=size == 0),
            }
        )

    return by_shard(marked, counts, n, score, schema)
