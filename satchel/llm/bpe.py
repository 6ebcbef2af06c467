"""Operators 9 and 10: exact token counts and byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import heapq
import json
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from satchel.llm.common import BYTE_HASH, Rolling, bare, default_tokenizer_path, sha256, tidy, tidy_group

#: The public pattern that cuts a text into pre-tokens, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES, _BLANK = regex.compile(PATTERN), regex.compile(r"\s+")
#: Entries of a generation of pre-tokens that a worker has met.  It keeps two: what a full one has is found
#: again while the next fills, so pre-tokens that come back stay.
CACHE = 300_000
#: The same, of those encoded.
ENCODED = 200_000
#: Texts that a worker takes at once.
AT_ONCE = 256
_NEVER, _NONE = 1 << 60, np.int32((1 << 31) - 1)
_LAST = itemgetter(-1)


def merged(piece: bytes, rank: Callable[[bytes, bytes], int]) -> list[bytes]:
    """The parts of ``piece`` after all merges, lowest rank first and leftmost of equals."""
    n = len(piece)
    if n < 2:
        return [piece] if n else []
    if n <= 64:
        parts = [piece[i : i + 1] for i in range(n)]
        ranks = [*map(rank, parts, parts[1:]), _NEVER]
        while (low := min(ranks)) < _NEVER:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i + 1 < len(parts):
                ranks[i] = rank(parts[i], parts[i + 1])
            else:
                ranks[i] = _NEVER
            if i:
                ranks[i - 1] = rank(parts[i - 1], parts[i])
        return parts
    ends, right, left = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    part = lambda i: piece[i : ends[i]]
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(part(i), part(i + 1))) < _NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if ends[i] != j or right[i] != j or ends[j] != end:
            continue
        ends[i], right[i] = end, right[j]
        ends[j] = -1
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := rank(part(a), part(b))) < _NEVER:
                heapq.heappush(heap, (r, a, b, ends[b]))
    out, i = [], 0
    while i < n:
        out.append(part(i))
        i = right[i]
    return out


def recalled(texts: list[list[str | None]], known: dict, before: dict) -> set[str]:
    """The pre-tokens of some texts that are not known; those of the generation before become known again."""
    new = set().union(*texts).difference(known)
    old = {p: before[p] for p in new if p in before}
    known.update(old)
    return new.difference(old)


# ---------------------------------------------------------------- operator 9
def _slot(pair: np.ndarray) -> np.ndarray:
    """Where of 2^21 slots a pair of numbers of tokens is kept."""
    return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)


def _byte_letters() -> dict[str, int]:
    """The letters in which vocabulary files of byte-level BPE write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of every prefix of a text, by dynamic programming.

    The encoding of a prefix is the encoding of a shorter prefix and one last token; which token that
    is follows from whether it can stand next to the shorter prefix's own last token.  So each position of
    a pre-token has the length of its last token and a count.  Counts are kept for every prefix of the
    pre-tokens met, and a text's for every pre-token's end: truncation and budgets look them up.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [(raw(a), raw(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.tokens = {raw(t) for t in spec["model"]["vocab"]}
        self.longest = max(map(len, self.tokens))
        #: The merge that first makes a token: its number and parts.
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for i, (a, b) in enumerate(pairs):
            self.made.setdefault(a + b, (i, a, b))
        special = sorted((t["content"] for t in spec.get("added_tokens") or [] if t.get("special")), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.names = sorted(self.tokens)
        ends = np.cumsum([len(x) for x in self.names])
        h = Rolling(BYTE_HASH[np.frombuffer(b"".join(self.names), np.uint8)]).of(np.r_[0, ends[:-1]], ends)
        order = np.argsort(h)
        self.hashes, self.names = h[order], [self.names[i] for i in order.tolist()]
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(h >> np.uint64(44)).astype(np.int64)] = True
        self.letters = np.frombuffer(b"".join(self.names), np.uint8)
        self.sizes = np.array([len(x) for x in self.names])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        #: Pairs of numbers of tokens, one in a slot, and whether they fit.
        self.pairs, self.pair_fits = np.full(1 << 21, -1), np.zeros(1 << 21, bool)
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str | None, bytes | tuple[int, ...]] = {None: b"\0\1"}
        self.before: dict[str | None, bytes | tuple[int, ...]] = {}

    def rank(self, a: bytes, b: bytes) -> int:
        return self.ranks.get((a, b), _NEVER)

    def alone(self, token: bytes) -> bool:
        """Whether the encoding of the token's bytes is the token."""
        return merged(token, self.rank) == [token]

    def fit(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a + b is a, b; a is empty at the start."""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= 4 * CACHE:
                self.fits.clear()
            known = self.fits[a, b] = self._apart(a, b) if a else self.alone(b)
        return known

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether no merge joins a's end with b's beginning before both are made.

        The parts that meet at the border only grow: going back from whole tokens, the one that was made
        last is taken apart, and two neighbours must not have a merge of their own that comes before.
        """
        left, right = a, b
        before = _NEVER  # the number of the merge that ended this state of the border
        while True:
            if self.ranks.get((left, right), _NEVER) < before:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is None and made_right is None:
                return True
            # of two equal merges the one on the left happens first
            if made_right is None or (made_left is not None and made_left[0] > made_right[0]):
                before, left = made_left[0], made_left[2]
            else:
                # a merge across the border stands left of this one and wins against an equal number
                before, right = made_right[0] + 1, made_right[1]

    def prefixes(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of a pre-token, from the empty one."""
        last, count, tokens, fits = [b""], [0], self.tokens, self.fits
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in tokens:
                    ok = fits.get((last[start], token))
                    if ok or (ok is None and self.fit(last[start], token)):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece[:40]!r}")
        return count

    def _ends_at(self, data: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens that end at each byte of some pre-tokens: (starts in the pre-token, tokens), the longest
        token first, and where those of each byte begin."""
        end, first = np.arange(1, len(data) + 1), np.repeat(base, size)
        reach = np.minimum(end - first, self.longest)
        starts = np.repeat(end - reach, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        ends = np.repeat(end, reach)
        h = Rolling(BYTE_HASH[data]).of(starts, ends)
        maybe = np.flatnonzero(self.likely[(h >> np.uint64(44)).astype(np.int64)])
        h, starts, ends = h[maybe], starts[maybe], ends[maybe]
        token = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[token] == h) & (self.sizes[token] == ends - starts))
        starts, ends, token = starts[hit], ends[hit], token[hit]
        # the bytes decide
        n = self.sizes[token]
        into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(starts, n) + into] != self.letters[np.repeat(self.offsets[token], n) + into]
        if differ.any():
            same = np.ones(len(token), bool)
            same[np.repeat(np.arange(len(token)), n)[differ]] = False
            starts, ends, token = starts[same], ends[same], token[same]
        return starts - first[ends - 1], token.astype(np.int64), np.searchsorted(ends, np.arange(1, len(data) + 2))

    def _fit_all(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``fit`` of many pairs of numbers of tokens, -1 for the start."""
        key = (before + 1) << 32 | token
        slot = _slot(key)
        ok, new = self.pair_fits[slot], np.flatnonzero(self.pairs[slot] != key)
        if len(new):
            kinds, of = np.unique(key[new], return_inverse=True)
            names = self.names
            found = np.array([self._apart(names[(k >> 32) - 1], names[k & 0xFFFFFFFF]) if k >> 32 else self.alone(names[k]) for k in kinds.tolist()])
            ok[new] = found[of]
            slot, at = np.unique(_slot(kinds), return_index=True)
            self.pairs[slot], self.pair_fits[slot] = kinds[at], found[at]
        return ok

    def all_prefixes(self, pieces: list[bytes]) -> list[list[int]]:
        """``prefixes`` of many short pre-tokens, position by position side by side."""
        size = np.array([len(p) for p in pieces])
        base, width = np.cumsum(size) - size, int(size.max(initial=0))
        starts, token, cuts = self._ends_at(np.frombuffer(b"".join(pieces), np.uint8), base, size)
        last, count = np.full((len(pieces), width + 1), -1, np.int64), np.zeros((len(pieces), width + 1), np.int64)
        for end in range(1, width + 1):
            todo = np.flatnonzero(size >= end)
            at, stop = cuts[base[todo] + end - 1], cuts[base[todo] + end]
            while len(todo):
                if (at >= stop).any():
                    raise ValueError(f"no token ends at byte {end} of {pieces[int(todo[np.argmax(at >= stop)])]!r}")
                start, own = starts[at], token[at]
                ok = self._fit_all(last[todo, start], own)
                row = todo[ok]
                last[row, end], count[row, end] = own[ok], count[row, start[ok]] + 1
                todo, at, stop = todo[~ok], at[~ok] + 1, stop[~ok]
        return [c[: n + 1] for c, n in zip(count.tolist(), size.tolist(), strict=True)]

    def _keep(self, piece: str, counts: list[int]) -> bytes | tuple[int, ...]:
        kept = self.known[piece] = bytes(counts) if counts[-1] < 256 else tuple(counts)
        return kept

    def learn(self, texts: list[list[str | None]]) -> None:
        """Keeps the counts of all pre-tokens of some texts."""
        if len(self.known) >= CACHE:
            self.known, self.before = {None: self.known[None]}, self.known
        new = sorted(recalled(texts, self.known, self.before), key=len)
        raw = [p.encode() for p in new]
        short = [i for i, b in enumerate(raw) if len(b) <= 48]
        for s in range(0, len(short), 8192):
            part = short[s : s + 8192]
            for i, counts in zip(part, self.all_prefixes([raw[i] for i in part]), strict=True):
                self._keep(new[i], counts)
        for p, b in zip(new, raw, strict=True):
            if len(b) > 48:
                self._keep(p, self.prefixes(b))

    def counts_of(self, piece: str | None) -> bytes | tuple[int, ...]:
        """``prefixes`` of a pre-token, kept; a special token counts as one."""
        if (counts := self.known.get(piece)) is None:
            counts = self._keep(piece, self.prefixes(piece.encode()))
        return counts

    def pieces(self, text: str) -> list[str | None]:
        """Pre-tokens; None stands for a special token."""
        if self.special is None or not self.special.search(text):
            return _PIECES.findall(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [*_PIECES.findall(text[at : m.start()]), None]
            at = m.end()
        return parts + _PIECES.findall(text[at:])

    def each(self, texts: list[str | None]) -> Iterator[tuple[str, list[str | None]]]:
        """Texts and their pre-tokens, whose counts are known then; a null text is empty."""
        for s in range(0, len(texts), AT_ONCE):
            part = [t or "" for t in texts[s : s + AT_ONCE]]
            cut = [self.pieces(t) for t in part]
            self.learn(cut)
            yield from zip(part, cut, strict=True)

    def running(self, pieces: list[str | None]) -> list[int]:
        """Tokens up to the end of each pre-token."""
        try:
            return list(accumulate(map(_LAST, map(self.known.__getitem__, pieces))))
        except KeyError:  # not learnt yet
            return list(accumulate(map(_LAST, map(self.counts_of, pieces))))

    def count(self, text: str) -> int:
        return sum(map(_LAST, map(self.counts_of, self.pieces(text))))

    def ends(self, text: str, pieces: list[str | None]) -> list[int]:
        """Where each pre-token ends."""
        special = iter([len(m.group()) for m in self.special.finditer(text)] if self.special and None in pieces else [])
        return list(accumulate([next(special) if p is None else len(p) for p in pieces]))

    def cut(self, text: str, budget: int, pieces: list[str | None] | None = None, running: list[int] | None = None) -> int:
        """Characters of the longest prefix whose own encoding stays within ``budget``.

        A prefix that ends inside a pre-token has the counts kept for that, but where the cut changes how
        the end is parted: among blanks, and inside a contraction.  A special token is whole or not there.
        """
        pieces = self.pieces(text) if pieces is None else pieces
        running = self.running(pieces) if running is None else running
        i = bisect_right(running, budget)
        ends = self.ends(text, pieces[:i])
        at = ends[i - 1] if i else 0
        if i == len(pieces) or pieces[i] is None:
            return at
        piece, used, best, size = pieces[i], running[i - 1] if i else 0, 0, 0
        if run := _BLANK.match(text, at):
            # a prefix that ends in blanks has all of them as one pre-token
            j = i
            while j and pieces[j - 1] is not None and _BLANK.fullmatch(pieces[j - 1]):
                j -= 1
            base, start = running[j - 1] if j else 0, ends[j - 1] if j else 0
            counts, size = self.counts_of(text[start : run.end()]), len(text[start:at].encode())
            for k, c in enumerate(run.group(), 1):
                size += len(c.encode())
                if base + counts[size] <= budget:
                    best = k
        counts, size = self.counts_of(piece), 0
        for k, c in enumerate(piece[:-1], 1):
            size += len(c.encode())
            if not _BLANK.match(c):
                n = self.count(piece[:k]) if piece[0] == "'" else counts[size]
                best = max(best, k) if used + n <= budget else best
        return at + best


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ends array<int>, counts array<int>: where each pre-token ends, in characters, and the exact
    number of tokens up to there.  Written, it answers any budget (``within``) without another encoding.
    A null or empty text has empty arrays; repeated rows have theirs each."""
    path = path or default_tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            ends, counts = [], []
            for text, pieces in counter.each(batch.column("text").to_pylist()):
                ends.append(counter.ends(text, pieces))
                counts.append(counter.running(pieces))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends, kind), pa.array(counts, kind)], ["doc_id", "ends", "counts"])

    return bare(docs).mapInArrow(tidy(count), "doc_id long, ends array<int>, counts array<int>")


def within(prefixes: DataFrame, budget: int) -> DataFrame:
    """Adds kept_tokens and kept_chars, the most whole pre-tokens that ``budget`` tokens hold, to a table of
    ``prefix_counts``."""
    n = F.size(F.filter("counts", lambda c: c <= budget))
    at = lambda c: F.when(n == 0, 0).otherwise(F.get(c, n - 1))
    return prefixes.withColumns({"kept_tokens": at("counts"), "kept_chars": at("ends")})


def token_counts(docs: DataFrame, path: str | None = None, budget: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and kept_chars (the longest prefix within ``budget``).

    A null text is empty: no bytes, no tokens.  Every row has its result, repeated rows too; a text
    of any length is counted whole.
    """
    path = path or default_tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            sizes, tokens, kept = [], [], []
            for text, pieces in counter.each(batch.column("text").to_pylist()):
                running = counter.running(pieces)
                n = running[-1] if running else 0
                sizes.append(len(text.encode()))
                tokens.append(n)
                kept.append(len(text) if n <= budget else counter.cut(text, budget, pieces, running))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > budget for n in tokens], pa.bool_()), pa.array(kept, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"],
            )

    return bare(docs).mapInArrow(tidy(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")


# ---------------------------------------------------------------- operator 10
def chunk_pieces(chunk: str, is_last: bool) -> list[str]:
    """A chunk's pre-tokens, but for the last two, which may change with what follows."""
    found = _PIECES.findall(chunk)
    return found if is_last else found[:-2]


def stitch(text: str, chunks: Iterable[tuple[int, list[str]]]) -> list[str]:
    """Pre-tokens of ``text`` from those of its overlapping chunks, each with where it starts.

    What follows a boundary depends on nothing before it, so from the first boundary that two neighbours
    share the later chunk is right; where they share none, pre-tokens are matched on until one is.
    """
    out, at = [], 0
    for start, own in chunks:
        end, i = start, 0
        while end != at:
            if end < at:
                if i == len(own):
                    break
                end += len(own[i])
                i += 1
            else:
                out.append(_PIECES.match(text, at).group())
                at += len(out[-1])
        else:
            rest = own[i:] if i else own
            out += rest
            at += sum(map(len, rest))
    while at < len(text):
        out.append(_PIECES.match(text, at).group())
        at += len(out[-1])
    return out


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.decimals = {r: str(r) for r in self.bytes_of}
        #: The ids of pre-tokens, as the bytes of their int32.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        pairs = {}
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = r
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged_to = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def rank(self, a: bytes, b: bytes) -> int:
        return self.ranks.get(a + b, _NEVER)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.merged_to[at], _NONE)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as bytes, of many short pre-tokens, merged side by side: each turn takes the lowest rank of each,
        leftmost of equals."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max(initial=1))
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        row = np.repeat(np.arange(len(pieces)), size)
        ids[row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        out = [b""] * len(pieces)
        left, cols = np.arange(len(pieces)), np.arange(width + 1)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(left)), at]
            done = best == _NONE
            if done.any():
                n = size[done]
                found, ends = ids[done][cols < n[:, None]].tobytes(), 4 * np.cumsum(n)
                for i, a, z in zip(left[done].tolist(), (ends - 4 * n).tolist(), ends.tolist(), strict=True):
                    out[i] = found[a:z]
                keep = ~done
                left, ids, ranks, size, at, best = left[keep], ids[keep], ranks[keep], size[keep], at[keep], best[keep]
            if not len(left):
                return out
            k = np.arange(len(left))
            ids[k, at] = best
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > at[:, None]), width), axis=1)
            ids[:, width] = -1
            size = size - 1
            ranks = np.take_along_axis(ranks, np.minimum(cols[:-1] + (cols[:-1] >= at[:, None]), width - 1), axis=1)
            ranks[:, width - 1] = _NONE
            ranks[k, at] = self._pair_ranks(best, ids[k, at + 1])
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self._pair_ranks(ids[has, at[has] - 1], best[has])

    def learn(self, texts: list[list[str]]) -> None:
        """Keeps the ids of all pre-tokens of some texts."""
        if len(self.known) >= ENCODED:
            self.known, self.before = {}, self.known
        new = sorted(recalled(texts, self.known, self.before), key=len)
        raw, short = [p.encode() for p in new], []
        for i, b in enumerate(raw):
            if (r := self.ranks.get(b)) is not None:
                self.known[new[i]] = np.int32(r).tobytes()
            elif len(b) <= 48:
                short.append(i)
            else:
                self.known[new[i]] = np.array([self.ranks[p] for p in merged(b, self.rank)], np.int32).tobytes()
        for s in range(0, len(short), 4096):  # of about equal length
            part = short[s : s + 4096]
            self.known.update(zip([new[i] for i in part], self.merge_all([raw[i] for i in part]), strict=True))

    def ids(self, pieces: list[str]) -> np.ndarray:
        """The ids of a text whose pre-tokens are known."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


#: (encoder, doc_ids, texts, pre-tokens of each text)
Emit = Callable[[Encoder, list, list[str | None], Iterator[list[str]]], pa.RecordBatch]

def _encoded(docs: DataFrame, path: str, emit: Emit, schema: str, chunk_chars: int = 1024, overlap: int = 64, spread_chars: int = 65_536) -> DataFrame:
    """What ``emit`` makes of doc_ids, texts and each text's pre-tokens, whose ids are known then.

    Every text is cut into chunks of ``chunk_chars`` and ``overlap`` more, the chunks into pre-tokens, and
    these are stitched and encoded.  The chunks of a text of more than ``spread_chars`` are cut into
    pre-tokens wherever a task is free.  A null text has no ids.  Rows that repeat doc_id and text get
    equal results, one each.
    """
    docs = bare(docs)
    long = F.coalesce(F.length("text"), F.lit(0)) > spread_chars
    step = chunk_chars + overlap

    def pieces(text: str) -> list[str]:
        n = len(text)
        if n <= step:  # one chunk
            return _PIECES.findall(text)
        return stitch(text, [(s, chunk_pieces(text[s : s + step], s + step >= n)) for s in range(0, max(n - overlap, 1), chunk_chars)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = part.column("text").to_pylist()
                cut = [pieces(t or "") for t in texts]
                encoder.learn(cut)
                yield emit(encoder, part.column("doc_id").to_pylist(), texts, iter(cut))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of long texts, a few at a time."""
        big = chunk_chars * 16
        for batch in batches:
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = len(text)
                for s in range(0, max(n - overlap, 1), big):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "key": key, "n": n, "start": s, "chunk": text[s : s + big + overlap]}], _CHUNKS)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("chunk").to_pylist(), batch.column("start").to_pylist(), batch.column("n").to_pylist(), strict=True)
            sizes = [list(map(len, chunk_pieces(c, s + len(c) >= n))) for c, s, n in rows]
            yield batch.append_column("sizes", pa.array(sizes, pa.list_(pa.int32())))

    def join(group: pa.Table) -> pa.Table:
        encoder, group = _encoder(path), group.sort_by("start")
        starts, chunks, sizes = (group.column(c).to_pylist() for c in ("start", "chunk", "sizes"))
        first = [i for i, s in enumerate(starts) if i == 0 or s != starts[i - 1]]
        text = "".join(chunks[i][: starts[j] - starts[i]] if j is not None else chunks[i] for i, j in zip(first, [*first[1:], None], strict=True))

        def own(i: int) -> list[str]:
            ends = list(accumulate(sizes[i], initial=0))
            return [chunks[i][a:z] for a, z in zip(ends, ends[1:], strict=False)]

        cut = stitch(text, ((starts[i], own(i)) for i in first))
        encoder.learn([cut])
        copies = starts.count(0)
        return pa.Table.from_batches([emit(encoder, [group.column("doc_id")[0].as_py()] * copies, [text] * copies, iter([cut] * copies))])

    chunks = (
        docs.filter(long)
        .select("doc_id", F.xxhash64("text").alias("key"), "text")
        .mapInArrow(tidy(spread), "doc_id long, key long, n int, start int, chunk string")
        .repartition("doc_id", "key", "start")
        .mapInArrow(tidy(pretokenise), "doc_id long, key long, n int, start int, chunk string, sizes array<int>")
    )
    joined = chunks.groupBy("doc_id", "key", "n").applyInArrow(tidy_group(join), schema)
    return docs.filter(~long).mapInArrow(tidy(encode), schema).unionByName(joined)


_CHUNKS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("chunk", pa.string())])


def bpe_encode(docs: DataFrame, path: str | None = None, **sizes: int) -> DataFrame:
    """doc_id, text, ids array<int>: the ids of every text, as ``_encoded`` gets them."""

    def emit(encoder: Encoder, doc_ids: list, texts: list, found: Iterator[list[str]]) -> pa.RecordBatch:
        ids = [encoder.ids(own) for own in found]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "text", "ids"])

    return _encoded(docs, path or default_tokenizer_path("byte_bpe_50k.tiktoken"), emit, "doc_id long, text string, ids array<int>", **sizes)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``raw`` binary, the bytes of column ``ids`` put together; null ids are none."""
    path = path or default_tokenizer_path("byte_bpe_50k.tiktoken")
    schema = StructType([*encoded.schema.fields, StructField("raw", BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            raw = [encoder.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield batch.append_column("raw", pa.array(raw, pa.binary()))

    return encoded.mapInArrow(tidy(decode), schema)


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of ids and of the bytes they decode to."""

    def emit(encoder: Encoder, doc_ids: list, texts: list, found: Iterator[list[str]]) -> pa.RecordBatch:
        rows, decimal = [], encoder.decimals.__getitem__
        for cut in found:
            ids = encoder.ids(cut).tolist()
            rows.append((len(ids), sha256(" ".join(map(decimal, ids)).encode()), sha256(encoder.decode(ids))))
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, path or default_tokenizer_path("byte_bpe_50k.tiktoken"), emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
