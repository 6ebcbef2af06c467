import random

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from satchel.llm import bpe
from satchel.llm.common import default_tokenizer_path
from tests.llm.common import documents, frame, got, sha

JSON, RANKS = default_tokenizer_path("byte_bpe_50k.json"), default_tokenizer_path("byte_bpe_50k.tiktoken")
BITS = ["a", "b", " ", "  ", "\n", "'s", "é", "don't", "<|endoftext|>", "123", "!!", "\x1c", "日本", "\t", "a" * 39, " the", "😀"]


def texts(n=150):
    rng = random.Random(1)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a" * 2000, "ab" * 1500, " " * 900]


def test_counts_are_the_librarys():
    library, own = Tokenizer.from_file(JSON), bpe.PrefixCounter(JSON)
    for t in texts():
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_prefixes_of_many():
    own, rng = bpe.PrefixCounter(JSON), random.Random(3)
    pieces = [bytes(rng.choice(b"abcdehint \xc3\xa9\xff") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert own.all_prefixes(pieces) == [own.prefixes(p) for p in pieces]
    own.learn([["a\u00e9 b", None, "x" * 400, "abc"]])
    assert {"a\u00e9 b", "abc"} <= set(own.known) and own.counts_of("x" * 400)[-1] == own.count("x" * 400) == own.prefixes(b"x" * 400)[-1]


def test_every_prefix():
    library, own = Tokenizer.from_file(JSON), bpe.PrefixCounter(JSON)
    for piece in [" thanonntandly", "aaaaaaaaaaaa", "!!!!???", "日本"]:
        counts = own.prefixes(piece.encode())
        for k in range(len(piece) + 1):
            assert counts[len(piece[:k].encode())] == len(library.encode(piece[:k], add_special_tokens=False).ids)


def test_pairs_stand_as_the_merges_leave_them():
    own = bpe.PrefixCounter(JSON)
    rng = random.Random(4)
    tokens = sorted(t for t in own.tokens if len(t) <= 6)
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if rng.random() < 0.5:
            whole = rng.choice(tokens)
            k = rng.randint(1, max(1, len(whole) - 1))
            a, b = (whole[:k], whole[k:] + b) if whole[:k] in own.tokens and whole[k:] + b in own.tokens else (a, b)
        if own.alone(a) and own.alone(b):
            assert own.fit(a, b) == (bpe.merged(a + b, own.rank) == [a, b]), (a, b)


def test_cut_is_the_longest_within_budget():
    library, own = Tokenizer.from_file(JSON), bpe.PrefixCounter(JSON)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in [*(x[:90] for x in texts(60)), "we're  here", "a   b", "x 's", " they'll've"]:
        t = t.replace("<|endoftext|>", "")
        for budget in (0, 1, 2, 9):
            assert own.cut(t, budget) == max((k for k in range(len(t) + 1) if count(t[:k]) <= budget)), (t, budget)
    assert own.cut("ab<|endoftext|>c", own.count("ab")) == 2
    assert own.cut("a" * 80_000, 50) > 50


def test_prefix_counts(spark):
    library = Tokenizer.from_file(JSON)
    rows = documents()[:30] + [(90, None), (91, ""), (92, "a<|endoftext|>b")]
    made = bpe.prefix_counts(frame(spark, rows))
    for r in made.collect():
        text = next(t for i, t in rows if i == r.doc_id) or ""
        assert len(r.ends) == len(r.counts) and (not r.ends or r.ends[-1] == len(text))
        for k in range(0, len(r.ends), 7):
            end = r.ends[k]
            if end == len(text) or not text[end - 1].isspace():
                assert r.counts[k] == len(library.encode(text[:end], add_special_tokens=False).ids)
    for r in bpe.within(made, 5).collect():
        assert r.kept_tokens <= 5 and r.kept_tokens == max([c for c in r.counts if c <= 5], default=0) and r.kept_chars == dict(zip(r.counts, r.ends, strict=True)).get(r.kept_tokens, 0)


def test_stitching():
    for t in texts():
        for size, overlap in ((7, 3), (16, 4), (500, 50)):
            chunks = [(s, bpe.chunk_pieces(t[s : s + size + overlap], s + size + overlap >= len(t))) for s in range(0, len(t), size)]
            assert bpe.stitch(t, chunks) == regex.findall(bpe.PATTERN, t)


def test_round_trip(spark):
    encoder = bpe.Encoder(RANKS)
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rows = documents() + [(1000 + i, t) for i, t in enumerate(texts(40))] + [(7, "ab " * 40_000), (7, "ab " * 40_000), (None, " \n" * 40_000 + "x" * 3000)]

    def expected(i, t):
        ids = library.encode_ordinary(t or "")
        return (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))

    assert got(bpe.bpe_round_trip(frame(spark, rows))) == sorted((expected(*r) for r in rows), key=str)
    for r in bpe.bpe_decode(bpe.bpe_encode(frame(spark, rows[:20]), chunk_chars=20, overlap=5, spread_chars=200)).collect():
        assert bytes(r.raw) == (r.text or "").encode() and r.ids == library.encode_ordinary(r.text or "")
    assert got(bpe.bpe_round_trip(frame(spark, rows).filter("doc_id > 99999"))) == []


def test_merging_side_by_side():
    encoder, rng = bpe.Encoder(RANKS), random.Random(2)
    pieces = sorted({bytes(rng.choice(b"abcdehint \xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(3000)}, key=len)
    assert encoder.merge_all(pieces) == [np.array([encoder.ranks[x] for x in bpe.merged(p, encoder.rank)], np.int32).tobytes() for p in pieces]


def test_pretokens_come_back_from_the_generation_before(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 4)
    monkeypatch.setattr(bpe, "ENCODED", 4)
    counter, encoder, library = bpe.PrefixCounter(JSON), bpe.Encoder(RANKS), Tokenizer.from_file(JSON)
    for turn in range(6):
        t = f"one two{turn} three four{turn} five"
        for own in (counter, encoder):
            own.learn([own.pieces(t) if own is counter else bpe.chunk_pieces(t, True)])
            assert len(own.known) <= 12 and len(own.before) <= 12
        ids = library.encode(t, add_special_tokens=False).ids
        assert counter.running(counter.pieces(t))[-1] == len(ids)
        assert encoder.ids(bpe.chunk_pieces(t, True)).tolist() == ids


def test_pairs_that_share_a_slot():
    own = bpe.PrefixCounter(JSON)
    own.pairs, own.pair_fits = np.full(1 << 21, -1), np.zeros(1 << 21, bool)
    rng = random.Random(8)
    pieces = [bytes(rng.choice(b"abcdehint ") for _ in range(rng.randint(1, 20))) for _ in range(200)]
    expected = [own.prefixes(p) for p in pieces]
    real = bpe._slot
    try:
        bpe._slot = lambda pair: real(pair) & 7
        assert own.all_prefixes(pieces) == expected == own.all_prefixes(pieces)
    finally:
        bpe._slot = real


def test_count_query(spark):
    library = Tokenizer.from_file(JSON)
    rows = documents()
    out = bpe.token_counts(frame(spark, rows)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert got(out) == sorted(expected, key=str)
    assert got(bpe.token_counts(frame(spark, rows).filter("doc_id > 9999"))) == []
