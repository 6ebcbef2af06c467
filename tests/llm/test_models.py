"""Operators 4 and 8: contracts by brute force, quality on held-out rows."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from satchel.llm import mixing, toxicity
from tests.llm.common import documents, frame, lower

SF = "/root/testdata/sf0.1"


def test_lm(spark):
    rows = documents() + [(700 + i, "the cat sat on the mat") for i in range(30)]
    own = lambda t: [*lower(t or "").encode().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not held(i) for w in own(t))
    total, kinds = sum(count.values()), len(count)
    expected = sorted((str(i), held(i), len(own(t)), sum(count[w] > 0 for w in own(t)), round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own(t)), 6)) for i, t in rows)
    found = mixing.lm_scores(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    assert {r.train_tokens for r in found} == {total} and all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert mixing.lm_scores(frame(spark, rows).filter("doc_id > 9999")).count() == 0


@pytest.mark.parametrize("many", [mixing.MANY, 30])
def test_lm_contexts_are_exact(spark, monkeypatch, many):
    """Scores from the counts of each context by itself, over several shards, parted or not."""
    monkeypatch.setattr(mixing, "n_shards", lambda docs: 7)
    monkeypatch.setattr(mixing, "MANY", many)
    rows = documents()
    count, nodes, types, read = Counter(), Counter(), set(), []
    for i, t in rows:
        raw = lower(t or "").encode()
        h, at, size = mixing.tokens_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words = raw.split()
        assert len(h) == len(words) + 1
        of = {}
        for k, x in enumerate(words):
            of[x] = int(h[k])
        own, number = [], lambda x: int(mixing.mix(np.array([x], np.uint64) ^ np.uint64(0x51ED270B))[0]) % mixing.CLASSES
        for k, x in enumerate(h.tolist()):
            last = range(max(0, k - mixing.RECENT), k)
            around = ("", words[k - 1] if k else b"", number(of[words[min(last, key=lambda j: (min(len(words[j]), 255), -j))]] if k else 0))
            path = [x >> (64 - b) for b in range(mixing.BITS + 1)]
            own.append((x, path, list(enumerate(around))))
            if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
                count[x] += 1
                types.add(x)
                nodes.update((c, b, p) for c in own[-1][2] for b, p in enumerate(path))
                nodes.update((c, x) for c in own[-1][2])
        read.append((i, own))
    expected = []
    for i, own in read:
        if len(own) > mixing.BLOCK:
            continue  # its weights change
        score = 0.0
        for x, path, around in own:
            weights = mixing.START[sum(nodes[around[1], 0, 0] >= g for g in mixing.GATES)]
            for b in range(mixing.BITS):
                logits = [math.log((nodes[c, b + 1, path[b + 1]] + 0.4) / (nodes[c, b, path[b]] - nodes[c, b + 1, path[b + 1]] + 0.4)) for c in around]
                logits[1] = round(logits[1] / mixing.STEP) * mixing.STEP
                score -= math.log10(1 + math.exp(-sum(w * z for w, z in zip(weights, logits, strict=True))))
            code = path[-1]
            share = (count[x] + 0.5) / (nodes[around[0], mixing.BITS, code] + 0.5 * (sum(y >> (64 - mixing.BITS) == code for y in types) + 1))
            score += math.log10((nodes[around[1], x] + mixing.PRIOR * share) / (nodes[around[1], mixing.BITS, code] + mixing.PRIOR))
        expected.append((str(i), len(own), score))
    found = sorted((str(r.doc_id), r.n_tokens, r.score) for r in mixing.lm_scores(frame(spark, rows)).collect() if r.n_tokens <= mixing.BLOCK)
    assert len(found) == len(expected) > 20
    for a, b in zip(found, sorted(expected), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4)


def test_lm_counts_beyond_a_byte():
    counts = np.cumsum(np.array([[0, 254, 255, 256, 1 << 40]] * mixing.NODES), axis=0)[::-1]
    logits, gate, last = mixing.unpack_counts(mixing.pack_counts(counts))
    assert (last == counts[mixing.BITS :]).all() and gate.tolist() == [0, 3, 3, 3, 3]
    assert np.abs(logits * mixing.STEP - mixing.odds(counts[: mixing.BITS + 1])).max() <= mixing.STEP / 2 + 1e-3


def test_lm_decisions_add_up_to_one():
    rng = np.random.default_rng(8)
    codes = np.arange(1 << mixing.BITS)
    some = lambda *size: rng.integers(0, 9, size) * (rng.random(size) < 0.3)
    model = mixing.Mixer(some(len(codes)), some(len(codes)), some(mixing.CLASSES, len(codes)))
    key = mixing.Layout(5).key(np.zeros(len(codes), np.uint64), codes.astype(np.uint64), np.zeros(len(codes), np.uint64))
    logits, gate, _ = mixing.unpack_counts(mixing.pack_counts(mixing.node_counts(key, some(len(codes)))))
    bits = model.code_bits(codes, np.arange(len(codes) + 1), np.full(len(codes), 3), logits, gate)
    assert (2.0 ** -bits.astype(float)).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lm = mixing.lm_scores(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert lm.s > lm.b
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.toxicity_query(docs, labels).filter("held_out").collect() if r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    hit = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert hit >= 0.8 * sum(truth[r.doc_id] for r in rows) and hit >= 0.95 * sum(r.predicted for r in rows)
    model = toxicity.train(docs, labels, 3000)
    found = toxicity.toxic_sentences(docs.filter("doc_id < 200"), model, 0.5).collect()
    assert found and {truth.get(r.doc_id, 1) for r in found} == {1}


def test_toxicity_edges(spark):
    rows = [(i, "you are a loser. the end" if i % 2 else "the cat sat. on a mat") for i in range(200)] + [(None, None), (900, ""), (901, "!!"), (3, "you are a loser. the end"), (902, "fine words. " * 9000 + "what a loser")]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(200)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    out = toxicity.toxicity_query(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[900].score == by[901].score == by[None].score == 0 and not by[None].held_out
    assert by[902].predicted == 1 and by[1].predicted == 1 and by[2].predicted == 0
    empty = toxicity.toxicity_query(frame(spark, rows), labels.filter("doc_id > 9999"))
    assert empty.count() == len(rows)


def test_toxic_only_near_the_end_of_long_texts(spark):
    filler = "fine words here. " * 7_000
    rows = [(i, filler + ("you are a loser." if i % 2 else "you are at home.")) for i in range(80)]
    model = toxicity.train(frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, [(1, "what a loser"), (2, "fine words at home"), (3, rows[1][1]), (4, rows[2][1])]).drop("score"), model).collect()}
    assert min(score[1], score[3]) >= toxicity.THRESHOLD > max(score[2], score[4])
