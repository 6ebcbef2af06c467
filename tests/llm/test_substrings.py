import dataclasses

import numpy as np
import pytest

from satchel.llm import repeats, substrings
from tests.llm.common import documents, frame, got, kept_bytes, kept_words

ROWS = documents()


@pytest.mark.parametrize("hot", [4096, 1])
def test_words(spark, monkeypatch, hot):
    task = substrings.word_task
    monkeypatch.setattr(repeats, "n_shards", lambda *a: 3)
    monkeypatch.setattr(substrings, "word_task", lambda *a: dataclasses.replace(task(*a), hot=hot))
    expected = kept_words(ROWS)
    assert got(substrings.substring_dedup_query(frame(spark, ROWS))) == sorted(((i, *expected[i, t]) for i, t in ROWS), key=str)


@pytest.mark.parametrize("hot", [4096, 1])
def test_bytes(spark, monkeypatch, hot):
    task = substrings.byte_task
    monkeypatch.setattr(repeats, "n_shards", lambda *a: 3)
    monkeypatch.setattr(substrings, "byte_task", lambda *a: dataclasses.replace(task(*a), hot=hot))
    expected = kept_bytes(ROWS)
    assert got(substrings.suffix_array_dedup_query(frame(spark, ROWS))) == sorted(((i, *expected[i, t]) for i, t in ROWS), key=str)


def test_bytes_keep_first(spark):
    expected = kept_bytes(ROWS, 50, first=True)
    rows = substrings.suffix_array_dedup(frame(spark, ROWS), 50, "first").collect()
    assert sorted((str(r.doc_id), sum(s.end - s.start for s in r.spans)) for r in rows) == sorted((str(i), expected[i, t][1]) for i, t in ROWS)


def test_text_stays_or_is_joined(spark):
    expected = kept_words(ROWS)
    for r in substrings.substring_dedup(frame(spark, ROWS)).collect():
        if not r.n_removed:
            assert (r.doc_id, r.text) in expected
    clash = frame(spark, ROWS).selectExpr("*", "777 AS n_removed", "1 AS `a``b`")
    out = substrings.substring_dedup(clash)
    assert out.columns == ["doc_id", "text", "score", "shard", "a`b", "n_removed"] and out.filter("n_removed = 777").count() == 0


def test_empty(spark):
    none = frame(spark, [(1, "x")]).filter("doc_id > 1")
    assert got(substrings.substring_dedup_query(none)) == [] == got(substrings.suffix_array_dedup_query(none))


@pytest.mark.parametrize("size", [7, 8, 13, 200])
def test_previous_factors(size):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 700).astype(np.uint8)
    data[300:560] = data[20:280]
    raw, starts = data.tobytes(), np.arange(700 - size + 1)
    suffixes = substrings.Suffixes(data, size)
    windows = [raw[i : i + size] for i in starts]
    assert [sorted(set(windows)).index(w) for w in windows] == np.unique(suffixes.rank[starts], return_inverse=True)[1].tolist()

    def longest(i, others):
        return max((next((k for k in range(size) if windows[i][k] != windows[j][k]), size) for j in others), default=0)

    assert substrings.longest_previous_factors(suffixes, starts).tolist() == [longest(i, range(i)) for i in starts]
    assert substrings.longest_previous_factors(suffixes, starts, True).tolist() == [longest(i, range(i + 1, len(starts))) for i in starts]


def test_nearest_smaller():
    rng = np.random.default_rng(2)
    for x in (rng.permutation(60), np.arange(40), np.arange(40)[::-1]):
        before, after = substrings.nearest_smaller(x)
        assert before.tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert after.tolist() == [min((j for j in range(i + 1, len(x)) if x[j] < x[i]), default=-1) for i in range(len(x))]


def test_many_rows_without_id(spark):
    """Rows without id are told apart by their whole texts' hashes, however many there are."""
    rows = [(None, f"t{i} " + " ".join(f"w{(i % 50) * 31 + j}" for j in range(24))) for i in range(10_000)]
    expected = kept_words(rows)
    assert sum(r.n_removed for r in substrings.substring_dedup_query(frame(spark, rows)).collect()) == sum(v[1] for v in expected.values())


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 99, 60)
    for w in (1, 2, 3, 11, 16, 60):
        assert repeats.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(60 - w + 1)]
