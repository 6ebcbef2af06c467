import random

import pytest

from satchel.llm import jaccard
from satchel.llm.graph import components
from tests.llm.common import classes, frame, got, vocabulary


def near_copies():
    rng = random.Random(5)
    words = vocabulary(rng)
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))] for _ in range(12)]
    rows = []
    for i in range(130):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6, 12])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(b[: int(len(b) * 0.93) + 1] if rng.random() < 0.2 else b)))
    return rows + [(400, None), (401, ""), (402, "  \n"), (None, rows[3][1]), (None, "zz yy xx ww"), (403, "one"), (404, "ONE"), (405, "one two"), (3, rows[3][1]), (3, rows[9][1])]


ROWS = near_copies()


@pytest.mark.parametrize(("k", "num", "limit"), [(3, 90, jaccard.LIMIT), (5, 80, jaccard.LIMIT), (5, 80, 2000)])
def test_classes(spark, monkeypatch, k, num, limit):
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    assert got(jaccard.jaccard_classes(frame(spark, ROWS), k, num, 100, limit)) == sorted(classes(ROWS, k, num, 100), key=str)


@pytest.mark.parametrize("group", [3, jaccard.GROUP])
def test_large_groups_and_blocks(spark, monkeypatch, group):
    """Groups of candidates beyond the most that are compared; regions that windows cannot part."""
    whole = jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda *a: whole(*a, most=group))
    part = jaccard._part
    monkeypatch.setattr(jaccard, "_part", lambda members, measure, turn: (part(members, measure, turn)[0], members))
    assert got(jaccard.jaccard_classes(frame(spark, ROWS), 5, 80, 100, 300)) == sorted(classes(ROWS, 5, 80, 100), key=str)


def test_one_of_each(spark):
    rows = [*ROWS, (3, ROWS[3][1]), (901, "q w e r t y u i"), (905, "q w e r t y u i"), (905, "another text of its own here now"), (906, "z x c v b n m a"), (906, "z x c v b n m a")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(frame(spark, rows)).collect()), key=str)
    by = {}
    for (i, t), (_, n, c) in zip(rows, classes([(j, t) for j, (_, t) in enumerate(rows)], 5, 80, 100), strict=True):
        by.setdefault(c, []).append((i, t, n))
    assert len(kept) == len(by)
    for group in by.values():
        least = min((i is None, i or 0) for i, _, _ in group)
        assert any((i is None, i or 0) == least and (i, t) in kept for i, t, _ in group)
    assert {(905, "another text of its own here now"), (901, "q w e r t y u i"), (906, "z x c v b n m a")} <= set(kept)
    assert jaccard.one_of_each(frame(spark, rows)).columns == frame(spark, rows).columns


def test_region_links_connect_what_links_connect():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 1000, 40)
        sets = [np.unique(np.where(rng.random(40) < rng.random() * 0.3, rng.integers(0, 1000, 40), base)).astype(np.uint64) for _ in range(25)]
        measure = jaccard.Measure(3, 80, 100)

        def parts(links):
            root = list(range(25))
            for _ in range(25):
                for a, b in links:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        every = [(a, b) for a in range(25) for b in range(a) if measure.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
        assert parts(jaccard.region_links(sets, measure)) == parts(every)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_empty(spark):
    assert got(jaccard.jaccard_query(frame(spark, [(1, "x")]).filter("doc_id > 1"))) == []
