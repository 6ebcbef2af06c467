"""Operators 2, 5 and 7 against brute force."""

import random
import re

import numpy as np

from satchel.llm import decontaminate as d
from satchel.llm import licenses, topk
from tests.llm.common import documents, frame, got


def test_contamination(spark):
    rng = random.Random(2)
    rows = documents()
    items = [(i, " ".join((rows[i][1] or "x").split()[:30])) for i in range(20)] + [(50, "One two"), (51, ""), (52, None), (53, "The."), (53, "The."), (None, "one two three four five six")]
    for i, t in items[:20]:
        words = t.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz" if words else "x"
        rows.append((500 + i, "qq " + " ".join(words).upper() + ", rr"))
    rows += [(600, "ONE, two three four five. six the"), (600, "ONE, two three four five. six the")]
    expected = []
    for r, t in rows:
        words = d.words_of((t or "").encode())
        for i, item in items:
            own = d.shingles(d.words_of((item or "").encode()), 5)
            if own:
                width = len(next(iter(own)))
                n = len(own & {tuple(words[j : j + width]) for j in range(len(words) - width + 1)})
                if 100 * n >= 80 * len(own):
                    expected.append((r, i, len(own), n, n / len(own)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(d.contamination(frame(spark, rows), bench)) == sorted(expected, key=str)
    clean = d.without_contaminated(frame(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r) for r, t in rows if not any(e[0] == r for e in expected))
    assert got(d.contamination(frame(spark, rows), bench.filter("item_id > 9999"))) == []


def test_blocks_find_the_same(spark, monkeypatch):
    rows = documents()
    bench = spark.createDataFrame([(i, " ".join((rows[i][1] or "").split()[:25])) for i in range(30)], "item_id long, text string")
    whole = got(d.contamination(frame(spark, rows), bench))
    monkeypatch.setattr(d, "ITEMS", 8)
    assert got(d.contamination(frame(spark, rows), bench)) == whole and whole


def exact(vectors, queries, k):
    """Every row but the query's own; equal rows are told apart by their place in ``vectors``."""
    out = []
    for at, q, a in queries:
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for j, (i, b) in enumerate(vectors) if j != at)
        out += [(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(15)] + [(900, [0.0] * 16)]
    # repeated ids, with equal and with other vectors; other lengths; scores beyond long
    rows += [(100, rows[100][1]), (100, rows[7][1]), (200, []), (800, [0.5] * 20), (801, [0.25] * 3), (300, [2.0**30] * 16), (802, [2.0**39] * 16), (802, [-(2.0**41)] * 16)]
    bad = [(1000, None), (1100, [float("nan")] * 16), (1200, [None] * 16), (1300, [float("inf")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, score string, row int")
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    expected = exact(whole, [(j, *r) for j, r in enumerate(whole) if r[0] % 100 == 0], 10)
    assert sorted(map(tuple, topk.top_k_query(df).collect())) == expected
    v = topk.quantised(df)
    assert sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 100 = 0"), 10, block=50, per=2).collect())) == expected
    assert topk.top_k_query(df.filter("vec_id = 900")).count() == 0 and topk.top_k_query(df.filter("vec_id < 0")).count() == 0


def test_stops_early_on_proof():
    rng = np.random.default_rng(5)
    grid = rng.integers(-90, 91, (3000, 8))
    grid[:20] *= 100
    index = topk.ImpactIndex(np.arange(3000), np.arange(3000), grid)
    for q, best in enumerate(index.search(grid[:40], 5, np.arange(40))):
        s = grid @ grid[q]
        assert [i for _, i in best] == [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
    impacts = [[abs(index.value[a:z]).max() for _, a, z in segments] for segments, _ in index.levels]
    assert len(impacts) > 5 and all(min(x) >= max(y) for x, y in zip(impacts, impacts[1:], strict=False))
    # segments of large impact alone are enough for some, by proof
    index.levels[-1:] = [([("no such", 0, 0)], rest) for _, rest in index.levels[-1:]]
    assert len(index.search(grid[:1], 5, np.arange(1))[0]) == 5


def words(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def test_licenses(spark):
    rows = documents() + [
        (800, "Released under the MIT License.\nAll rights reserved. ALL RIGHTS RESERVED"),
        (801, "Licensed under CC BY-NC 4.0."),
        (802, "GNU General  Public--License all rights"),
        (803, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files"),
        (804, "cc by cc by by"),
        (804, "cc by cc by by"),
    ]
    out = {}
    for r in licenses.license_scan(frame(spark, rows)).collect():
        out.setdefault((r.doc_id, r.n_words), r)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in rows:
        w = words(t)
        places = sorted((j, label) for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        r = out[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert {i: out[i, len(words(t))].labels for i, t in rows if i and 800 <= i <= 803} == {800: "mit,reserved", 801: "cc-by,cc-by-nc", 802: "gpl", 803: "mit"}
    assert {(r.doc_id, r.label) for r in licenses.license_spans(frame(spark, rows)).collect()} >= {(800, "mit"), (803, "mit")}


def test_license_chain_of_repeated_phrases():
    """The match that a chain goes on from may be many entries back."""
    words = " ".join(f"the right to u{k} v{k} w{k}" for k in range(12))
    text = " zzz ".join(f"the right to zzz u{k} v{k} w{k}" for k in range(12))
    found = licenses.LicenseScanner(templates={"own": (words,)}).scan(text.encode()).spans
    assert ("own", 0, len(text.split()), 1.0) in found
    none = licenses.LicenseScanner(templates={"own": (words,)}, gap=0).scan(text.encode()).spans
    assert none == []


def test_license_notices_have_their_own_labels():
    scanner = licenses.LicenseScanner()
    for label, texts in licenses.TEMPLATES.items():
        assert all({s[0] for s in scanner.scan(t.encode()).spans} == {label} for t in texts)
    assert {"isc", "mpl", "unlicense", "zlib"} <= set(licenses.TEMPLATES)
    # a whole licence with some words changed and its notice left out
    words = licenses.TEXTS["isc"].split()[30:]
    words[10] = words[40] = "changed"
    assert {s[0] for s in scanner.scan(" ".join(words).encode()).spans} == set()
    words = licenses.TEXTS["zlib"].replace("held liable", "held in any way liable").split()
    words[60] = "changed"
    assert {s[0] for s in scanner.scan(" ".join(words).encode()).spans} == {"zlib"}


def test_license_scan_of_nothing(spark):
    assert got(licenses.license_scan(frame(spark, [(1, "x")]).filter("doc_id > 1"))) == []
