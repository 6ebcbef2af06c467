import os

import pytest

import corpus_pipeline
from satchel.llm.decontaminate import shingles, words_of
from satchel.llm import toxicity
from tests.llm.common import classes, kept_words

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, made = {r.doc_id: r.text for r in docs.collect()}, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        made.append({r.doc_id: r.text for r in docs.collect()})
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert made[0] == {i: t for i, t in rows.items() if score[i] < toxicity.THRESHOLD}
    assert set(made[1]) == {i for i, _, c in classes(sorted(made[0].items()), 5, 80, 100) if i == c}
    words = kept_words(sorted(made[1].items()))
    gone = {i: words[i, t][1] for i, t in made[1].items()}
    assert set(made[2]) == {i for i, t in made[1].items() if not gone[i] or gone[i] < words[i, t][0]}
    assert all(made[2][i] == made[1][i] for i in made[2] if not gone[i])
    items = [shingles(words_of(r.text.encode()), 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text):
        words = words_of((text or "").encode())
        for own in filter(None, items):
            w = len(next(iter(own)))
            if 5 * len(own & {tuple(words[i : i + w]) for i in range(len(words) - w + 1)}) >= 4 * len(own):
                return True
        return False

    assert made[3] == {i: t for i, t in made[2].items() if not holds(t)} and made[4] == made[3]
    ran = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.text for r in ran.collect()} == made[4]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated ids and rows, no column n_chars, names that clash, empty tables."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, b), (5, a), (6, c), (6, c), (None, a), (None, "d e f g h i"), (7, ""), (7, None), (None, None), (8, a + " x"), (9, "one"), (9, "two")]
    names = "score long, n_removed long, node long, row string, `_id` long, shard string, `a``b` long"
    docs = spark.createDataFrame([(i, t, 1, 777, 2, "r", 3, "s", 4) for i, t in rows], f"doc_id long, text string, {names}")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (6, c), (None, "d e f g h i"), (7, ""), (7, None), (None, None), (9, "one"), (9, "two")], key=str)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert all(r["n_removed"] == 777 and r["a`b"] == 4 for r in out.collect())
        assert stage(spark, docs.filter("doc_id > 99"), SF).count() == 0
    assert corpus_pipeline.encode(spark, docs, SF).count() == len(rows)
