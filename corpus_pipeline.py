"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and works on every row that the one before kept.  Rows, not ids, are
judged: ids may be null or repeat, and further columns may have any name.  Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.bpe import bpe_encode
from satchel.llm.common import table
from satchel.llm.decontaminate import without_contaminated
from satchel.llm.jaccard import one_of_each
from satchel.llm.substrings import substring_dedup
from satchel.llm.toxicity import non_toxic, train
from satchel.plans.shared import new_folder, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; a null text scores 0 and stays."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return non_toxic(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows linked at 0.8 over five-word shingles, the one with the smallest doc_id (a null one is the
    largest), then the text with the smallest hash; of rows that repeat id and text, one.

    Rows without words are linked with nothing and stay, all of them.
    """
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without stretches of 20 words that start earlier elsewhere; a text that had words and
    has none left goes.  A column n_chars, if there is one, follows the text."""
    count = next(c for k in range(len(docs.columns) + 1) if (c := f"_n_removed_{k}") not in docs.columns)
    cut = substring_dedup(docs, count=count)
    kept = cut.filter((F.col(count) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop(count)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text and token ids of what is left."""
    return bpe_encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL can't express the classifier, the tokenizer or links of word sets at this size; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet where all executors can read it.  A stage's
    table goes once the next one is written; the last one, which the result reads, stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
