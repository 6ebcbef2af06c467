"""Operator 4: toxicity of documents by multiple-instance learning.

Each sentence has a logistic score of its words and their beginnings (inflected languages keep the
stem there); a document's is the noisy-or of its sentences'.
Weights are fitted from document labels alone, and the same sentence scores then locate what
offends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from satchel.llm.common import BYTE_HASH, LOWER, Rolling, Words, bare, columns_of, mix, pack, slices, text_buffer, tidy, unpack, whole_row
from satchel.plans.shared import checkpoint

BITS = 18
#: Labelled documents that a model is fitted on at most, chosen by a hash of their ids.
SAMPLE = 8_000
#: Bytes of a word's beginnings that are features beside the whole word.
STEMS = (4, 5, 6)
DEAD = 1 << BITS  # the slot of a stem that a shorter word lacks; its weight is 0
#: Documents of the sample that a feature must stand in to have a weight, and how many standard
#: errors its share among toxic documents must differ from that among all.
LEAST_DOCS, LEAST_Z = 4, 3.5
THRESHOLD = 0.3
_SLICE = 1 << 20

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def instances(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: words, the slots of each word's features, its sentence, and each sentence's document."""
    words = Words(LOWER[data], offsets, space=_APART)
    roll, size = Rolling(BYTE_HASH[words.data]), words.ends - words.starts
    slot = np.full((1 + len(STEMS), len(size)), DEAD, np.int32)
    slot[0] = roll.of(words.starts, words.ends) >> np.uint64(64 - BITS)
    for k, n in enumerate(STEMS, 1):
        has = np.flatnonzero(size >= n)
        slot[k, has] = mix(roll.of(words.starts[has], words.starts[has] + n)) >> np.uint64(64 - BITS)
    doc = np.repeat(np.arange(len(offsets) - 1), words.counts())
    mark = np.cumsum(_STOP[data])[words.starts] if len(words.starts) else np.zeros(0, np.int64)
    new = np.r_[True, (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
    return words, slot, np.cumsum(new) - 1, doc[new]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentences(self, slot: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(sentence, self.weights[slot].sum(axis=0)) if slot.shape[1] else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def documents(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)) if n else np.zeros(0)


def screened(slot: np.ndarray, present: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """The features to have a weight, from the numbers of (toxic) documents that they stand in."""
    share = np.clip(n_toxic / n, 1 / (n + 1), 1 - 1 / (n + 1))
    z = (toxic - present * share) / np.sqrt(np.maximum(present, 1) * share * (1 - share))
    return np.sort(slot[(present >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)])


def fit_model(rows: list[tuple[int, int, np.ndarray, np.ndarray]], used: np.ndarray, steps: int = 150, decay: float = 2e-4, rate: float = 0.3) -> Model:
    """Full-batch Adam on the noisy-or likelihood, from (label, number of sentences, places in ``used`` of
    the features kept, number of each's sentence among those that have any) of documents."""
    weights = np.zeros(DEAD + 1, np.float32)
    if not rows:
        return Model(weights, -8.0)
    label, n_sent = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    share = np.clip(label.mean(), 1 / (len(rows) + 1), 1 - 1 / (len(rows) + 1))
    n_with = np.array([int(r[3][-1]) + 1 if len(r[3]) else 0 for r in rows])
    col = np.concatenate([r[2] for r in rows])
    row = np.concatenate([r[3] + base for r, base in zip(rows, np.cumsum(n_with) - n_with, strict=True)]).astype(np.int64)
    # sentences without features are alike: one with their number for each document
    doc = np.r_[np.repeat(np.arange(len(rows)), n_with), np.arange(len(rows))]
    times = np.r_[np.ones(n_with.sum()), n_sent - n_with]
    w, b = np.zeros(len(used)), -np.log(max(n_sent.mean(), 1.0) / share)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        p = np.clip(1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(doc)), -30, 30))), 1e-9, 1 - 1e-9)
        total = np.clip(-np.expm1(np.bincount(doc, times * np.log1p(-p), len(rows))), 1e-9, 1)
        g = times * np.where(label[doc] > 0, -p * ((1 - total) / total)[doc], p) / len(rows)
        grad = np.r_[np.bincount(col, g[row], len(used)) + decay * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[used] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the whole texts of at most ``sample`` labelled rows that are not held out.

    The ids with the smallest hashes are taken, and of an id that several rows have, the row whose text
    has the smallest hash; rows without id or label are not used, several labels of a document count as
    toxic if one is.
    """
    taken = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            toxic = np.minimum(np.asarray(batch.column("toxic")), 1)
            for s, e in slices(np.diff(offsets), _SLICE):
                words, slot, sentence, _ = instances(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])
                for y, a, z in zip(toxic[s:e].tolist(), words.bounds[:-1], words.bounds[1:], strict=True):
                    yield y, slot[:, a:z], sentence[a:z]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, toxic = np.zeros(DEAD + 1, np.int64), np.zeros(DEAD + 1, np.int64)
        for y, slot, _ in each(batches):
            own = np.unique(slot)
            own = own[own < DEAD]
            present[own] += 1
            toxic[own] += y
            present[DEAD] += 1  # all documents
            toxic[DEAD] += y
        has = np.flatnonzero(present)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (has, present[has], toxic[has])], ["slot", "present", "toxic"])

    # the ids are at most ``sample``, which bounds what is broadcast; one text of each bounds what is kept
    labelled = bare(docs).join(F.broadcast(taken), "doc_id")
    texts = checkpoint(labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text"))
    sums = texts.mapInArrow(tidy(count), "slot long, present long, toxic long").groupBy("slot").agg(F.sum("present").alias("present"), F.sum("toxic").alias("toxic"))
    slot, present, toxic = (np.asarray(c) for c in sums.filter(F.col("present") >= F.when(F.col("slot") == DEAD, 1).otherwise(LEAST_DOCS)).toArrow().columns)  # a row for each slot at most
    every = slot == DEAD
    if not every.any():
        return fit_model([], slot)
    used = screened(slot[~every], present[~every], toxic[~every], int(present[every][0]), int(toxic[every][0]))
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(DEAD + 1, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for y, slot, sentence in each(batches):
            at = place[slot]
            i, k = np.nonzero(at.T >= 0)
            with_any, row = np.unique(sentence[i], return_inverse=True)
            n = int(sentence[-1] - sentence[0]) + 1 if len(sentence) else 0
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([n], pa.int64()), pa.array([pack(at[k, i], row.astype(np.int32))], pa.binary())], ["toxic", "sentences", "features"])

    # only features with a weight come to the driver
    rows = sorted((r.toxic, r.sentences, bytes(r.features)) for r in texts.mapInArrow(tidy(extract), "toxic int, sentences long, features binary").collect())
    return fit_model([(y, n, *unpack(features, "i4", "i4")) for y, n, features in rows], used)


def _scored(docs: DataFrame, model: Model, schema: str, emit) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for s, e in slices(np.diff(offsets), _SLICE):
                part = data[offsets[s] : offsets[e]]
                words, slot, sentence, doc = instances(part, offsets[s : e + 1] - offsets[s])
                yield emit(batch.slice(s, e - s), part, words, sentence, model.sentences(slot, sentence), doc, model)

    return docs.mapInArrow(tidy(score), schema)


def _with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """text, row (the other columns) and _score of each row."""
    inner = docs.select(F.col("text").cast("string").alias("text"), whole_row(docs, ("text",)))

    def emit(batch, part, words, sentence, p, doc, model):
        return batch.append_column("_score", pa.array(model.documents(p, doc, batch.num_rows), pa.float64()))

    return _scored(inner, model, StructType([*inner.schema.fields, StructField("_score", DoubleType())]), emit)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to the documents, in place of a column of that name: 0 where a text is null or has no
    word."""
    docs = docs.drop("score")
    return _with_scores(docs, model).select(*columns_of(docs, {"text": F.col("text")}), F.col("_score").alias("score"))


def non_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score stays under the threshold."""
    return _with_scores(docs, model).filter(F.col("_score") < threshold).select(*columns_of(docs, {"text": F.col("text")}))


def toxic_sentences(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The sentences whose own score reaches ``least``: doc_id, sentence, score.  Null and empty texts have
    none; repeated rows have theirs each."""

    def emit(batch, part, words, sentence, p, doc, model):
        hit = np.flatnonzero(p >= least)
        first, last = np.searchsorted(sentence, hit), np.searchsorted(sentence, hit, "right") - 1
        raw = part.tobytes()
        texts = [raw[words.starts[a] : words.ends[z]].decode("utf-8", "replace") for a, z in zip(first, last, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[hit])), pa.array(texts, pa.string()), pa.array(p[hit], pa.float64())], ["doc_id", "sentence", "score"])

    return _scored(bare(docs), model, "doc_id long, sentence string, score double", emit)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null id is not held out."""
    scored = toxicity(bare(docs), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
