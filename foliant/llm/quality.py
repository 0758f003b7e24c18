"""Quality classifier: ordinal regression with cumulative links on graded ratings of documents.

P(grade <= j | x) = sigmoid(threshold_j - w.x). One weight vector over hashed features of the text is shared by all
grades; the thresholds are kept in order. The expected grade ranks documents, and the probability of the best grade
selects them.

Grades come from the labels: 0 for toxic, 1 for low quality, 2 for neither. Features say whether a word occurs, which
share of the words has which shape (letters, capitals and signs), and how often a word follows itself.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the least hashes of their id, as one pass on
numbers in the driver. Everything else is one pass over all texts.

Nulls, ties, edges: a null text counts as empty and has no features, so that it gets the prior; of several labels of one
document the worst counts; labels without a grade are not used; with fewer than two grades there is nothing to learn,
and every document is kept with the probability of the share of good labels (1 without labels). Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import encoded_words, fresh, mixed, plain_words, table, word_hashes

BITS = 18
SAMPLE = 16_000
#: A feature has to occur in so many of the sampled documents.
LEAST_DOCUMENTS = 4
ROUNDS, RATE, DECAY = 150, 0.05, 0.5
LEAST_TAIL = 0.5
GRADES = 3
_RUNS = [(re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0")]


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def _shape(word: str) -> str:
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[:8]


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The hashed features of each text, each once."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    mask = np.uint64((1 << BITS) - 1)
    out = []
    counts, codes, words = encoded_words(data)
    shapes: dict[str, int] = {}
    shape_of = np.array([shapes.setdefault(_shape(w), len(shapes)) for w in words.to_pylist()], np.int64)
    names = np.array([hash_text(f"shape {s}") for s in shapes], np.uint64)
    plain_counts, plain_codes, plain = encoded_words([b" ".join(plain_words(t)) for t in texts])
    hashes = word_hashes(plain)
    at = plain_at = 0
    for n, m in zip(counts, plain_counts, strict=True):
        own, own_plain = codes[at : at + n], plain_codes[plain_at : plain_at + m]
        at, plain_at = at + n, plain_at + m
        found = [hashes[own_plain]]
        if n:
            share = np.bincount(shape_of[own], minlength=len(shapes)) / n
            some = np.flatnonzero(share)
            found.append(mixed(names[some] + np.floor(np.log2(share[some]) + 16).astype(np.uint64)))
            again = (own[1:] == own[:-1]).mean() if n > 1 else 0.0
            found.append(mixed(np.array([hash_text("again") + np.uint64(int(again * 8))], np.uint64)))
        out.append(np.unique((np.concatenate(found) & mask).astype(np.int32)))
    return out


def hash_text(text: str) -> np.uint64:
    return word_hashes(pa.array([text]))[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Maximum likelihood with decaying weights, by gradient steps that adapt to each weight."""
    share = np.bincount(grades, minlength=GRADES) / max(1, len(grades))
    below = np.clip(np.cumsum(share)[:-1], 1e-4, 1 - 1e-4)
    thresholds = np.log(below / (1 - below))
    weights = np.zeros(1 << BITS)
    if (share > 0).sum() < 2:
        return Model(weights, thresholds)
    lengths = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    often = np.bincount(flat, minlength=1 << BITS) >= LEAST_DOCUMENTS
    owner, flat = owner[often[flat]], flat[often[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    w, speed, momentum = np.zeros(len(used)), np.full(len(used), 1e-8), np.zeros(len(used))
    t, t_speed = thresholds.copy(), np.full(len(thresholds), 1e-8)
    for _ in range(ROUNDS):
        score = np.bincount(owner, w[flat], len(rows))
        edges = np.concatenate([[-1e3], t, [1e3]])
        high, low = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        p = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high) / p, low * (1 - low) / p
        pull = (slope_high - slope_low) / len(rows)
        g = np.bincount(flat, pull[owner], len(used)) + DECAY * w / len(rows)
        gt = np.array([((grades == j + 1) * slope_low - (grades == j) * slope_high).sum() for j in range(len(t))]) / len(rows)
        momentum = 0.9 * momentum + 0.1 * g
        speed, t_speed = 0.99 * speed + 0.01 * g * g, 0.99 * t_speed + 0.01 * gt * gt
        w -= RATE * momentum / np.sqrt(speed + 1e-12)
        t = np.maximum.accumulate(t - RATE * gt / np.sqrt(t_speed + 1e-12))
    weights[used] = w
    return Model(weights, t)


def judged(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and probability of the best grade."""
    score = np.array([model.weights[x].sum() for x in features(texts)])
    beyond = 1 - _sigmoid(model.thresholds[:, None] - score)
    return beyond.sum(0), beyond[-1]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the model on the labelled documents among ``docs``."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    graded = labels.select("doc_id", grade.alias("grade")).filter("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``sample`` rows of two numbers
    texts = texts.dropDuplicates(["doc_id"]).select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("grade").cast(pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["grade", "features"])

    # sorted, so that sums are added in the same order in every run
    rows = sorted(texts.mapInArrow(run, "grade long, features binary").collect(), key=lambda r: (r[0], bytes(r[1])))
    return fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["grade"] for r in rows], np.int64))


def scored(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("expected_grade", "tail")) -> DataFrame:
    """``docs`` with the expected grade and the probability of the best grade."""
    schema = docs.withColumns({c: F.lit(0.0) for c in into}).schema
    names = schema.fieldNames()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = dict(zip(into, map(pa.array, judged(sent.value, batch.column(text).to_pylist())), strict=True))
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The documents that are likely to be of the best grade, whole and unchanged."""
    grade, tail = fresh(docs, "expected_grade", "tail")
    return scored(docs, train(docs, labels), into=(grade, tail)).filter(F.col(tail) >= least_tail).drop(grade, tail)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, folder, "labels")))
    return out.select("doc_id", "expected_grade", "tail", (F.col("tail") >= LEAST_TAIL).alias("kept"))
