"""Main results of operators against plain implementations."""

import math
import os
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest


from foliant.llm import near_documents, quality, scoring, sharding

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not there")


def test_interpolated_scores(spark):
    """Deleted interpolation token by token, without grouping what is learned from."""
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(0, 30), p=share / share.sum())) for _ in range(250)] + ["new words here", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.score for r in scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    split = {i: [*(t or "").split(), None] for i, t in rows}
    train = [split[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    one, two, total = Counter(), Counter(), 0
    for own in train:
        one["^"] += 1
        for a, b in zip(["^", *own], own, strict=False):
            one[b] += 1
            two[a, b] += 1
        total += len(own)
    vocabulary = len(one) - 1
    bucket = lambda n: int(math.log2(n)) + 1 if n > 0 else 0
    ratio = lambda a, b: a / b if a > 0 and b > 0 else 0.0
    kept = defaultdict(list)
    for own in train:
        for a, b in zip(["^", *own], own, strict=False):
            kept[bucket(one[a] - 1)].append((ratio(two[a, b] - 1, one[a] - 1), ratio(one[b] - 1, total - 1), 1 / (vocabulary + 1)))
    weights = {}
    for b, p in kept.items():
        p, w = np.array(p), np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
        for _ in range(scoring.ROUNDS):
            parts = p * w
            w = (parts / np.maximum(parts.sum(1, keepdims=True), 1e-300)).mean(0)
        weights[b] = w
    known = sorted(weights)
    for i, own in split.items():
        want = 0.0
        for a, b in zip(["^", *own], own, strict=False):
            w = weights[max((k for k in known if k <= bucket(one[a])), default=known[0])]
            want += math.log10(w @ np.array([ratio(two[a, b], one[a]), ratio(one[b], total), 1 / (vocabulary + 1)]))
        assert got[i] == pytest.approx(want, rel=0.03, abs=0.1)


def test_shards_are_the_best_scores(spark):
    """Scores recomputed from the hash of key and shard."""
    xxhash = pytest.importorskip("xxhash")
    ids = [0, 1, -5, 2**40, None, *range(100, 400)]
    rows = spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string")

    def best(key, shards):
        found = []
        for shard in range(shards):
            seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            u = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11) + 0.5) * 2.0**-53
            found.append((1 / -math.log(u), -shard))
        return -max(found)[1]

    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.placed(rows).collect()}
    assert got == {i: (best(i, 40), best(i, 41)) for i in ids}


def test_grades_are_fitted(spark):
    """The likelihood of the fit against that of a plain optimiser of the same likelihood."""
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in range(40)]
    lean = rng.normal(0, 1, 40)
    texts, grades = [], []
    for _ in range(300):
        some = rng.integers(0, 40, 25)
        texts.append(" ".join(words[k] for k in some))
        grades.append(int(np.digitize(lean[some].sum() + rng.logistic(0, 2), [-3, 3])))
    found, grades = quality.features(texts), np.array(grades)
    model = quality.fit(found, grades)

    used = np.unique(np.concatenate(found))
    often = [u for u in used if sum((x == u).sum() for x in found) >= quality.LEAST_DOCUMENTS]
    x = np.array([[(f == u).sum() for u in often] for f in found], float)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def loss(w, t):
        edges = np.concatenate([[-1e3], t, [1e3]])
        score = x @ w
        p = sigmoid(edges[grades + 1] - score) - sigmoid(edges[grades] - score)
        return -np.log(np.maximum(p, 1e-9)).mean() + quality.DECAY * (w @ w) / 2 / len(grades)

    def slope(w, t):
        edges = np.concatenate([[-1e3], t, [1e3]])
        score = x @ w
        high, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        p = np.maximum(high - low, 1e-9)
        a, b = high * (1 - high) / p, low * (1 - low) / p
        return x.T @ (a - b) / len(grades) + quality.DECAY * w / len(grades), np.array([((grades == j + 1) * b - (grades == j) * a).sum() for j in range(len(t))]) / len(grades)

    w, t = np.zeros(len(often)), model.thresholds.copy()
    for _ in range(6000):
        gw, gt = slope(w, t)
        w, t = w - 0.3 * gw / max(1.0, np.abs(x).sum(1).max() / 10), t - 0.3 * gt
    start = loss(np.zeros(len(often)), model.thresholds)
    fitted = loss(model.weights[np.array(often)], model.thresholds)
    assert fitted <= loss(w, t) + 0.1 * (start - loss(w, t))


@needs_data
def test_near_documents_are_those_of_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.class_id for r in near_documents.query(spark, FOLDER).collect()}
    found, often, keys = near_documents.shingles([r.text for r in rows])
    frequency = Counter(int(s) for own in found for s in own)
    documents = sum(k is not None for k in keys)
    weights = [dict(zip(map(int, own), (n * np.log1p(documents / np.array([frequency[int(s)] for s in own]))).tolist(), strict=True)) if len(own) else {} for own, n in zip(found, often, strict=True)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(weights):
        for j in range(i):
            shared = a.keys() & weights[j].keys()
            both = sum(min(a[s], weights[j][s]) for s in shared)
            if both and both / (sum(a.values()) + sum(weights[j].values()) - both) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    assert got == {r.doc_id: least[root(i)] for i, r in enumerate(rows)}
    assert len(set(got.values())) < len(rows)
