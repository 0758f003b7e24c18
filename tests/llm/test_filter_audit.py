"""The filter audit against brute force and SQL."""

import itertools
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import filter_audit, queries
from foliant.llm.packing import unpack_numbers

FOLDER = "/root/testdata/sf0.001"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plainly(docs, labels):
    """Every document through every order, filter by filter."""
    last = float("inf")
    first = {}
    for i, text, _ in docs:
        first[text or ""] = min(first.get(text or "", last), last if i is None else i)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = {}, Counter()
    for i, text, lang in docs:
        t, part = text or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), first[t] < (last if i is None else i))
        fails = {f for f, bad in zip("ABCDE", tests, strict=True) if bad}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((part, "".join(order), step), Counter())
                now = not gone and f in fails
                row.update(kept=not gone and not now, removed=now, redundant=gone and f in fails, unique_fails=fails == {f}, good_lost=now and i in good, toxic_lost=now and i in toxic)
                shapley[part, f] += now
                gone |= now
    return {k: (*(row[c] for c in COUNTS[:-1]), shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


WORDS = ["a", "A", "the", "größe", "\x1c", "\x85", " ", "x|y", "50%", "BIG", "big", "\x00", "word"]


def documents():
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(WORDS, rng.choice([1, 199, 200, 201, 400]), p=None).tolist()) for _ in range(60)]
    texts += [" ".join(f"w{k}" for k in rng.integers(0, n, 300)) for n in (60, 150, 151, 10_000) for _ in range(15)]
    texts += [None, "", " \n\t\x0b\x0c\r", "#", "same text", "same text", "long " * 50_000]
    texts += [str(t) for t in rng.choice([t for t in texts if t], 40)]
    ids = [int(i) for i in rng.permutation(len(texts))]
    docs = [(None if i % 31 == 0 else i, t, [None, "", "en", "de"][i % 4]) for i, t in zip(ids, texts, strict=True)]
    return docs + docs[:5] + [(3, "same text", "de"), (3, "same text", "en")]


@pytest.mark.parametrize("size", [1, 2000, 8 << 20])
def test_against_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
    docs = documents()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 150, 2)] + [(4, 1, 0), (6, None, 1), (8, 1, None), (None, 1, 1), (2, 0, 0)]
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, fails string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audited(filter_audit.failures(table), known)
    assert rows_of(out) == plainly(docs, labels)
    assert filter_audit.audited(filter_audit.failures(table.limit(0)), known.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_matrix_has_one_dictionary(spark, monkeypatch, parts):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 1)
    texts = ["b a b", "c a", "", "a a a b größe", None, "größe\x0bd"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    matrix, dictionary = filter_audit.matrix(docs, parts)
    words = {r.term: r.word for r in dictionary.collect()}
    assert sorted(words) == list(range(5)) and sorted(words.values()) == sorted({"a", "b", "c", "d", "größe"})
    found = {}
    for r in matrix.collect():
        indptr, indices, counts = (unpack_numbers(r[c]).tolist() for c in ("indptr", "indices", "counts"))
        for i, a, b in zip(r.doc_ids, indptr[:-1], indptr[1:], strict=True):
            assert indices[a:b] == sorted(indices[a:b])
            found[i] = {words[t]: n for t, n in zip(indices[a:b], counts[a:b], strict=True)}
    assert found == {i: dict(Counter((t or "").split())) for i, t in enumerate(texts)}
    assert filter_audit.term_counts(pa.array([], pa.large_string()))[1].tolist() == [0]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not there")
def test_query_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    query, sql = queries.QUERIES["op11_filter_audit"]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in (dict(zip(names, x, strict=True)) for x in found.fetchall())}
    assert rows_of(query(spark, FOLDER)) == want
