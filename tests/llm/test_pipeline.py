"""The pipeline over the smallest driver tables, and the registered text queries."""

import os
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not there")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    assert set(docs.columns) <= set(out.columns) and 0 < out.select("doc_id").distinct().count() < docs.count()
    assert out.join(docs, ["doc_id", "text"], "left_anti").count() == 0
    assert out.filter("shard < 0 or shard > 39 or grown_shard not in (shard, 40)").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, class_doc int, mix_copies long, expected_grade string"


def fixture(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", 7, 9, "x") for i, t, s in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    known = [(i, int(i % 5 > 0), 0) for i, t, _ in rows if i is not None and i % 2 == 0] + [(None, 1, 0), (2, None, None)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(f"b{k}" for k in range(14))), (2, None), (3, ""), (4, "only three words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text or "").split()


def test_stages_against_plain_rules(spark, tmp_path):
    """Nulls, empty and repeated rows, ties and clashing columns; each stage on what the one before it has written."""
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base = [prose(80) for _ in range(30)]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(base)]
    rows += [(100 + i, base[i] + " one more", None) for i in range(5)] + [(200 + i, base[i].upper(), "a") for i in range(3)]
    rows += [(300, " ".join(f"B{k}," for k in range(14)) + " " + prose(40), "b"), (301, prose(20) + " only three words " + prose(20), "c"), (302, " ".join(f"b{k}" for k in range(9)) + " " + prose(30), "c")]
    rows += [(400, None, "a"), (401, "", None), (402, " \n ", "b"), (None, prose(30), "a"), (None, None, None), rows[7], rows[7], (403, prose(4000), "c")]
    docs = fixture(spark, str(tmp_path), rows)
    at = {}
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at[name] = ([tuple(r) for r in given.collect()], [tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()])
        given = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sharding":
            assert given.columns == docs.columns
    key = lambda r: tuple(map(str, r))

    before, after = at["quality classifier"]
    assert not Counter(after) - Counter(before) and len(after) > 0

    before, after = at["MinHash near-dedup"]
    kept = {r[0] for r in after}
    by_words = {}
    for r in before:
        if r[0] is not None and words(r[1]):
            by_words.setdefault(" ".join(words(r[1])[:60]), []).append(r[0])  # copies here share their first sixty words
    for group in by_words.values():
        assert {i for i in group if i in kept} == {min(group)}
    assert {r[0] for r in before if not words(r[1])} <= kept | {None}
    assert all(n == 1 for r, n in Counter(after).items() if words(r[1]))

    before, after = at["benchmark decontamination"]
    hit = lambda t: any(w in f" {' '.join(words(t))} " for w in [" only three words "] + [f" {' '.join(f'b{k}' for k in range(s, s + 10))} " for s in range(5)])
    assert sorted(after, key=key) == sorted((r for r in before if not hit(r[1])), key=key)

    before, after = at["mixing to target weights"]
    copies = Counter(after)
    assert not copies.keys() - set(before) and all(copies[r] <= 3 * n for r, n in Counter(before).items())
    assert sum(len((r[1] or "").split()) for r in after) == pytest.approx(sum(len((r[1] or "").split()) for r in before), rel=0.2)

    before, after = at["sharding"]
    assert given.columns == [*docs.columns, "_shard", "grown_shard"]
    assert sorted((r[:-2] for r in after), key=key) == sorted(before, key=key)
    assert all(0 <= r[-2] < 40 and r[-1] in (r[-2], 40) for r in after) and len({(r[0], r[-2]) for r in after}) == len({r[0] for r in after})


def test_empty_table(spark, tmp_path):
    fixture(spark, str(tmp_path), [(1, "a b c", "a")])
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
