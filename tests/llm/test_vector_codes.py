"""Vector codes against brute force and SQL."""

import os

import numpy as np
import pytest

from foliant.llm import queries, vector_codes

FOLDER = "/root/testdata/sf0.001"


def plainly(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) and codebooks by comparing every part with every entry, in whole numbers."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64), label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.stack([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for turn in range(rounds + 1):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        code = [a.argmin(1) for a in d]
        for p in range(parts if turn < rounds else 0):
            for e in set(code[p].tolist()):
                own = x[code[p] == e, p]
                books[p][e] = own.sum(0) // len(own)
    error = sum(a.min(1) for a in d)
    by = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        by[label] = by.get(label, 0) + e
    out = [(i, "".join(f"{code[p][k]:02x}" for p in range(parts)), int(error[k]), by[label]) for k, (i, _, label) in enumerate(kept)]
    return out, vector_codes.digest(np.array(books))


def vectors(n, dims=32):
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 0.5, (7, dims))
    x = (centres[rng.integers(0, 7, n)] + rng.normal(0, 0.05, (n, dims))).astype(np.float32)
    x[: n // 4] = np.round(x[: n // 4] * 4) / 4  # ties
    x[n // 3 : n // 2] = x[0]  # one vector very often
    return [(i, [float(v) for v in row], int(rng.integers(0, 3)) if i % 7 else None) for i, row in enumerate(x)]


@pytest.mark.parametrize("n", [3, 64, 700])
def test_against_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 300)
    rows = vectors(n)
    odd = [(-1, None, 1), (-2, [], 1), (-3, [None] * 32, 1), (-4, [float("nan")] * 32, 1), (-5, [float("inf")] + [0.0] * 31, 2), (None, rows[0][1], 1), (1, rows[2][1], 0)]
    table = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<float>, label int, code string").repartition(2)
    coded, codebooks = vector_codes.compressed(table)
    want, books = plainly(rows + odd)
    assert sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=str) == sorted((w[:3] for w in want), key=str)
    assert vector_codes.digest(codebooks) == books
    assert vector_codes.compressed(table.limit(0))[0].count() == 0


def test_other_lengths_are_left_out(spark):
    rows = [(1, [0.5] * 32, 1), (2, [0.5] * 16, 1), (3, [0.5] * 31, 1), (4, [0.25] * 32, 1)]
    coded, _ = vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {1: ("00" * 16, 0), 4: ("01" * 16, 0)}


@pytest.mark.parametrize("leaf", [1, 8, 96])
def test_trees(leaf):
    rng = np.random.default_rng(leaf)
    points = np.unique(np.floor(rng.normal(0, 40, (3000, 4)) + rng.choice([-400, 0, 400], (3000, 1))), axis=0)
    weights = rng.integers(1, 5, len(points))
    tree = vector_codes.Tree(points, weights, leaf)
    assert sorted(map(tuple, tree.x.tolist())) == sorted(map(tuple, points.tolist())) and (tree.x[tree.place] == points).all()
    for a, b, c, r, s in zip(tree.start, tree.end, tree.centre, tree.radius, tree.sums, strict=True):
        assert vector_codes.squared(tree.x[a:b], c).max() == r and (s == (tree.x[a:b] * tree.w[a:b, None]).sum(0)).all()
    entries = np.concatenate([points[rng.integers(0, len(points), 30)], points[:2], points[:2], [[400, 400, 400, 400.0]]])
    code, sums, n, looked = tree.assigned(entries)
    want = vector_codes.squared(tree.x[:, None], entries[None]).argmin(1)
    assert (code == want).all() and n.sum() == weights.sum()
    for e in range(len(entries)):
        assert (sums[e] == (tree.x[want == e] * tree.w[want == e, None]).sum(0)).all()
    assert looked < len(points)  # some balls were taken whole


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not there")
def test_query_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    query, sql = queries.QUERIES["op12_vector_codes"]
    got = sorted(tuple(r) for r in query(spark, FOLDER).collect())
    assert got == sorted(con.execute(sql).fetchall())
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want, books = plainly(rows)
    assert got == sorted((*w, books) for w in want)
