"""Vectors as short codes: one codebook per part of the vector, fitted by rounds over metric trees.

A component x becomes the whole number floor(256 x). A vector is cut into ``PARTS`` equal parts, and each part gets the
index of the nearest entry of its codebook. A round assigns all parts and moves each entry to the mean of its parts,
rounded down.

Trees. The vectors of a task are taken in blocks of bounded size, and each part position of a block gets a metric tree by
the anchors hierarchy: anchors are added one after the other at the point farthest from its anchor, and take over the
points nearer to them, where the triangle inequality lets most points be passed over; then, from the middle out, anchors
are joined upwards by the smallest ball that holds two of them, and large anchors are divided downwards in the same way.
A ball caches the sum and the number of its points. The forest of all blocks is written once.

Rounds. A round walks the trees from their roots with the list of entries that may be nearest to some point of the ball.
An entry leaves the list where another one is nearer (or as near, with a lower index) for every point of the ball, and
what is below inherits the shorter list. A ball with one entry left belongs to it whole: its cached sum and number are
added and its points are not looked at. Tasks send one partial sum per entry and component; only the codebooks, whose
size the parameters bound, come to the driver.

All distances are whole numbers, held exactly in doubles; components beyond ``bound(width)`` (32768.0 for parts of 4)
count as that bound, so that they stay exact.

Nulls, ties, edges: rows whose vector is null, empty or holds null or non-finite components are left out, and so are
vectors that do not have a multiple of ``PARTS`` components or another length than the vector with the least id. Equal
distances go to the lower index. The codebooks start with the least ids, null ids last, equal ids by their vectors; with
fewer vectors than entries the codebooks are shorter. Repeated rows count as often as they occur. Null labels are one
label. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, written
from foliant.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and points of a ball that is not divided.
BLOCK, LEAF = 8192, 96
SLACK = 1 + 1e-9


def bound(width: int) -> int:
    """The largest component for which the distances of parts of ``width`` components are exact in doubles."""
    return 1 << (50 - width.bit_length()) // 2


def whole(vectors: np.ndarray, width: int) -> np.ndarray:
    """floor(256 x), held to the bound."""
    most = bound(width)
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -most, most)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to y."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def anchors(x: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each point, numbered from 0: up to k anchors, each at the point that lay farthest from its anchor."""
    owner = np.zeros(len(x), np.int64)
    at = [0]
    away = squared(x, x[0])
    while len(at) < k:
        new = int(away.argmax())
        if not away[new]:
            break
        between = squared(x[at], x[new])
        # a point nearer to its anchor than half the way from there to the new one stays
        open_ = np.flatnonzero(4 * away > between[owner])
        d = squared(x[open_], x[new])
        taken = d < away[open_]
        owner[open_[taken]], away[open_[taken]] = len(at), d[taken]
        at.append(new)
    return owner


class Tree:
    """Balls over weighted points; points are in the order of the leaves, so that each ball is a range of them."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.x, self.w = points, weights
        self.balls: list[tuple] = []  # start, end, left, right
        self.order: list[np.ndarray] = []
        self.placed = 0
        self.root = self._built(self._divided(np.arange(len(points)))) if len(points) else -1
        order = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.x, self.w = points[order], weights[order]
        spans = np.array(self.balls, np.int64).reshape(-1, 4)
        self.start, self.end, self.left, self.right = spans.T
        total = np.concatenate([np.zeros((1, points.shape[1])), np.cumsum(self.x * self.w[:, None], 0)])
        number = np.concatenate([[0], np.cumsum(self.w)])
        self.sums, self.n = total[self.end] - total[self.start], number[self.end] - number[self.start]
        self.centre = np.round(self.sums / np.maximum(self.n, 1)[:, None])
        self.radius = np.array([squared(self.x[a:b], c).max() for a, b, c in zip(self.start, self.end, self.centre, strict=True)])
        del self.balls, self.order, self.placed, self.leaf

    def _divided(self, points: np.ndarray):
        """A leaf as its points, a ball as its two halves: divide by anchors, then join these by the smallest balls."""
        if len(points) <= self.leaf:
            return points
        x = self.x[points]
        owner = anchors(x, max(2, int(np.sqrt(len(points)))))
        k = int(owner.max()) + 1
        by = np.argsort(owner, kind="stable")
        groups = np.split(points[by], np.cumsum(np.bincount(owner, minlength=k))[:-1])
        if k == 1:
            return points
        nodes = [self._divided(g) for g in groups]
        n = np.array([len(g) for g in groups], float)
        centre = np.stack([self.x[g].mean(0) for g in groups])
        radius = np.array([np.sqrt(squared(self.x[g], c).max()) for g, c in zip(groups, centre, strict=True)])
        joint = lambda a, b: (np.sqrt(squared(centre[a], centre[b])) + radius[a] + radius[b]) / 2
        size = np.full((k, k), np.inf)
        for i in range(k):
            size[i, i + 1 :] = joint(np.arange(i + 1, k), i)
        left = np.ones(k, bool)
        for _ in range(k - 1):
            i, j = divmod(int(size.argmin()), k)
            radius[i] = max(size[i, j], radius[i], radius[j])
            centre[i] = (centre[i] * n[i] + centre[j] * n[j]) / (n[i] + n[j])
            n[i] += n[j]
            nodes[i] = (nodes[i], nodes[j])
            left[j] = False
            size[j, :] = size[:, j] = np.inf
            others = np.flatnonzero(left)
            others = others[others != i]
            size[np.minimum(others, i), np.maximum(others, i)] = joint(others, i)
        return nodes[0]

    def _built(self, node) -> int:
        """Number the balls and place the points of the leaves, without recursion."""
        number = len(self.balls)
        waiting = [(node, None, 0)]
        while waiting:
            node, parent, side = waiting.pop()
            if node is None:  # both halves are placed
                self.balls[parent][1] = self.placed
                continue
            own = len(self.balls)
            self.balls.append([self.placed, 0, -1, -1])
            if parent is not None:
                self.balls[parent][side] = own
            if isinstance(node, tuple):
                waiting += [(None, own, 0), (node[1], own, 3), (node[0], own, 2)]
            else:
                self.order.append(node)
                self.placed += len(node)
                self.balls[own][1] = self.placed
        return number

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entry of each point, sums and numbers of each entry, and how many points were looked at one by one."""
        k, looked = len(entries), 0
        code = np.zeros(len(self.x), np.int64)
        sums, n = np.zeros((k, self.x.shape[1])), np.zeros(k)
        between = squared(entries[:, None], entries[None])
        balls, lists = np.array([self.root] if self.root >= 0 else [], np.int64), np.ones((int(self.root >= 0), k), bool)
        while len(balls):
            away = np.where(lists, squared(self.centre[balls][:, None], entries[None]), np.inf)
            best = away.argmin(1)
            more = away - away[np.arange(len(balls)), best][:, None]
            reach = between[best] * self.radius[balls][:, None]
            lists &= ~((more > 2 * np.sqrt(reach) * SLACK) | (reach == 0) & (more >= 0))
            lists[np.arange(len(balls)), best] = True
            alone = lists.sum(1) == 1
            for ball, e in zip(balls[alone].tolist(), best[alone].tolist(), strict=True):
                code[self.start[ball] : self.end[ball]] = e
                sums[e] += self.sums[ball]
                n[e] += self.n[ball]
            leaf = ~alone & (self.left[balls] < 0)
            for ball, own in zip(balls[leaf].tolist(), lists[leaf], strict=True):
                listed = np.flatnonzero(own)
                a, b = self.start[ball], self.end[ball]
                near = listed[squared(self.x[a:b, None], entries[listed][None]).argmin(1)]
                code[a:b] = near
                np.add.at(sums, near, self.x[a:b] * self.w[a:b, None])
                np.add.at(n, near, self.w[a:b])
                looked += b - a
            inner = ~alone & (self.left[balls] >= 0)
            balls, lists = np.concatenate([self.left[balls[inner]], self.right[balls[inner]]]), np.concatenate([lists[inner], lists[inner]])
        return code, sums, n, looked


class Forest:
    """The trees of a block, one for each part, over its distinct parts."""

    def __init__(self, vectors: np.ndarray, parts: int):
        self.trees, self.places = [], []
        width = vectors.shape[1] // parts
        for x in np.split(whole(vectors, width), parts, 1):
            distinct, at, weights = np.unique(x, axis=0, return_inverse=True, return_counts=True)
            tree = Tree(distinct, weights)
            self.trees.append(tree)
            self.places.append(tree.place[at.ravel()].astype(np.int32))


def _blocks(parts: int, schema: pa.Schema):
    def grown(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(rows)
        flat = pa.concat_arrays([c.flatten() for c in block.column("embedding").chunks]).to_numpy(zero_copy_only=False)
        forest = pickle.dumps(Forest(flat.reshape(block.num_rows, -1), parts), protocol=5)
        row = [block.column("vec_id").to_pylist()], [block.column("label").to_pylist()], [forest]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = BLOCK - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == BLOCK:
                    yield grown(held)
                    held = []
        if held:
            yield grown(held)

    return run


def _summed(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task's parts add up to: one row per part, entry and component."""
        parts, entries, width = codebooks.shape
        sums, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for data in batch.column("forest"):
                for p, tree in enumerate(pickle.loads(data.as_py()).trees):
                    _, s, k, _ = tree.assigned(codebooks[p])
                    sums[p] += s.astype(np.int64)
                    n[p] += k.astype(np.int64)
        p, e = np.nonzero(n)
        places = [np.repeat(x, width) for x in (p, e)] + [np.tile(np.arange(width), len(p))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in places] + [pa.array(sums[p, e].ravel()), pa.array(np.repeat(n[p, e], width))], names=["part", "entry", "place", "total", "n"])

    return run


def _coded(codebooks: np.ndarray, label: pa.DataType):
    digits = 2 if codebooks.shape[1] <= 256 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                forest, codes, error = pickle.loads(row["forest"]), [], 0
                for p, (tree, place) in enumerate(zip(forest.trees, forest.places, strict=True)):
                    code = tree.assigned(codebooks[p])[0]
                    error = error + squared(tree.x, codebooks[p][code])[place].astype(np.int64)
                    codes.append(code[place])
                text = ["".join(f"{c:0{digits}x}" for c in own) for own in np.stack(codes, 1).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], label), pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame, parts: int) -> DataFrame:
    """The rows (vec_id, embedding, label) whose vectors can be coded, without those of another length than the first."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    n = F.size("embedding")
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    some = some.filter(F.col("embedding").isNotNull() & (n > 0) & (n % parts == 0) & ~F.coalesce(bad, F.lit(True)))
    first = some.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(n.alias("n")).limit(1).collect()
    return some.filter(n == (first[0].n if first else 0))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each vector that can be coded, and the codebooks by part, entry and component."""
    from pyspark.sql.pandas.types import to_arrow_type

    some = usable(vectors, parts)
    heads = some.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = np.array([r.embedding for r in heads]).reshape(len(heads), parts, -1) if heads else np.zeros((0, parts, 1))
    codebooks = whole(start, start.shape[2]).transpose(1, 0, 2).copy()
    kind = some.schema["label"].dataType
    schema = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(to_arrow_type(kind))), ("forest", pa.binary())])
    forest = written(some.mapInArrow(_blocks(parts, schema), f"vec_ids array<bigint>, labels array<{kind.simpleString()}>, forest binary"), "forest")
    for _ in range(rounds if heads else 0):
        sums = forest.mapInArrow(_summed(codebooks), "part int, entry int, place int, total long, n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            codebooks[r.part, r.entry, r.place] = r.total // r.n
    return forest.mapInArrow(_coded(codebooks, to_arrow_type(kind)), f"vec_id long, label {kind.simpleString()}, code string, error long"), codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in codebooks.ravel()).encode()).hexdigest()


def query(spark: SparkSession, folder: str) -> DataFrame:
    coded, codebooks = compressed(table(spark, folder, "embeddings"))
    coded = materialise(coded, "codes")
    labels = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.join(labels.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _assigned(number: int) -> str:
    """Each part with the entry of codebook ``number`` that it is nearest to."""
    return f"""a{number} AS (
  SELECT id, p, any_value(x) AS x, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d
  FROM (SELECT id, part.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM part JOIN c{number} ON part.p = c{number}.p) GROUP BY id, p)"""


def _moved(number: int) -> str:
    """Codebook ``number`` + 1: the means, rounded down, of what codebook ``number`` was given."""
    return f"""c{number + 1} AS (
  SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{number} c LEFT JOIN (
    SELECT p, e, list(t ORDER BY i) AS c
    FROM (SELECT p, e, i, CASE WHEN sum(x[i]) >= 0 THEN sum(x[i]) // count(*) ELSE -((-sum(x[i]) + count(*) - 1) // count(*)) END::BIGINT AS t
          FROM a{number}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM part) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e
  ) m ON c.p = m.p AND c.e = m.e)"""


#: For vectors of one length that is a multiple of 16, with components within the bound.
SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (
  SELECT id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)
), c0 AS (
  SELECT p, id - 1 AS e, x AS c FROM part WHERE id <= 64
), {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)}, coded AS (
  SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY id
), sums AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (id) GROUP BY label
)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM coded JOIN kept USING (id) JOIN sums ON kept.label IS NOT DISTINCT FROM sums.label
"""
