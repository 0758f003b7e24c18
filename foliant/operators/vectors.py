"""Nearest neighbours by cosine among vectors of the same class.

Vectors are assigned to the nearest of a number of pivots, about a block of each class to a cell. From the radius and
count of each cell follows, by the triangle inequality, which cells can hold neighbours of the members of which; blocks of
the one are compared with blocks of the other. Cells are cut into blocks of bounded size on both sides, so a class or cell
that holds a third of all vectors becomes many small tasks, and a task returns at most ``k`` candidates per vector and
block: pairs are compared, never produced. A vector is sent to a block of others, not to every cell that it looks into, so
what is shuffled is the number of vectors times the number of blocks of their class. The result is exact; with ``probes``
only that many nearest cells are searched. Without clusters all blocks of a class meet: comparing is quadratic in the class
then, memory is not.

``approximate`` is for large collections: an inverted file of two levels. As many cells as the square root of the number
of vectors are trained on a bounded sample, in groups: a vector is compared with the centres of the groups and then with
those of the nearest groups, never with all cells. It is stored in one cell and looks for neighbours in a fixed number of
them. Where that number is greater than that of the blocks of a class, vectors meet block by block instead, with a bit for
each cell that they look into, and members of other cells are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialise

# Neighbours asked for.
K = 10

MAX_CELLS = 256
#: Vectors that centres are trained on, rounds of training, and groups of cells that a vector looks into.
SAMPLE, ROUNDS, GROUPS = 20_000, 8, 8
BLOCK = 8192
#: Pairs that a task holds at once.
HELD = 1 << 21
DIGITS = 9
#: What distances may differ by for vectors whose rounded similarities are equal.
SLACK = 1e-4


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(2.0 - 2.0 * (a @ b.T), 0.0, None))


def _pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    """``cells`` vectors chosen by a hash of their id: a bounded number of rows, the same on every run."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").collect()
    return _unit(np.array([r["vector"] for r in rows], dtype=np.float64)) if rows else np.zeros((0, 1))


def _blocks_of_class(vectors: DataFrame, block: int) -> int:
    """How many blocks the largest class has."""
    most = vectors.groupBy("class").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return max(1, -(-(most or 0) // block))


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, class, vector, cell, distance to the cell's pivot)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                gaps = _distances(_unit(_stack(frame["vector"])), pivots)
                cell = gaps.argmin(axis=1)
                yield frame.assign(cell=cell.astype("int32"), gap=gaps[np.arange(len(cell)), cell])

    kinds = dict(vectors.dtypes)
    return vectors.mapInPandas(work, f"id {kinds['id']}, class {kinds['class']}, vector {kinds['vector']}, cell int, gap double")


def _cells(assigned: DataFrame, k: int) -> DataFrame:
    """Per class: each cell's count, radius, and the distance within which it has k + 1 members."""
    near = Window.partitionBy("class", "cell").orderBy("gap", "id")
    kth = (
        assigned.select("class", "cell", "gap", "id")
        .withColumn("_rank", F.row_number().over(near))
        .filter(F.col("_rank") <= k + 1)
        .groupBy("class", "cell")
        .agg(F.max(F.when(F.col("_rank") == k + 1, F.col("gap"))).alias("kth"))
    )
    sizes = assigned.groupBy("class", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    return sizes.join(kth, ["class", "cell"])


def _pairs(cells: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(class, cell, other): the cells that can hold neighbours of the members of a cell. A class has few cells."""
    between = _distances(pivots, pivots)

    def work(known: pd.DataFrame) -> pd.DataFrame:
        cell, radius = known["cell"].to_numpy(), known["radius"].to_numpy()
        kth = known["kth"].to_numpy(dtype=np.float64, na_value=np.inf)
        kth = np.where(np.isnan(kth), np.inf, kth)
        apart = between[np.ix_(cell, cell)]
        # all members of a cell have k neighbours within that distance
        bound = (apart + kth[None, :]).min(axis=1) + radius + SLACK
        rows, others = np.nonzero(apart - radius[:, None] - radius[None, :] <= bound[:, None])
        return pd.DataFrame({"class": known["class"].iloc[rows].to_numpy(), "cell": cell[rows], "other": cell[others]})

    return cells.groupBy("class").applyInPandas(work, f"class {dict(cells.dtypes)['class']}, cell int, other int")


def _route(assigned: DataFrame, cells: DataFrame, pivots: np.ndarray, probes: int) -> DataFrame:
    """Each vector with the ``probes`` cells of its class that are nearest to it."""
    joined = assigned.join(cells.groupBy("class").agg(F.collect_list("cell").alias("cells")), "class")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            gaps = _distances(_unit(_stack(frame["vector"])), pivots)
            picks, owners = [], []
            for i, known in enumerate(frame["cells"]):
                cell = np.sort(np.asarray(known))
                wanted = cell[np.argsort(gaps[i, cell], kind="stable")[:probes]]
                picks.extend(wanted.tolist())
                owners.extend([i] * len(wanted))
            out = frame[["id", "class", "vector"]].iloc[owners].reset_index(drop=True)
            out["cell"] = np.array(picks, dtype="int32")
            yield out

    kinds = dict(assigned.dtypes)
    return joined.mapInPandas(work, f"id {kinds['id']}, class {kinds['class']}, vector {kinds['vector']}, cell int")


def knn(
    vectors: DataFrame, k: int = K, cells: int | None = None, block: int = BLOCK, probes: int | None = None
) -> DataFrame:
    """``vectors(id, class, vector)`` -> (id, neighbour, similarity, rank): the ``k`` most similar other vectors of
    the same class; equal similarities (nine digits) are ordered by id."""
    vectors = vectors.select("id", "class", "vector").filter("vector IS NOT NULL AND class IS NOT NULL")
    if cells is None:
        # about a block per class and cell, within a fixed number of pivots
        cells = min(MAX_CELLS, _blocks_of_class(vectors, block))
    pivots = _pivots(vectors, cells)
    assigned = materialise(assign(vectors, pivots), "assigned")
    sizes = _cells(assigned, k)
    if probes is None:
        return _nearest(assigned, assigned, _pairs(sizes, pivots), k, block)
    routed = materialise(_route(assigned, sizes, pivots, probes), "routed")
    return _nearest(routed, assigned, sizes.select("class", "cell", F.col("cell").alias("other")), k, block)


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest finite values of each row; of equal ones the first columns."""
    k = min(k, near.shape[1])
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
    rows, columns = np.nonzero((near >= least[:, None]) & np.isfinite(near))
    order = np.lexsort((columns, -near[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], columns[kept]


def _nearest(asking: DataFrame, members: DataFrame, pairs: DataFrame, k: int, block: int, looked: Column | None = None, own: Column | None = None) -> DataFrame:
    """The ``k`` nearest members for each asking vector, compared in blocks of bounded size.

    ``pairs(class, cell, other)`` tells which cell of members (``other``) the vectors of a cell are compared with.
    ``looked`` is a bit for each fine cell that a vector looks into; then only members whose fine cell is ``own`` count.
    """

    def cut(rows: DataFrame, cell: str, name: str) -> DataFrame:
        return rows.groupBy("class", F.col("cell").alias(cell)).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    grid = pairs.join(cut(asking, "cell", "qn"), ["class", "cell"]).join(cut(members, "other", "cn"), ["class", "other"])
    # at most the square of the number of cells for each class: one small row per pair of cells
    grid = materialise(grid, "grid")
    hashed = F.xxhash64("id")
    looked = F.lit(None).cast("binary") if looked is None else looked
    own = F.lit(None).cast("int") if own is None else own
    queries = asking.join(grid, ["class", "cell"]).select(
        "class", "cell", "other", F.pmod(hashed, "qn").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("cn") - 1)).alias("cb"), "id", "vector", looked.alias("looked")
    )
    # under names of their own: both sides may be one table
    against = members.select(*[F.col(c).alias(c) for c in ("class", "id", "vector")], F.col("cell").alias("other"), own.alias("own"))
    found_in = against.join(grid, ["class", "other"]).select(
        "class", "cell", "other", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"), F.pmod(hashed, "cn").cast("int").alias("cb"), "id", "vector", "own"
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        right = right.sort_values("id", kind="stable")
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        units, against = _unit(_stack(left["vector"])), _unit(_stack(right["vector"])).T
        masked = left["looked"].iloc[0] is not None
        fine = right["own"].to_numpy(dtype=np.int64) if masked else None
        step, out = max(1, HELD // len(others)), []
        for at in range(0, len(ids), step):
            near = np.round(units[at : at + step] @ against, DIGITS)
            near[~np.isfinite(near) | (ids[at : at + step, None] == others[None, :])] = -np.inf
            if masked:
                bits = np.stack([np.frombuffer(x, np.uint8) for x in left["looked"].iloc[at : at + step]])
                near[np.unpackbits(bits, axis=1)[:, fine] == 0] = -np.inf
            rows, columns = _best(near, k)
            out.append(pd.DataFrame({"id": ids[at + rows], "neighbour": others[columns], "similarity": near[rows, columns]}))
        return pd.concat(out)

    keys, kind = ["class", "cell", "other", "qb", "cb"], dict(asking.dtypes)["id"]
    found = (
        queries.groupBy(*keys)
        .cogroup(found_in.groupBy(*keys))
        .applyInPandas(compare, f"id {kind}, neighbour {kind}, similarity double")
    )
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), F.col("neighbour"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- inverted file


def _trained(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of unit vectors: rounds of assigning and averaging from evenly spaced points; empty ones stay."""
    centres = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        used = np.linalg.norm(sums, axis=1) > 0
        centres[used] = _unit(sums[used])
    return centres


def centres_of(vectors: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of groups, centres of about ``cells`` cells, and the group of each cell, from a bounded sample by hash."""
    n = vectors.count()
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * SAMPLE / max(n, 1)) * (1 << 30)))
    rows = vectors.filter(share).select("vector").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, np.int64)
    points = _unit(np.array([r["vector"] for r in rows], dtype=np.float64))
    groups = _trained(points, max(1, round(cells**0.5)))
    own = (points @ groups.T).argmax(axis=1)
    parts = [_trained(points[own == g], max(1, round(cells * (own == g).mean()))) for g in range(len(groups)) if (own == g).any()]
    kept = np.array([g for g in range(len(groups)) if (own == g).any()])
    return groups[kept], np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _near_cells(units: np.ndarray, groups: np.ndarray, cells: np.ndarray, group_of: np.ndarray, wanted: int, looked: int) -> np.ndarray:
    """The nearest ``wanted`` cells of each vector, by nearness, among those of its nearest ``looked`` groups; -1 where
    these have fewer."""
    looked = min(looked, len(groups))
    near = np.argsort(-(units @ groups.T), axis=1, kind="stable")[:, :looked]
    score = np.full((len(units), len(cells)), -np.inf)
    for g in range(len(groups)):
        rows, own = np.flatnonzero((near == g).any(axis=1)), np.flatnonzero(group_of == g)
        score[np.ix_(rows, own)] = units[rows] @ cells[own].T
    best = np.argsort(-score, axis=1, kind="stable")[:, :wanted]
    return np.where(np.isfinite(np.take_along_axis(score, best, axis=1)), best, -1)


def approximate(vectors: DataFrame, k: int = K, cells: int | None = None, probes: int = 16, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """As ``knn``, from the ``probes`` cells nearest to each vector among ``groups`` groups; some neighbours are missed.

    ``cells`` is the square root of the number of vectors by default. Vectors of length zero have no neighbours here.
    """
    vectors = vectors.select("id", "class", "vector").filter("vector IS NOT NULL AND class IS NOT NULL")
    if cells is None:
        cells = max(1, round(vectors.count() ** 0.5))
    centres = centres_of(vectors, cells)
    kinds = dict(vectors.dtypes)
    by_block = probes > 2 * _blocks_of_class(vectors, block)

    def place(wanted: int, bits: bool = False):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                units = _unit(_stack(frame["vector"]))
                found = _near_cells(units, *centres, wanted, 2 if wanted == 1 else groups)
                rows, places = np.nonzero(found >= 0)
                if bits:
                    seen = np.zeros((len(frame), max(1, len(centres[1]))), np.uint8)
                    seen[rows, found[rows, places]] = 1
                    yield frame.assign(cell=np.int32(0), looked=[x.tobytes() for x in np.packbits(seen, axis=1)])
                    continue
                out = frame.iloc[rows].reset_index(drop=True)
                yield out.assign(cell=found[rows, places].astype("int32"))

        return work

    shape = f"id {kinds['id']}, class {kinds['class']}, vector {kinds['vector']}, cell int"
    assigned = materialise(vectors.mapInPandas(place(1), shape), "assigned")
    if by_block:
        asking = materialise(vectors.mapInPandas(place(probes, True), f"{shape}, looked binary"), "asking")
        members = assigned.withColumn("own", F.col("cell")).withColumn("cell", F.lit(0))
        once = members.select("class", "cell", F.col("cell").alias("other")).distinct()
        return _nearest(asking, members, once, k, block, F.col("looked"), F.col("own"))
    routed = materialise(vectors.mapInPandas(place(probes), shape), "routed")
    return _nearest(routed, assigned, assigned.select("class", "cell", F.col("cell").alias("other")).distinct(), k, block)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(vectors, wanted, recall): the share of the exact neighbours that were found. Neighbours as near as the last exact
    one count, too."""
    last = exact.groupBy("id").agg(F.min("similarity").alias("_least"), F.count(F.lit(1)).alias("_wanted"))
    good = found.join(last, "id").filter("similarity >= _least").groupBy("id").agg(F.count(F.lit(1)).alias("_found"))
    both = last.join(good, "id", "left").select("_wanted", F.least(F.coalesce("_found", F.lit(0)), "_wanted").alias("_found"))
    return both.agg(F.count(F.lit(1)).alias("vectors"), F.sum("_wanted").alias("wanted"), (F.sum("_found") / F.sum("_wanted")).alias("recall"))
