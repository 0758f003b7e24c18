"""Published snapshots of a collection and keeping them in step with its history.

A snapshot is a plain Parquet table, ``<root>/<resource>/<name>``, partitioned by a hash of the id (``bucket``). Two small
Parquet tables beside them say what there is: ``published`` (resource, snapshot; buckets, the last history id that is in
it) and ``current`` (resource; snapshot). Publishing writes a new table and then the row in ``current``, so readers of the
collection never see a half-written one, and an older one can be made current again.

A sync finds what has a later history id than the snapshot, joins it with the buckets that hold such entries and overwrites
these partitions, with Spark's dynamic partition overwrite. History ids count up whatever the times say, so changes with
an older time are seen, too. A sync that was broken off is made good by the next one, as its row is written last.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import analyze
from foliant.operators.derive import Context, derive
from foliant.operators.history import heads, latest
from foliant.plans.spec import Spec, split_path
from foliant.session import materialise

#: Entries in a bucket, about, where the number of buckets is not given.
BUCKET_ROWS = 200_000

PUBLISHED = "resource string, snapshot string, buckets int, mark long, made double"
CURRENT = "resource string, snapshot string"


def _table(spark: SparkSession, root: str, name: str, shape: str) -> DataFrame:
    try:
        return spark.read.schema(shape).parquet(f"{root}/{name}")
    except Exception as err:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], shape)


def _put(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that have rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def _describe(spark: SparkSession, root: str, resource: str, snapshot: str, buckets: int, mark: int, made: float) -> None:
    _put(spark.createDataFrame([(resource, snapshot, buckets, mark, made)], PUBLISHED).coalesce(1), f"{root}/published", ["resource", "snapshot"])


def _point(spark: SparkSession, root: str, resource: str, snapshot: str) -> None:
    _put(spark.createDataFrame([(resource, snapshot)], CURRENT).coalesce(1), f"{root}/current", ["resource"])


def published(spark: SparkSession, root: str) -> DataFrame:
    """(resource, snapshot, buckets, mark, made, current): every snapshot there is."""
    now = _table(spark, root, "current", CURRENT).withColumn("current", F.lit(True))
    every = _table(spark, root, "published", PUBLISHED).join(now, ["resource", "snapshot"], "left")
    return every.withColumn("current", F.coalesce("current", F.lit(False)))


def current_snapshot(spark: SparkSession, root: str, resource: str):
    """The row of the current snapshot of a collection, or None."""
    return published(spark, root).filter((F.col("resource") == resource) & F.col("current")).first()


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def index_rows(hist: DataFrame, spec: Spec, context: Context | None = None) -> DataFrame:
    """What a snapshot holds: current entries with metadata and the searchable derived columns."""
    rows = latest(hist).select(
        F.lit(spec.name).alias("resource"),
        F.col("entity_id").alias("id"),
        "version",
        "last_modified",
        "last_modified_by",
        F.col("body").alias("entry"),
    )
    return derive(rows, spec, context, until="indexed")


def with_words(rows: DataFrame, paths: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Store the words of single-valued text fields beside the entries, for word predicates on many queries.

    Returns the rows and the mapping that predicates take as ``words``.
    """
    stored = {}
    for path in paths:
        name = "words_" + path.replace(".", "_")
        col = F.col("entry")
        for part in split_path(path):
            col = col.getField(part)
        rows = rows.withColumn(name, analyze(col))
        stored[path] = name
    return rows, stored


def _write(rows: DataFrame, folder: str, buckets: int, touched: DataFrame) -> None:
    """Write whole buckets. Each of ``touched(bucket)`` also has a row without an id, so that one with no entries left is
    overwritten like the others."""
    bucketed = rows.withColumn("bucket", bucket_of(buckets)).unionByName(touched.select("bucket"), allowMissingColumns=True)
    # one shuffle that brings a bucket to few tasks; a rebalance is split where a bucket is too large for one task
    _put(bucketed.hint("rebalance", F.col("bucket")), folder, ["bucket"])


def publish_snapshot(spark: SparkSession, hist: DataFrame, spec: Spec, root: str, context: Context | None = None, drop_old: bool = False, buckets: int | None = None) -> str:
    """Build a complete snapshot beside the old one and make it current; returns its name."""
    name = f"{spec.name}_{time.strftime('%Y-%m-%d-%H%M%S')}{time.time_ns() % 10**9:09d}"
    mark, entities = hist.agg(F.coalesce(F.max("history_id"), F.lit(-1)), F.approx_count_distinct("entity_id")).first()
    buckets = buckets or max(1, -(-entities // BUCKET_ROWS))
    _write(index_rows(hist, spec, context), f"{root}/{spec.name}/{name}", buckets, spark.range(1).select(F.lit(0).alias("bucket")))
    old = current_snapshot(spark, root, spec.name)
    _describe(spark, root, spec.name, name, buckets, mark, time.time_ns() / 1e9)
    _point(spark, root, spec.name, name)
    if drop_old and old is not None:
        _drop(spark, root, spec.name, old["snapshot"])
    return name


def publish_all(spark: SparkSession, collections: list[tuple[DataFrame, Spec]], root: str, context: Context | None = None, drop_old: bool = False, buckets: int | None = None) -> list[str]:
    """Publish every given collection (history and spec); returns the snapshot names."""
    return [publish_snapshot(spark, hist, spec, root, context, drop_old, buckets) for hist, spec in collections]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop(spark: SparkSession, root: str, resource: str, snapshot: str) -> None:
    """Remove a snapshot: first what names it, then its rows."""
    _remove(spark, f"{root}/published/resource={resource}/snapshot={snapshot}")
    _remove(spark, f"{root}/{resource}/{snapshot}")


def set_current(spark: SparkSession, root: str, resource: str, snapshot: str) -> None:
    """Make an older snapshot current again."""
    if published(spark, root).filter((F.col("resource") == resource) & (F.col("snapshot") == snapshot)).isEmpty():
        raise ValueError(f"no snapshot {snapshot} of {resource}")
    _point(spark, root, resource, snapshot)


def read_snapshot(spark: SparkSession, root: str, resource: str) -> DataFrame:
    """The current snapshot as entries."""
    now = current_snapshot(spark, root, resource)
    if now is None:
        raise ValueError(f"{resource} has no snapshot")
    return _rows(spark, root, now).drop("bucket")


def _rows(spark: SparkSession, root: str, now) -> DataFrame:
    return spark.read.parquet(f"{root}/{now['resource']}/{now['snapshot']}").filter("id IS NOT NULL")


def merge(snapshot: DataFrame, upserts: DataFrame, gone: DataFrame) -> DataFrame:
    """A snapshot with deletes and upserts applied; deleting an absent id does nothing."""
    changed = upserts.select("id").unionByName(gone.select("id")).distinct()
    return snapshot.join(changed, "id", "left_anti").unionByName(upserts, allowMissingColumns=True)


def apply_changes(spark: SparkSession, root: str, spec: Spec, upserts: DataFrame, gone: DataFrame, mark: int) -> int:
    """Overwrite the buckets of the current snapshot that hold a changed entry; returns how many."""
    now = current_snapshot(spark, root, spec.name)
    buckets = now["buckets"]
    upserts, gone = materialise(upserts, "upserts"), materialise(gone.select("id"), "deletes")
    touched = materialise(upserts.select("id").unionByName(gone).select(bucket_of(buckets).alias("bucket")).distinct(), "touched")
    hit = [r["bucket"] for r in touched.collect()]  # at most one number per bucket: only these partitions are read
    if hit:
        merged = merge(_rows(spark, root, now).filter(F.col("bucket").isin(hit)).drop("bucket"), upserts, gone)
        # written elsewhere first: the partitions that it is made of are replaced next
        _write(materialise(merged, "merged"), f"{root}/{spec.name}/{now['snapshot']}", buckets, touched)
    _describe(spark, root, spec.name, now["snapshot"], buckets, max(mark, now["mark"]), now["made"])
    return len(hit)


def sync_snapshot(spark: SparkSession, hist: DataFrame, spec: Spec, root: str, context: Context | None = None) -> int:
    """Apply everything with a later history id than the snapshot has; returns the number of buckets rewritten.

    The ids of what changed are read first, from three narrow columns; bodies are read of the newest rows of those only.
    """
    now = current_snapshot(spark, root, spec.name)
    fresh = hist.filter(F.col("history_id") > now["mark"])
    # the newest row of an entity that changed is itself a change
    newest = materialise(heads(fresh), "newest")
    mark = newest.agg(F.max("history_id")).first()[0]
    if mark is None:
        return 0
    gone = newest.filter("discarded").select(F.col("entity_id").alias("id"))
    return apply_changes(spark, root, spec, index_rows(newest, spec, context), gone, mark)


def refresh(spark: SparkSession, hist: DataFrame, spec: Spec, root: str, ids: DataFrame, context: Context | None = None) -> int:
    """Recompute the given entries ``ids(id)`` in the snapshot."""
    wanted = ids.select(F.col("id").cast("string").alias("entity_id")).distinct()
    some = hist.join(wanted, "entity_id", "left_semi")
    nothing = wanted.select(F.col("entity_id").alias("id")).limit(0)
    return apply_changes(spark, root, spec, index_rows(some, spec, context), nothing, -1)


def list_snapshots(spark: SparkSession, root: str, resources: list[str]) -> DataFrame:
    """(resource, name, current, size): every snapshot of the collections; ``missing`` where there is none."""
    asked = spark.createDataFrame([(r,) for r in resources], "resource string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    sizes = (
        files.select(F.regexp_extract("path", r"/([^/]+)/bucket=\d+/[^/]+$", 1).alias("snapshot"), "length")
        .groupBy("snapshot")
        .agg(F.sum("length").alias("size"))
    )
    described = published(spark, root).join(sizes, "snapshot", "left")
    return asked.join(described, "resource", "left").select(
        "resource", F.coalesce("snapshot", F.lit("missing")).alias("name"), F.coalesce("current", F.lit(False)).alias("current"), "size"
    )


def drop_snapshots(spark: SparkSession, root: str, resource: str) -> None:
    """Remove the current snapshot, as unpublishing or deleting a collection does."""
    now = current_snapshot(spark, root, resource)
    if now is not None:
        _remove(spark, f"{root}/current/resource={resource}")
        _drop(spark, root, resource, now["snapshot"])
