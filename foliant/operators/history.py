"""The append-only change log: latest state, as-of lookups, history pages.

History rows: ``history_id, entity_id, version, last_modified, last_modified_by, body, status, message, op, discarded``
and ``extra``, what a record holds beside its declared members (``functions.rest``); tables without it have none.
``history_id`` is a unique increasing integer, so ``history_id div WIDTH`` splits even one entity that holds a large
part of the log into groups of bounded size; per-entity running values are made inside those groups and carried
from group to group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operations, status and the default history page.
ADDED, UPDATED, DELETED = "ADDED", "UPDATED", "DELETED"
IN_PROGRESS = "IN-PROGRESS"
HISTORY_PAGE = 100

WIDTH = 1 << 20


def history_type(body: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("history_id", T.LongType()),
            T.StructField("entity_id", T.StringType()),
            T.StructField("version", T.IntegerType()),
            T.StructField("last_modified", T.DoubleType()),
            T.StructField("last_modified_by", T.StringType()),
            T.StructField("body", body),
            T.StructField("status", T.StringType()),
            T.StructField("message", T.StringType()),
            T.StructField("op", T.StringType()),
            T.StructField("discarded", T.BooleanType()),
            T.StructField("extra", T.VariantType()),
        ]
    )


def as_history(rows: DataFrame, body: T.DataType) -> DataFrame:
    """Rows with the columns of a history table; without ``extra`` there are no undeclared members."""
    have = rows if "extra" in rows.columns else rows.withColumn("extra", F.lit(None).cast("variant"))
    return have.select(*[F.col(f.name) if f.name == "extra" else F.col(f.name).cast(f.dataType) for f in history_type(body).fields])


def latest_per_key(df: DataFrame, keys: list[str], order: str | Column, pick: str = "max") -> DataFrame:
    """The row with the greatest (or least) ``order`` per key.

    An aggregation: each task keeps one row per key before the shuffle, so a key that holds a third of the rows costs
    one row per task.
    """
    choose = F.max_by if pick == "max" else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(choose(row, F.col(order) if isinstance(order, str) else order).alias("_row"))
    return best.select("_row.*")


def chosen_rows(hist: DataFrame, order: list[str], pick: str = "max") -> DataFrame:
    """The row of every entity with the greatest (or least) ``order``, whose last column is ``history_id``.

    Two steps: an aggregation of the narrow columns names the row of each entity, and whole rows are kept by a semi-join
    on the name. Bodies take no part in the aggregation and are sent on only where the names are too many to broadcast,
    by (entity, history id), which spreads an entity with very many versions.
    """
    best = F.max if pick == "max" else F.min
    if len(order) == 1:
        names = hist.groupBy("entity_id").agg(best(order[0]).alias("history_id"))
    else:
        names = hist.groupBy("entity_id").agg(best(F.struct(*order)).alias("_best")).select("entity_id", "_best.history_id")
    return hist.join(names, ["entity_id", "history_id"], "left_semi")


def heads(hist: DataFrame) -> DataFrame:
    """The newest row of every entity, deleted ones included."""
    return chosen_rows(hist, ["history_id"])


def _touched(hist: DataFrame, since: float) -> DataFrame:
    """Rows of the entities with some change after ``since``: few rows reach the aggregation of an incremental read."""
    recent = hist.filter(F.col("last_modified") > since).select("entity_id").distinct()
    return hist.join(recent, "entity_id", "left_semi")


def latest(hist: DataFrame, since: float | None = None) -> DataFrame:
    """Current state: newest rows that are not deletions, optionally only those changed after ``since``."""
    if since is None:
        return heads(hist).filter(~F.col("discarded"))
    return heads(_touched(hist, since)).filter(~F.col("discarded") & (F.col("last_modified") > since))


def deleted(hist: DataFrame, since: float | None = None) -> DataFrame:
    """Ids whose newest row is a deletion. Bodies are not read."""
    narrow = hist.select("entity_id", "history_id", "last_modified", "discarded")
    if since is None:
        return heads(narrow).filter("discarded").select("entity_id")
    gone = heads(_touched(narrow, since)).filter(F.col("discarded") & (F.col("last_modified") > since))
    return gone.select("entity_id")


def count_entries(hist: DataFrame) -> DataFrame:
    narrow = hist.select("entity_id", "history_id", "discarded")
    return heads(narrow).filter(~F.col("discarded")).agg(F.count(F.lit(1)).alias("entries"))


def max_modified(hist: DataFrame) -> DataFrame:
    """The change high-water mark."""
    return hist.agg(F.max("last_modified").alias("last_modified"))


def entity_ids(hist: DataFrame) -> DataFrame:
    """Ids of current entries, newest change first."""
    narrow = hist.select("entity_id", "history_id", "last_modified", "discarded")
    return latest(narrow).select("entity_id", "last_modified").orderBy(F.col("last_modified").desc(), "entity_id")


def as_of(
    hist: DataFrame,
    ids: DataFrame | None = None,
    version: int | None = None,
    after: float | None = None,
    before: float | None = None,
    oldest: bool = False,
) -> DataFrame:
    """One version per entity, for all entities or for ``ids(entity_id)``.

    The first rule given wins: an exact version; the first at or after a time; the last at or before a time; the
    oldest; else the newest by time. Equal times are decided by ``history_id``.
    """
    if ids is not None:
        hist = hist.join(ids.select("entity_id"), "entity_id", "left_semi")
    time = ["last_modified", "history_id"]
    if version is not None:
        return hist.filter(F.col("version") == version)
    if after is not None:
        return chosen_rows(hist.filter(F.col("last_modified") >= after), time, "min")
    if before is not None:
        return chosen_rows(hist.filter(F.col("last_modified") <= before), time)
    return chosen_rows(hist, time, "min" if oldest else "max")


def history_filter(
    hist: DataFrame,
    user: str | None = None,
    entity: str | None = None,
    from_date: float | None = None,
    to_date: float | None = None,
    from_version: int | None = None,
    to_version: int | None = None,
) -> DataFrame:
    """History rows by user, entity, time (both ends included) or version (``to_version`` excluded).

    Version bounds need an entity and then win over the time bound on the same side.
    """
    out = hist
    if user:
        out = out.filter(F.col("last_modified_by") == user)
    if entity:
        out = out.filter(F.col("entity_id") == entity)
    if entity and from_version:
        out = out.filter(F.col("version") >= from_version)
    elif from_date is not None:
        out = out.filter(F.col("last_modified") >= from_date)
    if entity and to_version:
        out = out.filter(F.col("version") < to_version)
    elif to_date is not None:
        out = out.filter(F.col("last_modified") <= to_date)
    return out


def history_page(rows: DataFrame, page: int = 0, page_size: int = HISTORY_PAGE) -> DataFrame:
    """Newest rows first, one page, planned as top-k."""
    newest = rows.orderBy(F.col("last_modified").desc(), F.col("history_id").desc())
    return (newest.offset(page * page_size) if page else newest).limit(page_size)


def history(hist: DataFrame, page: int = 0, page_size: int = HISTORY_PAGE, **bounds) -> tuple[DataFrame, DataFrame]:
    """A page of history and the total before paging."""
    rows = history_filter(hist, **bounds)
    return history_page(rows, page, page_size), rows.agg(F.count(F.lit(1)).alias("total"))


def check_unique(hist: DataFrame) -> DataFrame:
    """(entity_id, version) pairs that occur more than once."""
    return hist.groupBy("entity_id", "version").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


# ---------------------------------------------------------------- running values per entity


def chunk_of(position: str | Column, width: int = WIDTH) -> Column:
    col = F.col(position) if isinstance(position, str) else position
    return F.call_function("div", col.cast("long"), F.lit(width))


def with_versions(log: DataFrame, entity: str = "entity_id", position: str = "history_id", width: int = WIDTH) -> DataFrame:
    """Number the rows of each entity 1, 2, ... in ``position`` order, as ``version``.

    Rows are ranked inside (entity, chunk) groups of at most ``width`` rows; the counts of earlier chunks are added
    from a running sum over one small row per group.
    """
    log = log.withColumn("_chunk", chunk_of(position, width))
    inside = Window.partitionBy(entity, "_chunk").orderBy(position)
    ranked = log.withColumn("_rank", F.row_number().over(inside))
    before = Window.partitionBy(entity).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        log.groupBy(entity, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(entity, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        ranked.join(offsets, [entity, "_chunk"])
        .withColumn("version", (F.col("_rank") + F.col("_before")).cast("int"))
        .drop("_chunk", "_rank", "_before")
    )


def with_previous(hist: DataFrame, columns: list[str], width: int = 1 << 16) -> DataFrame:
    """Add ``previous_<column>``: the value in the version before, null for version 1.

    Versions of an entity are consecutive, so the last version of each chunk is also handed to the next chunk, and a
    window over (entity, chunk) sees every neighbour in one shuffle.
    """
    chunk = chunk_of("version", width)
    last = F.col("version") % width == width - 1
    spread = F.when(last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = hist.withColumn("_chunk", F.explode(spread))
    inside = Window.partitionBy("entity_id", "_chunk").orderBy("version")
    for name in columns:
        rows = rows.withColumn(f"previous_{name}", F.lag(name).over(inside))
    return rows.filter(F.col("_chunk") == chunk_of("version", width)).drop("_chunk")
