"""Reading records and import envelopes, exporting the current state, and appending history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.ids import normalise_ts, with_ulid
from foliant.functions.rest import merged, rest_of
from foliant.operators.commands import as_add_commands, rows_of, with_extra, without_extra
from foliant.operators.derive import Context, derive
from foliant.operators.history import as_history, history_type, latest
from foliant.operators.validate import validate
from foliant.plans.spec import Spec
from foliant.session import materialise
from foliant.sources.arrays import read_raw_array


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON text per record (``raw``) with its place in the input (``position``).

    One record per line is read in parallel by line; files that hold one JSON array are read by ``read_raw_array``.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "raw").filter(F.trim("raw") != "")
    return lines.withColumn("position", F.monotonically_increasing_id())


def body_of(raw: Column, spec: Spec) -> Column:
    """The declared members of a JSON object; null for anything else."""
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, spec.body_type()))


def read_entries(spark: SparkSession, path: str | list[str], spec: Spec, array: bool = False) -> DataFrame:
    """(position, raw, entry, extra): records read against the declared schema; ``entry`` is null for a line that is
    not JSON, and for the part of an array file that is broken. Types are never inferred. ``extra`` holds, as a variant,
    what the entry cannot: undeclared members at any depth, nulls and values of other types (``functions.rest``)."""
    rows = read_raw_array(spark, path) if array else read_raw(spark, path)
    return rows.select("position", "raw", body_of(F.col("raw"), spec).alias("entry"), rest_of(F.col("raw"), spec).alias("extra"))


def read_import(spark: SparkSession, path: str | list[str], spec: Spec, user: str, message: str | None = None) -> DataFrame:
    """Records with envelopes: a missing id is made, missing user and message take the job's, versions are ignored.

    Made ids follow from the time and the record's content and place, so a repeated read gives the same ones.
    """
    rows = read_raw(spark, path)
    given = [F.get_json_object("raw", f"$.{n}").alias(n) for n in ("id", "last_modified", "user", "message", "entry")]
    rows = rows.select("position", *given)
    rows = normalise_ts(rows)
    rows = with_ulid(rows, F.col("last_modified"), [F.col("position"), F.col("entry")])
    return rows.select(
        "position",
        F.col("id").alias("entity_id"),
        body_of(F.col("entry"), spec).alias("body"),
        rest_of(F.col("entry"), spec).alias("extra"),
        F.col("entry").alias("raw"),
        F.coalesce(F.when(F.col("user") != "", F.col("user")), F.lit(user)).alias("user"),
        F.coalesce(F.when(F.col("message") != "", F.col("message")), F.lit(message)).alias("message"),
        "last_modified",
    )


def as_current(hist: DataFrame, spec: Spec) -> DataFrame:
    """The current state of a history, as entries, with ``extra`` where the history has it."""
    return latest(hist).select(
        F.lit(spec.name).alias("resource"),
        F.col("entity_id").alias("id"),
        "version",
        "last_modified",
        "last_modified_by",
        F.col("body").alias("entry"),
        "message",
        *(["extra"] if "extra" in hist.columns else []),
    )


def export(hist: DataFrame, spec: Spec, path: str, expand: bool = False, entry_only: bool = False, context: Context | None = None, format: str = "json") -> None:
    """Write the current version of every entry, one record per line, with or without derived columns.

    Where the history has an ``extra``, records come out with every member they came in with, undeclared ones and nulls
    included; JSON members are then in the order of their names.
    """
    rows = as_current(hist, spec)
    if expand:
        rows = derive(rows, spec, context)
    if "extra" in hist.columns:
        declared = {n for n, f in spec.fields.items() if not f.virtual}
        more = [n for n in rows.schema["entry"].dataType.names if n not in declared]
        derived = F.struct(*[F.col("entry").getField(n).alias(n) for n in more]) if more else None
        rows = rows.withColumn("entry", merged(F.col("entry"), F.col("extra"), spec, derived)).drop("extra")
        if entry_only and format == "json":
            rows.select(F.to_json("entry").alias("value")).write.mode("errorifexists").text(path)
            return
    elif entry_only:
        rows = rows.select("entry.*")
    rows.write.format(format).mode("errorifexists").save(path)


# ---------------------------------------------------------------- history tables


def read_history(spark: SparkSession, path: str, body: T.DataType) -> DataFrame:
    return spark.read.schema(history_type(body)).parquet(path)


def dense_index(df: DataFrame, order: list[str], name: str, start: int | Column = 0) -> DataFrame:
    """Number all rows 0, 1, 2, ... in ``order``, without gathering them in one task.

    Rows are range-partitioned and written once; each partition adds the number of rows before it. The written copy
    fixes the partitions, so a repeated task numbers the same rows alike.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(
        ranged.withColumns({"_pid": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
        "ranged",
    )
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one small row per partition
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    base = F.lit(start) if isinstance(start, int) else start
    return ranged.join(F.broadcast(offsets), "_pid").withColumn(name, base + F.col("_before") + F.col("_local")).drop("_pid", "_local", "_before")


def append_history(spark: SparkSession, path: str, rows: DataFrame, body: T.DataType, first: int | None = None) -> int:
    """Append versions to a history table; never changes what is there. Returns the first ``history_id`` used.

    Ids continue after the greatest one there, by (last_modified, position). One writer at a time: two that append at
    once would use the same ids. A writer that knows the next id gives it as ``first``, and the table is not read.
    """
    if first is None:
        try:
            top = read_history(spark, path, body).agg(F.max("history_id").alias("m")).first()["m"]
        except Exception as err:  # no table yet
            if "PATH_NOT_FOUND" not in str(err):
                raise
            top = None
        first = 0 if top is None else top + 1
    numbered = dense_index(rows, ["last_modified", "position"], "history_id", first)
    as_history(numbered, body).write.mode("append").parquet(path)
    return first


def _whole_chunks(good: DataFrame, bad: DataFrame, chunk: int) -> DataFrame:
    """The valid records up to the last commit before the first invalid one, in input order."""
    every = dense_index(good.select("position").withColumn("_bad", F.lit(False)).unionByName(bad.select("position").withColumn("_bad", F.lit(True))), ["position"], "_at")
    first = every.filter("_bad").agg(F.min("_at").alias("m")).first()["m"]
    if first is None:
        return good
    last = chunk * ((first - 1) // chunk) if first else -1
    return good.join(every.filter(F.col("_at") <= last).select("position"), "position", "left_semi")


def bulk_add(spark: SparkSession, path: str, records: DataFrame, spec: Spec, user: str, message: str | None = None, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate ``records(position, raw[, entity_id, ...])`` and append the valid ones as version 1.

    Returns (rows appended, invalid records). All or nothing by default: nothing is written when a record is invalid.
    With ``chunk``, an add commits after its first record and then after every ``chunk`` records, and stops at the first
    invalid one: what was committed before it stays. Every member of a record is kept, declared or not.
    """
    good, bad = validate(records, spec)
    if bad.limit(1).count():
        good = _whole_chunks(good, bad, chunk) if chunk else good.limit(0)
        if not chunk:
            return good, bad
    rows = good.withColumn("body", body_of(F.col("raw"), spec)).withColumn("extra", rest_of(F.col("raw"), spec))
    if "last_modified" not in rows.columns:
        rows = rows.withColumn("last_modified", F.unix_micros(F.current_timestamp()) / 1e6)
    rows = with_ulid(rows, F.col("last_modified"), [F.col("position"), F.col("raw")], "entity_id")
    commands = with_extra(as_add_commands(rows, user, message))
    judged = commands.withColumns(
        {"conflict": F.lit(None).cast("string"), "effective": F.lit(1), "before_version": F.lit(0), "before_body": F.col("body")}
    )
    made = materialise(without_extra(rows_of(judged)), "added")
    append_history(spark, path, made, spec.body_type())
    return made, bad


__all__ = [
    "append_history",
    "as_current",
    "bulk_add",
    "dense_index",
    "export",
    "read_entries",
    "read_history",
    "read_import",
    "read_raw",
    "read_raw_array",
]
