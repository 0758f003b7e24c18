"""Streams over the change log: a snapshot that follows it, and commands that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.commands import apply_commands
from foliant.operators.derive import Context, derive
from foliant.operators.history import as_history, heads, history_type
from foliant.plans.spec import Spec
from foliant.session import materialise
from foliant.sources.entries import dense_index
from foliant.sources.snapshots import apply_changes


def stream_sync(spark: SparkSession, history_path: str, spec: Spec, root: str, checkpoint: str, context: Context | None = None) -> StreamingQuery:
    """Follow a history folder and keep the published snapshot in step, one batch of new files at a time.

    Within a batch the newest row per entry counts; applying a batch twice gives the same snapshot, so a replay after
    a lost driver is harmless.
    """
    body = spec.body_type()

    def merge_batch(batch: DataFrame, _number: int) -> None:
        newest = materialise(heads(batch), "batch")
        upserts = newest.filter(~F.col("discarded")).select(
            F.lit(spec.name).alias("resource"),
            F.col("entity_id").alias("id"),
            "version",
            "last_modified",
            "last_modified_by",
            F.col("body").alias("entry"),
        )
        gone = newest.filter("discarded").select(F.col("entity_id").alias("id"))
        mark = newest.agg(F.max("history_id").alias("m")).first()["m"]
        if mark is not None:
            apply_changes(spark, root, spec, derive(upserts, spec, context, until="indexed"), gone, mark)

    rows = spark.readStream.schema(history_type(body)).option("recursiveFileLookup", "true").parquet(history_path)
    return rows.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def command_type(body: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("position", T.LongType()),
            T.StructField("cmdtype", T.StringType()),
            T.StructField("entity_id", T.StringType()),
            T.StructField("version", T.LongType()),
            T.StructField("body", body),
            T.StructField("user", T.StringType()),
            T.StructField("message", T.StringType()),
            T.StructField("last_modified", T.DoubleType()),
        ]
    )


def read_stream_history(spark: SparkSession, path: str, body: T.DataType, before_batch: int | None = None) -> DataFrame:
    """The history that command batches wrote (folders ``batch=n``), optionally only that of earlier batches."""
    shape = history_type(body).add("batch", T.LongType())
    try:
        rows = spark.read.schema(shape).parquet(path)
    except Exception as err:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(err):
            raise
        rows = spark.createDataFrame([], shape)
    if before_batch is not None:
        rows = rows.filter(F.col("batch") < before_batch)
    return rows.drop("batch")


def stream_commands(
    spark: SparkSession, command_path: str, history_path: str, rejected_path: str, body: T.DataType, checkpoint: str, files_per_batch: int | None = None, numbered: bool = False
) -> StreamingQuery:
    """Commands that arrive as JSON files become history rows, batch by batch, each batch all or nothing.

    A batch with a conflict adds no rows and leaves its conflicts in ``rejected_path``. Each batch owns a folder that a
    replay overwrites, and reads only the folders of earlier batches, so replays change nothing.

    History ids follow the order of commands, whatever times these give. They go on after the greatest one there; with
    ``numbered``, positions count up over all batches, as in a log, and are the ids.
    """

    def run(batch: DataFrame, number: int) -> None:
        commands = materialise(batch, "commands")
        hist = read_stream_history(spark, history_path, body, number)
        rows, conflicts = apply_commands(hist, commands)
        conflicts = materialise(conflicts, "conflicts")
        if conflicts.limit(1).count():
            conflicts.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
            return
        if numbered:
            made = rows.withColumn("history_id", F.col("position"))
        else:
            top = hist.agg(F.max("history_id").alias("m")).first()["m"]
            made = dense_index(rows, ["position"], "history_id", 0 if top is None else top + 1)
        as_history(made, body).write.mode("overwrite").parquet(f"{history_path}/batch={number}")

    reader = spark.readStream.schema(command_type(body))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(command_path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["command_type", "read_stream_history", "stream_commands", "stream_sync"]
