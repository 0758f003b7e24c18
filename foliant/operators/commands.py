"""Command batches against the change log: conflict checks and new history rows, without a loop over commands.

Commands: ``position, cmdtype, entity_id, version, body, user, message, last_modified``. Positions are unique
integers in command order. A batch is all or nothing: new rows are meant to be written only if no command conflicts.

The state before a command (version, body, whether the entry exists or is deleted) is a running value over the
entity's earlier commands. It is computed in two steps: inside (entity, chunk of positions) groups, whose size is
bounded, and over one row per group, whose result is joined back. An entity that receives a third of all commands is
therefore spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.ids import normalise_ts
from foliant.operators.history import ADDED, DELETED, IN_PROGRESS, UPDATED, WIDTH, chunk_of, heads

ADD, UPDATE, DELETE = "add_entry", "update_entry", "delete_entry"

# The messages of versions that come without one.
ADD_MESSAGE, UPDATE_MESSAGE, DELETE_MESSAGE = "Entry added.", "Entry updated", "Entry deleted."


def _base_state(hist: DataFrame, commands: DataFrame) -> DataFrame:
    """The newest row of the entities that have commands; other entities are dropped before the aggregation."""
    touched = commands.select("entity_id").distinct()
    return heads(hist.join(touched, "entity_id", "left_semi")).select(
        "entity_id",
        F.col("version").cast("long").alias("_version"),
        F.col("body").alias("_body"),
        F.col("discarded").alias("_dead"),
    )


def judge(hist: DataFrame, commands: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each command with the state before it (``before_version``, ``before_body``, ``dead``), whether it makes a new
    version (``effective``) and its ``conflict`` (null, ``exists``, ``missing``, ``discarded`` or ``version``)."""
    c = F.col
    cmds = commands.withColumn("_chunk", chunk_of("position", width))
    inside = Window.partitionBy("entity_id", "_chunk").orderBy("position")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    has_body = c("cmdtype") != DELETE
    carried = F.when(has_body, F.struct("body"))  # keeps an absent body apart from no body yet
    rows = (
        cmds.withColumn("_last", F.last(carried, ignorenulls=True).over(earlier))
        .withColumn("_added", F.coalesce(F.max(c("cmdtype") == ADD).over(earlier), F.lit(False)))
        .withColumn("_deleted", F.coalesce(F.max(c("cmdtype") == DELETE).over(earlier), F.lit(False)))
    )
    # 1 for a new version, null where that depends on the chunks before
    settled = (
        F.when(c("cmdtype") == ADD, 1)
        .when((c("cmdtype") == UPDATE) & c("_last").isNotNull(), (~c("_last.body").eqNullSafe(c("body"))).cast("int"))
        .when((c("cmdtype") == DELETE) & c("_deleted"), 0)
    )
    rows = rows.withColumn("_settled", settled)

    groups = rows.groupBy("entity_id", "_chunk").agg(
        F.max_by(carried, F.when(has_body, c("position"))).alias("g_last"),
        F.max(c("cmdtype") == ADD).alias("g_added"),
        F.max(c("cmdtype") == DELETE).alias("g_deleted"),
        F.sum(F.coalesce("_settled", F.lit(0))).alias("g_settled"),
        # an update before any body of its chunk: at most one per chunk
        F.max(F.when((c("cmdtype") == UPDATE) & c("_settled").isNull(), F.struct("body"))).alias("g_open"),
    )
    base = _base_state(hist, commands)
    groups = groups.join(base, "entity_id", "left")
    chain = Window.partitionBy("entity_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base_body = F.when(c("_version").isNotNull(), F.struct(c("_body").alias("body")))
    groups = (
        groups.withColumn("in_last", F.coalesce(F.last("g_last", ignorenulls=True).over(chain), base_body))
        .withColumn("in_exists", c("_version").isNotNull() | F.coalesce(F.max("g_added").over(chain), F.lit(False)))
        .withColumn("in_dead", F.coalesce("_dead", F.lit(False)) | F.coalesce(F.max("g_deleted").over(chain), F.lit(False)))
    )
    made = (
        c("g_settled")
        + F.when(c("g_open").isNotNull(), (~c("in_last.body").eqNullSafe(c("g_open.body"))).cast("int")).otherwise(0)
        + (c("g_deleted") & ~c("in_dead")).cast("int")
    )
    groups = groups.withColumn("_made", made).select(
        "entity_id",
        "_chunk",
        "in_last",
        "in_exists",
        "in_dead",
        (F.coalesce("_version", F.lit(0)) + F.coalesce(F.sum("_made").over(chain), F.lit(0))).alias("in_version"),
    )

    out = rows.join(groups, ["entity_id", "_chunk"])
    dead = c("in_dead") | c("_deleted")
    body_before = F.coalesce("_last", "in_last")
    effective = F.coalesce(
        "_settled",
        F.when(c("cmdtype") == UPDATE, (~body_before["body"].eqNullSafe(c("body"))).cast("int")),
        (~dead).cast("int"),
    )
    out = out.withColumns(
        {"dead": dead, "exists": c("in_exists") | c("_added"), "before_body": body_before["body"], "effective": effective}
    )
    out = out.withColumn(
        "before_version", c("in_version") + F.coalesce(F.sum("effective").over(earlier), F.lit(0))
    )
    wrong = c("version").isNull() | (c("version") != c("before_version"))
    conflict = (
        F.when((c("cmdtype") == ADD) & c("exists"), "exists")
        .when((c("cmdtype") != ADD) & ~c("exists"), "missing")
        .when((c("cmdtype") == UPDATE) & c("dead"), "discarded")
        .when((c("cmdtype") == UPDATE) & wrong, "version")
        .when((c("cmdtype") == DELETE) & ~c("dead") & wrong, "version")
    )
    helpers = [n for n in out.columns if n.startswith("_") or n.startswith("in_")]
    return out.withColumn("conflict", conflict).drop(*helpers)


def conflicts_of(judged: DataFrame) -> DataFrame:
    """Commands that would block the batch, and the version the entry had."""
    return judged.filter("conflict IS NOT NULL").select(
        "position", "entity_id", "cmdtype", "version", F.col("before_version").alias("current_version"), "conflict"
    )


def rows_of(judged: DataFrame) -> DataFrame:
    """History rows (without ``history_id``) the batch makes, in ``position`` order."""
    c = F.col
    op = F.when(c("cmdtype") == ADD, ADDED).when(c("cmdtype") == UPDATE, UPDATED).otherwise(DELETED)
    default = (
        F.when(c("cmdtype") == ADD, ADD_MESSAGE).when(c("cmdtype") == UPDATE, UPDATE_MESSAGE).otherwise(DELETE_MESSAGE)
    )
    made = judged.filter("conflict IS NULL AND effective = 1")
    return made.select(
        "position",
        "entity_id",
        (c("before_version") + 1).cast("int").alias("version"),
        "last_modified",
        F.coalesce("user", F.lit("Unknown user")).alias("last_modified_by"),
        F.when(c("cmdtype") == DELETE, c("before_body")).otherwise(c("body")).alias("body"),
        F.lit(IN_PROGRESS).alias("status"),
        F.coalesce(F.when(c("message") != "", c("message")), default).alias("message"),
        op.alias("op"),
        (c("cmdtype") == DELETE).alias("discarded"),
    )


def with_extra(df: DataFrame) -> DataFrame:
    """The body and what is beside it (``extra``, null where there is no such column) as one body that can be compared."""
    extra = F.to_json("extra") if "extra" in df.columns else F.lit(None).cast("string")
    return df.withColumn("body", F.struct("body", extra.alias("extra"))).drop("extra")


def without_extra(df: DataFrame) -> DataFrame:
    """The two parts of bodies made by ``with_extra``, as columns."""
    return df.withColumn("extra", F.parse_json("body.extra")).withColumn("body", F.col("body.body"))


def apply_commands(hist: DataFrame, commands: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(new history rows, conflicts). Write the rows only if there are no conflicts.

    Where commands have an ``extra``, undeclared members belong to the body: a change of them alone makes a version.
    """
    commands = normalise_ts(commands)
    if "extra" not in commands.columns:
        judged = judge(hist, commands, width)
        return rows_of(judged), conflicts_of(judged)
    judged = judge(with_extra(hist), with_extra(commands), width)
    return without_extra(rows_of(judged)), conflicts_of(judged)


def add_entries(hist: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Idempotent adds of ``rows(position, entity_id, body, ...)``: (rows to add, conflicts).

    An id that already has the same body at version 1 is left as it is; another body is an integrity error (61).
    Within the batch the first row of an id counts. Where rows have an ``extra``, it belongs to the body.
    """
    if "extra" in rows.columns:
        added, conflicts = add_entries(with_extra(hist), with_extra(rows))
        return without_extra(added).select(*rows.columns), conflicts
    first = rows.groupBy("entity_id").agg(
        F.min_by(F.struct("body"), "position").alias("_first"), F.min("position").alias("_pos")
    )
    current = _base_state(hist, rows)
    known = first.join(current, "entity_id", "left")
    keep = F.when(F.col("_version").isNotNull(), F.col("_body")).otherwise(F.col("_first.body"))
    fixed = known.select(
        "entity_id", "_pos", "_version", F.struct(keep.alias("body")).alias("_kept"), F.coalesce("_dead", F.lit(False)).alias("_dead")
    )
    judged = rows.join(fixed, "entity_id")
    same = F.col("body").eqNullSafe(F.col("_kept.body"))
    stale = F.col("_version").isNotNull() & (F.col("_version") != 1)
    fine = same & ~stale
    fresh = F.col("_version").isNull() & (F.col("position") == F.col("_pos"))
    conflicts = judged.filter(~fine).select("position", "entity_id", F.lit(61).alias("code"))
    return judged.filter(fresh).select(*rows.columns), conflicts


def as_add_commands(rows: DataFrame, user: str, message: str | None = None) -> DataFrame:
    """Records ``(position, entity_id, body)`` as add commands with job defaults for user and message."""
    have = set(rows.columns)

    def default(name: str, value: Column) -> Column:
        return (F.coalesce(F.when(F.col(name) != "", F.col(name)), value) if name in have else value).alias(name)

    return rows.select(
        "position",
        F.lit(ADD).alias("cmdtype"),
        "entity_id",
        F.lit(None).cast("long").alias("version"),
        "body",
        default("user", F.lit(user)),
        default("message", F.lit(message).cast("string")),
        (F.col("last_modified") if "last_modified" in have else F.lit(None).cast("double")).alias("last_modified"),
        *(["extra"] if "extra" in have else []),
    )
