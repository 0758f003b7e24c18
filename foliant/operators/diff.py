"""Structural differences between nested bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.rest import rest_changes
from foliant.operators.history import HISTORY_PAGE, as_of, history_filter, history_page, with_previous

CHANGE_ROW = "array<struct<type:string,field:string,before:string,after:string>>"

# The kinds of difference.
ADDED, REMOVED, CHANGE = "ADDED", "REMOVED", "CHANGE"


def _show(col: Column, dtype: T.DataType) -> Column:
    return F.to_json(col) if isinstance(dtype, (T.ArrayType, T.StructType)) else col.cast("string")


def _change(kind: str, at: Column, before: Column, after: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("type"), at.alias("field"), before.alias("before"), after.alias("after")))


def _compare(a: Column, b: Column, dtype: T.DataType, at: Column) -> Column:
    none = F.array().cast(CHANGE_ROW)
    text = F.lit(None).cast("string")
    if isinstance(dtype, T.StructType):
        inner = [_compare(a.getField(f.name), b.getField(f.name), f.dataType, F.concat(at, F.lit(f".{f.name}"))) for f in dtype.fields]
        both = F.flatten(F.array(*inner))
    elif isinstance(dtype, T.ArrayType):
        # elements are compared by position; a longer side adds or removes its tail
        zipped = F.arrays_zip(a.alias("a"), b.alias("b"))
        both = F.flatten(
            F.transform(
                zipped,
                lambda x, i: _compare(
                    x.getField("a"),
                    x.getField("b"),
                    dtype.elementType,
                    F.concat(at, F.lit("["), i.cast("string"), F.lit("]")),
                ),
            )
        )
    else:
        both = F.when(a != b, _change(CHANGE, at, _show(a, dtype), _show(b, dtype))).otherwise(none)
    return (
        F.when(a.isNull() & b.isNull(), none)
        .when(a.isNull(), _change(ADDED, at, text, _show(b, dtype)))
        .when(b.isNull(), _change(REMOVED, at, _show(a, dtype), text))
        .otherwise(both)
    )


def diff(a: Column, b: Column, dtype: T.StructType) -> Column:
    """Differences from ``a`` to ``b``: an array of (type, field, before, after), built leaf by leaf from the schema.

    A null body counts as an empty one, so everything in the other is added or removed.
    """
    members = [_compare(a.getField(f.name), b.getField(f.name), f.dataType, F.lit(f.name)) for f in dtype.fields]
    return F.flatten(F.array(*members))


def _with_rest(changes: Column, before: str, after: str, hist: DataFrame) -> Column:
    """Changes of the declared members, and of the others where the history has any."""
    return F.concat(changes, rest_changes(F.col(before), F.col(after))) if "extra" in hist.columns else changes


def explode_changes(df: DataFrame, keys: list[str], name: str = "diff") -> DataFrame:
    return df.select(*keys, F.explode(name).alias("c")).select(*keys, "c.type", "c.field", "c.before", "c.after")


def history_diffs(hist: DataFrame) -> DataFrame:
    """Every history row with its difference from the version before; version 1 is compared with nothing."""
    body = hist.schema["body"].dataType
    rows = with_previous(hist, ["body", "extra"] if "extra" in hist.columns else ["body"])
    changes = _with_rest(diff(F.col("previous_body"), F.col("body"), body), "previous_extra", "extra", hist)
    return rows.withColumn("diff", changes).drop("previous_body", "previous_extra")


def history_page_diffs(hist: DataFrame, page: int = 0, page_size: int = HISTORY_PAGE, **bounds) -> DataFrame:
    """A history page whose rows are compared with the row before them on the page (the newer one), the first with
    nothing. Only the rows of one page take part in the window."""
    body = hist.schema["body"].dataType
    rows = history_page(history_filter(hist, **bounds), page, page_size)
    on_page = Window.partitionBy(F.lit(0)).orderBy(F.col("last_modified").desc(), F.col("history_id").desc())
    rows = rows.withColumn("_newer", F.lag("body").over(on_page))
    if "extra" in hist.columns:
        rows = rows.withColumn("_newer_extra", F.lag("extra").over(on_page))
    changes = _with_rest(diff(F.col("_newer"), F.col("body"), body), "_newer_extra", "extra", hist)
    return rows.withColumn("diff", changes).drop("_newer", "_newer_extra")


def version_diff(
    hist: DataFrame,
    ids: DataFrame | None = None,
    from_version: int | None = None,
    from_date: float | None = None,
    to_version: int | None = None,
    to_date: float | None = None,
    supplied: DataFrame | None = None,
) -> DataFrame:
    """Differences between two versions of each entity.

    From: a version, else the first at or after a time, else the oldest. To: a version, else the last at or before a
    time, else a ``supplied(entity_id, body)``, else the newest. Entities that lack either side are left out; see
    ``impossible_diffs``.
    """
    older, newer = _sides(hist, ids, from_version, from_date, to_version, to_date, supplied)
    body = hist.schema["body"].dataType
    both = older.join(newer, "entity_id")
    return both.select(
        "entity_id",
        "from_version",
        "to_version",
        _with_rest(diff(F.col("from_body"), F.col("to_body"), body), "from_extra", "to_extra", hist).alias("diff"),
    )


def impossible_diffs(hist: DataFrame, ids: DataFrame, **bounds) -> DataFrame:
    """Ids whose difference cannot be made because one side is missing."""
    older, newer = _sides(
        hist, ids, *[bounds.get(k) for k in ("from_version", "from_date", "to_version", "to_date", "supplied")]
    )
    both = older.select("entity_id").join(newer.select("entity_id"), "entity_id", "left_semi")
    return ids.select("entity_id").join(both, "entity_id", "left_anti")


def _sides(hist, ids, from_version, from_date, to_version, to_date, supplied):
    if from_version is not None or from_date is not None:
        older = as_of(hist, ids, version=from_version, after=from_date)
    else:
        older = as_of(hist, ids, oldest=True)
    extra = lambda rows, name: (F.col("extra") if "extra" in rows.columns else F.lit(None).cast("variant")).alias(name)
    older = older.select("entity_id", F.col("version").alias("from_version"), F.col("body").alias("from_body"), extra(older, "from_extra"))
    if to_version is not None or to_date is not None:
        newer = as_of(hist, ids, version=to_version, before=to_date)
    elif supplied is not None:
        newer = supplied.withColumn("version", F.lit(None).cast("int"))
    else:
        newer = as_of(hist, ids)
    newer = newer.select("entity_id", F.col("version").alias("to_version"), F.col("body").alias("to_body"), extra(newer, "to_extra"))
    return older, newer
