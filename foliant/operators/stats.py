"""Value statistics: every distinct value of a field and the number of entries that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.paths import values_at
from foliant.plans.spec import Spec
from foliant.session import materialise

# The most distinct values a report may have.
MAX_VALUES = 66000


class TooManyValues(ValueError):
    pass


def value_counts(df: DataFrame, path: str, root: str = "entry") -> DataFrame:
    """(value, count of entries), unordered and complete.

    Values are made distinct inside each entry first, also through nested collections, so that entries are counted by
    one aggregation with map-side combining; no distinct over (value, id) is shuffled.
    """
    dtype = df.schema[root].dataType
    values = F.array_distinct(values_at(F.col(root), dtype, path))
    return df.select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def check_values(counts: DataFrame, max_values: int = MAX_VALUES) -> None:
    """Fail when there are more distinct values than a report may have; reads at most one row more than allowed."""
    if counts.limit(max_values + 1).count() > max_values:
        raise TooManyValues("Too many unique values for statistics")


def statistics(df: DataFrame, path: str, spec: Spec | None = None, max_values: int | None = None) -> DataFrame:
    """The report: values by falling count, then value. It is whole at any size; ``max_values`` is an explicit bound."""
    if spec is not None:
        spec.field(path)
    counts = value_counts(df, path)
    if max_values is not None:
        # counted once: the check and the report read the written counts
        counts = materialise(counts, "counts")
        check_values(counts, max_values)
    return counts.orderBy(F.col("count").desc(), F.col("value").asc())

