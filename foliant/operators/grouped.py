"""Computing once per group of rows and handing the result to every row of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_apply(df: DataFrame, keys: list[str], once: dict[str, Column]) -> DataFrame:
    """Each row with the results of its group.

    The group results are aggregates with map-side combining, one row per group, and are joined back; a group is
    never gathered, and a hot one is split by the skew-join handling.
    """
    results = df.groupBy(*keys).agg(*[value.alias(name) for name, value in once.items()])
    # the optimizer sees both sides of the join come from one source; renaming the keys keeps their columns apart
    renamed = results.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(renamed, on, "left").drop(*[f"_{k}" for k in keys])
