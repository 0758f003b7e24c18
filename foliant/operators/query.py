"""Asking collections: filter, sort, page, count, and project one path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.functions.paths import get_path
from foliant.operators.predicates import META, Predicate, matching
from foliant.plans.spec import SortError, Spec, UnknownField, shared_field, split_path

# The default page of a query.
PAGE_SIZE = 25

SORTABLE = ("boolean", "integer", "number", "long_string", "string")


@dataclass
class Result:
    hits: DataFrame
    total: DataFrame
    distribution: DataFrame


def total(df: DataFrame) -> DataFrame:
    """Exact number of matching entries."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def distribution(df: DataFrame) -> DataFrame:
    """Matching entries per collection; collections without hits are absent."""
    return df.groupBy("resource").agg(F.count(F.lit(1)).alias("count"))


def _parse(item: str | tuple[str, str]) -> tuple[str, str]:
    path, order = item if isinstance(item, tuple) else (item.split("|", 1) + ["asc"])[:2]
    if order not in ("asc", "desc"):
        raise SortError(f"unknown sort order {order!r}")
    return path, order


def sort_column(specs: list[Spec], path: str, order: str) -> Column:
    """Sort expression of one field: texts by Swedish rules, missing values last in both directions."""
    if path.startswith("@"):
        if path not in META or path == "@version":
            raise SortError(f"cannot sort on {path}")
        col = F.col(META[path][0])
        return col.asc_nulls_last() if order == "asc" else col.desc_nulls_last()
    try:
        f = shared_field(specs, path)
    except UnknownField as err:
        raise SortError(str(err)) from None
    if f.type not in SORTABLE or (f.is_text and f.skip_raw):
        raise SortError(f"cannot sort on {path}")
    parts = split_path(path)
    crossed = [i for i in range(1, len(parts)) if specs[0].field(".".join(parts[:i])).collection]
    if any(i != len(parts) - 1 for i in crossed):
        raise SortError(f"cannot sort on {path}: only the collection directly above the field may be crossed")
    col = F.col("entry")
    for part in parts:
        col = col.getField(part)
    if crossed or f.collection:
        # several values: the smallest decides upwards, the largest downwards
        values = col
        if crossed and f.collection:
            values = F.flatten(col)
        if f.is_text:
            values = F.transform(values, lambda x: F.struct(text.sv_sort(x).alias("k")))
            values = F.filter(values, lambda x: x.getField("k").isNotNull())
            col = (F.array_min(values) if order == "asc" else F.array_max(values)).getField("k")
        else:
            col = F.array_min(values) if order == "asc" else F.array_max(values)
    elif f.is_text:
        col = text.sv_sort(col)
    return col.asc_nulls_last() if order == "asc" else col.desc_nulls_last()


def default_sort(specs: list[Spec]) -> list[str]:
    """The sort all collections agree on: their ``sort``, else their ``id`` field."""
    wanted = {s.name: (s.sort or ((s.id,) if s.id else ())) for s in specs}
    if len(set(wanted.values())) > 1:
        raise SortError(f"no common default sort for {sorted(wanted)}")
    fields = next(iter(wanted.values()))
    kinds = {tuple(s.field(p).type for p in fields) for s in specs}
    if len(kinds) > 1:
        raise SortError(f"default sort fields differ in type for {sorted(wanted)}")
    return list(fields)


def ordered(df: DataFrame, specs: Spec | list[Spec], sort: list | None = None) -> DataFrame:
    """Entries in the wanted or default order; resource and id break ties."""
    specs = [specs] if isinstance(specs, Spec) else list(specs)
    keys = [sort_column(specs, *_parse(s)) for s in (sort if sort else default_sort(specs))]
    return df.orderBy(*keys, F.col("resource").asc(), F.col("id").asc())


def page(df: DataFrame, from_: int = 0, size: int | None = PAGE_SIZE) -> DataFrame:
    """A page of an ordered DataFrame, planned as top-k; without ``size`` everything from the offset on."""
    if from_:
        df = df.offset(from_)
    return df.limit(size) if size else df


def project(df: DataFrame, path: str) -> DataFrame:
    """One field of each hit."""
    return df.select(get_path(df, path).alias("value"))


def query(
    df: DataFrame,
    specs: Spec | list[Spec],
    predicate: Predicate | None = None,
    sort: list | None = None,
    from_: int = 0,
    size: int | None = PAGE_SIZE,
    path: str | None = None,
    words: dict[str, str] | None = None,
) -> Result:
    """Hits, exact total and distribution, as three lazy DataFrames."""
    found = matching(df, predicate, specs, words)
    if size == 0:
        hits = found.limit(0)
    else:
        listed = [specs] if isinstance(specs, Spec) else list(specs)
        has_order = bool(sort) or bool(default_sort(listed))
        hits = page(ordered(found, listed, sort) if has_order else found, from_, size)
    return Result(project(hits, path) if path else hits, total(found), distribution(found))
