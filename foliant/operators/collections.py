"""Entries DataFrames: envelope columns beside a nested body, for one or several collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans.spec import Field, Spec, split_path

ENVELOPE = ("resource", "id", "version", "last_modified", "last_modified_by", "entry")


def as_entries(
    df: DataFrame,
    spec: Spec,
    id: Column,
    version: Column | None = None,
    last_modified: Column | None = None,
    last_modified_by: Column | None = None,
) -> DataFrame:
    """A flat or nested DataFrame as entries of ``spec``; body columns are taken by name and cast to the spec."""
    body = F.struct(*[F.col(name).cast(f.data_type()).alias(name) for name, f in spec.stored_fields().items()])
    return df.select(
        F.lit(spec.name).alias("resource"),
        id.cast("string").alias("id"),
        (F.lit(1) if version is None else version).cast("int").alias("version"),
        (F.lit(0.0) if last_modified is None else last_modified).cast("double").alias("last_modified"),
        (F.lit("import") if last_modified_by is None else last_modified_by).alias("last_modified_by"),
        body.alias("entry"),
    )


def with_metadata(df: DataFrame) -> DataFrame:
    """The hit shape: resource, id, body and the metadata beside it."""
    return df.select("resource", "id", "entry", "last_modified_by", "last_modified", "version")


def union_collections(parts: list[tuple[DataFrame, Spec]]) -> DataFrame:
    """Several collections as one; a field that a collection lacks is null in its entries.

    Fields that are declared with the same type everywhere are aligned by name. Only fields used in a predicate or a
    sort have to agree, so a field with conflicting types is renamed per collection rather than refused here.
    """
    names: dict[str, set] = {}
    for _, spec in parts:
        for name, f in spec.stored_fields().items():
            names.setdefault(name, set()).add(f.data_type().json())
    out = None
    for df, spec in parts:
        clash = [n for n in spec.stored_fields() if len(names[n]) > 1]
        if clash:
            members = [
                F.col("entry").getField(f.name).alias(f"{spec.name}.{f.name}" if f.name in clash else f.name)
                for f in df.schema["entry"].dataType.fields
            ]
            df = df.withColumn("entry", F.struct(*members))
        out = df if out is None else _union_nested(out, df)
    return out


def _union_nested(left: DataFrame, right: DataFrame) -> DataFrame:
    wanted = _merge(left.schema["entry"].dataType, right.schema["entry"].dataType)
    sides = [d.withColumn("entry", _fit(F.col("entry"), d.schema["entry"].dataType, wanted)) for d in (left, right)]
    return sides[0].unionByName(sides[1])


def _merge(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _merge(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merge(a.elementType, b.elementType))
    return a


def _fit(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """Add the members a nested value lacks, as nulls, and put members in the wanted order."""
    if have == want:
        return col
    if isinstance(want, T.StructType):
        members = [
            (_fit(col.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(col.isNotNull(), F.struct(*members))
    if isinstance(want, T.ArrayType):
        return F.transform(col, lambda x: _fit(x, have.elementType, want.elementType))
    return col.cast(want)


def hide_unstored(df: DataFrame, spec: Spec) -> DataFrame:
    """Drop fields declared ``store: false`` from the returned body; apply it after filtering."""
    from foliant.functions.paths import del_path

    for path, f in spec.walk():
        parents = split_path(path)[:-1]
        hidden_above = any(not spec.field(".".join(parents[: i + 1])).store for i in range(len(parents)))
        if not f.store and not hidden_above:
            df = del_path(df, ["entry", *split_path(path)])
    return df


def extend(spec: Spec, fields: dict[str, Field]) -> Spec:
    return spec.with_fields({**spec.fields, **fields})
