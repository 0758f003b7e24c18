"""Whole-record operators: flatten to paths, list fields, rename, default, replace text."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import (
    descend,
    flat_type,
    flatten_all,
    parts_of,
    path_text,
    path_type,
    string_leaves,
    type_at,
    update,
)
from foliant.plans.spec import Spec

PATH_ROW = "array<struct<field:string,template:string,value:string,kind:string>>"


def _kind(dtype: T.DataType) -> str:
    return "array" if isinstance(dtype, T.ArrayType) else "object" if isinstance(dtype, T.StructType) else dtype.simpleString()


def _slot(depth: int) -> str:
    return f"{{{depth}}}"


@dataclass
class _Group:
    """The values that lie in the same arrays: each array found in a record makes a group of what its elements hold."""

    above: tuple[int, ...]  # the groups of the arrays around, outermost first, itself last
    made: list[Column] = field(default_factory=list)  # its values, and the arrays in it, as columns
    rows: list[Column] = field(default_factory=list)


def _groups(root: Column, dtype: T.StructType, inner: bool) -> list[_Group]:
    groups = [_Group(())]
    names = itertools.count()

    def walk(col: Column, dt: T.DataType, name: str, template: str, group: int) -> None:
        nested = isinstance(dt, (T.ArrayType, T.StructType))
        if inner or not nested:
            own = f"_v{next(names)}"
            groups[group].made.append((col.isNotNull() if nested else col).alias(own))
            value = F.lit(None).cast("string") if nested else F.col(own).cast("string")
            # an absent value has no kind, which is how its row is dropped later
            kind = F.when(F.col(own) if nested else F.col(own).isNotNull(), _kind(dt))
            groups[group].rows.append(F.struct(F.lit(name).alias("field"), F.lit(template).alias("template"), value.alias("value"), kind.alias("kind")))
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(col.getField(f.name), f.dataType, f"{name}.{f.name}", f"{template}.{f.name}", group)
        elif isinstance(dt, T.ArrayType):
            above, n = groups[group].above, len(groups)
            groups.append(_Group((*above, n)))
            groups[group].made.append(col.alias(f"_a{n}"))
            walk(F.col(f"_x{n}"), dt.elementType, name, f"{template}.{_slot(len(above))}", n)

    for f in dtype.fields:
        walk(root.getField(f.name), f.dataType, f.name, f.name, 0)
    return groups


def _depth(dtype: T.DataType) -> int:
    if isinstance(dtype, T.ArrayType):
        return 1 + _depth(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return max((_depth(f.dataType) for f in dtype.fields), default=0)
    return 0


def flatten_paths(df: DataFrame, keys: list[str], root: str = "entry", inner: bool = False) -> DataFrame:
    """One row per (entry, path, value): ``path`` holds positions, ``field`` does not. One scan, no shuffle.

    ``inner=True`` also lists the objects and arrays above the values. A record is a row per group of values first, then a
    row per element of the arrays around the group, and last a row per value: no array of all paths of a record is made.
    What a step explodes is a column of its own before: column pruning goes wrong for members of exploded objects.
    A path is kept as a constant template and the positions that go into it, so the row itself builds no text.
    """
    dtype = df.schema[root].dataType
    groups = _groups(F.col(root), dtype, inner)
    rows = df.select(*keys, *groups[0].made).select("*", F.explode(F.array(*[F.lit(n) for n in range(len(groups))])).alias("_group"))
    for n, group in enumerate(groups[1:], 1):
        inside = [m for m, other in enumerate(groups) if n in other.above]
        others = [c for c in rows.columns if c != f"_a{n}"]
        rows = rows.select("*", F.posexplode_outer(F.when(F.col("_group").isin(inside), F.col(f"_a{n}"))).alias(f"_i{n}", f"_x{n}"))
        rows = rows.select(*others, f"_i{n}", *group.made)
    built, positions = F.lit(None).cast(PATH_ROW), F.array().cast("array<int>")
    for n, group in reversed(list(enumerate(groups))):
        here = F.col("_group") == n
        if group.rows:
            built = F.when(here, F.array(*group.rows)).otherwise(built)
        if group.above:
            positions = F.when(here, F.array(*[F.col(f"_i{m}") for m in group.above])).otherwise(positions)
    rows = rows.select("*", F.explode_outer(built).alias("r")).filter("r.kind IS NOT NULL").withColumn("_positions", positions)
    path = F.col("r.template")
    for depth in range(_depth(dtype)):
        number = F.coalesce(F.get("_positions", F.lit(depth)).cast("string"), F.lit(""))
        path = F.replace(path, F.lit(_slot(depth)), number)
    return rows.select(
        *keys,
        path.alias("path"),
        F.col("r.field").alias("field"),
        F.col("_positions").alias("positions"),
        F.col("r.value").alias("value"),
        F.col("r.kind").alias("kind"),
    )


def flatten_extra(df: DataFrame, keys: list[str], raw: str, declared: list[str] | None = None) -> DataFrame:
    """One row per top-level member of a JSON text that the spec does not declare."""
    spark = df.sparkSession
    members = spark.tvf.variant_explode_outer(F.try_parse_json(F.col(raw)).outer())
    out = df.lateralJoin(members).select(
        *keys, F.col("key").alias("field"), F.col("value").cast("string").alias("value")
    ).filter(F.col("field").isNotNull())
    return out.filter(~F.col("field").isin(declared)) if declared else out


def _field_names(dtype: T.DataType, prefix: str = "") -> list[str]:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    names = []
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            names.append(prefix + f.name)
            names.extend(_field_names(f.dataType, f"{prefix}{f.name}."))
    return names


def field_inventory(df: DataFrame, spec: Spec | None = None, root: str = "entry") -> DataFrame:
    """(field, values, entries, declared): how often each field occurs, against the declared fields.

    Occurrences are counted inside each record, so one aggregation with map-side combining is enough.
    """
    dtype = df.schema[root].dataType
    counts = []
    for name in _field_names(dtype):
        parts = parts_of(name)
        nested = descend(F.col(root), dtype, parts, lambda c, _: c)
        inner = path_type(dtype, parts)
        own = type_at(dtype, parts)
        # an array that is the last part counts once per holder, so stop above its own level
        if isinstance(own, T.ArrayType):
            nested = descend(F.col(root), dtype, parts, lambda c, _: F.when(c.isNotNull(), F.lit(1)))
            inner = path_type(T.StructType([T.StructField("x", _swap(dtype, parts))]), ["x", *parts])
        flat = F.coalesce(flatten_all(nested, inner), F.array().cast(T.ArrayType(_innermost(inner))))
        counts.append(
            F.struct(F.lit(name).alias("field"), F.size(F.filter(flat, lambda x: x.isNotNull())).alias("n"))
        )
    rows = df.select(F.explode(F.array(*counts)).alias("r")).filter("r.n > 0")
    seen = rows.groupBy(F.col("r.field").alias("field")).agg(
        F.sum(F.col("r.n").cast("long")).alias("values"), F.count(F.lit(1)).alias("entries")
    )
    if spec is None:
        return seen
    declared = df.sparkSession.createDataFrame([(path,) for path, _ in spec.walk()], "field string")
    declared = declared.withColumn("declared", F.lit(True))
    return seen.join(declared, "field", "full_outer").select(
        "field",
        F.coalesce("values", F.lit(0)).alias("values"),
        F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce("declared", F.lit(False)).alias("declared"),
    )


def _innermost(dtype: T.DataType) -> T.DataType:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype


def _swap(dtype: T.DataType, parts: list) -> T.DataType:
    """``dtype`` with the type at ``parts`` replaced by an integer."""
    if not parts:
        return T.IntegerType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_swap(dtype.elementType, parts))
    return T.StructType(
        [T.StructField(f.name, _swap(f.dataType, parts[1:]) if f.name == parts[0] else f.dataType) for f in dtype.fields]
    )


def explode_path(df: DataFrame, path: str, keys: list[str], arrays: bool = True, root: str = "entry") -> DataFrame:
    """One row per occurrence of a path, with the positions of the arrays crossed and the value.

    ``arrays=False`` does not descend into an array that is the last part of the path.
    """
    parts = parts_of(path)
    dtype = df.schema[root].dataType

    def go(col: Column, dt: T.DataType, rest: list, at: Column, positions: Column) -> Column:
        if isinstance(dt, T.ArrayType) and rest and isinstance(rest[0], int):
            here = F.concat(at, F.lit(f".{rest[0]}"))
            return go(F.get(col, F.lit(rest[0])), dt.elementType, rest[1:], here, F.concat(positions, F.array(F.lit(rest[0]))))
        if isinstance(dt, T.ArrayType) and (rest or arrays):
            return F.flatten(
                F.transform(
                    col,
                    lambda x, i: go(
                        x,
                        dt.elementType,
                        rest,
                        F.concat(at, F.lit("."), i.cast("string")),
                        F.concat(positions, F.array(i)),
                    ),
                )
            )
        if not rest:
            row = F.struct(at.alias("path"), positions.alias("positions"), col.alias("value"))
            return F.filter(F.array(row), lambda r: r.getField("value").isNotNull())
        field = dt[rest[0]]
        sep = F.concat(at, F.lit(f".{rest[0]}")) if rest is not parts else F.lit(rest[0])
        return go(col.getField(rest[0]), field.dataType, rest[1:], sep, positions)

    rows = go(F.col(root), dtype, parts, F.lit(""), F.array().cast("array<int>"))
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.path", "r.positions", "r.value")


# ---------------------------------------------------------------- rename and default


class RenameError(ValueError):
    pass


def _crosses_array(dtype: T.DataType, parts: list) -> bool:
    return any(isinstance(type_at(dtype, parts[: i + 1]), T.ArrayType) for i in range(len(parts)))


def rename_field(df: DataFrame, old: str, new: str, root: str = "entry", check: bool = True) -> DataFrame:
    """Rename a field or move it to another level; nothing happens when it is absent or the names are equal.

    Ambiguity and missing parents are decided from the schema; with ``check`` one aggregation looks for records whose
    new field is already taken or whose new parent is missing.
    """
    src, dst = parts_of(old), parts_of(new)
    dtype = df.schema[root].dataType
    old_type = type_at(dtype, src)
    if src == dst or old_type is None:
        return df
    if type_at(dtype, dst) is not None and src[: len(dst)] == dst:
        raise RenameError("new field already exists")
    if dst[: len(src)] == src:
        raise RenameError("old and new fields overlap")
    parent = dst[:-1]
    if parent and not isinstance(_element(type_at(dtype, parent)), T.StructType):
        raise RenameError("parent of new field does not exist")
    shared = 0
    while shared < min(len(src) - 1, len(parent)) and src[shared] == parent[shared]:
        shared += 1
    # below the last object both paths share, no array may lie on the way to the new parent
    base = type_at(dtype, src[:shared])
    if _crosses_array(_element(base), parent[shared:]):
        raise RenameError("parent of new field is ambiguous")
    below = src[shared:]

    def moved(obj: Column, obj_type: T.StructType) -> tuple[Column, Column]:
        nested = descend(obj, obj_type, below, lambda c, _: c)
        if not _crosses_array(obj_type, below[:-1]):
            return nested, nested.isNotNull().cast("int")
        # several holders below one parent: only one of them may carry the field
        typed = path_type(obj_type, below)
        while array_levels(typed) > array_levels(old_type) + 1:
            nested, typed = F.flatten(F.filter(nested, lambda x: x.isNotNull())), typed.elementType
        kept = F.filter(nested, lambda x: x.isNotNull())
        return F.get(kept, F.lit(0)), F.size(kept)

    if check:
        conflicts = _rename_conflicts(df, root, dtype, src, dst, shared, moved)
        for message, n in conflicts.items():
            if n:
                raise RenameError(message)

    def rebuild(obj: Column | None, obj_type: T.DataType | None, _parent: Column) -> Column:
        value, _ = moved(obj, _element(obj_type))
        known = type_at(_element(obj_type), parent[shared:] + [dst[-1]])

        def put(existing: Column | None, _t: T.DataType | None, _p: Column) -> Column:
            return F.coalesce(value, existing) if known is not None and existing is not None else value

        out = update(obj, _element(obj_type), parent[shared:] + [dst[-1]], put)
        shape = _with_field(_element(obj_type), parent[shared:] + [dst[-1]], old_type)
        return update(out, shape, below, lambda *_: None)

    if shared == 0:
        return df.withColumn(root, rebuild(F.col(root), dtype, F.col(root)))

    def each(col: Column | None, dt: T.DataType | None, holder: Column) -> Column:
        if isinstance(dt, T.ArrayType):
            return F.transform(col, lambda x: rebuild(x, dt.elementType, holder))
        return rebuild(col, dt, holder)

    return df.withColumn(root, update(F.col(root), dtype, src[:shared], each))


def array_levels(dtype: T.DataType) -> int:
    return 1 + array_levels(dtype.elementType) if isinstance(dtype, T.ArrayType) else 0


def _element(dtype: T.DataType | None) -> T.DataType | None:
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype


def _with_field(dtype: T.StructType, parts: list, new: T.DataType) -> T.StructType:
    if len(parts) == 1:
        others = [f for f in dtype.fields if f.name != parts[0]]
        return T.StructType([*others, T.StructField(parts[0], new)])
    return T.StructType(
        [T.StructField(f.name, _with_field(f.dataType, parts[1:], new) if f.name == parts[0] else f.dataType) for f in dtype.fields]
    )


def _rename_conflicts(df, root, dtype, src, dst, shared, moved) -> dict[str, int]:
    taken_known = type_at(dtype, dst) is not None
    parent = dst[:-1]

    def report(obj: Column, obj_type: T.StructType) -> Column:
        value, n = moved(obj, obj_type)
        present = n > 0
        target = descend(obj, obj_type, dst[shared:], lambda c, _: c).isNotNull() if taken_known else F.lit(False)
        holder = obj
        for part in parent[shared:]:
            holder = holder.getField(part)
        return F.struct(
            (present & (target | (n > 1))).cast("int").alias("taken"),
            (present & holder.isNull()).cast("int").alias("orphan"),
        )

    holder_type = type_at(dtype, src[:shared])
    if shared == 0:
        reports = F.array(report(F.col(root), dtype))
    else:
        nested = descend(F.col(root), dtype, src[:shared], lambda c, _: c)
        flat = flatten_all(nested, path_type(dtype, src[:shared]))
        reports = F.transform(F.filter(flat, lambda x: x.isNotNull()), lambda x: report(x, _element(holder_type)))
    sums = df.select(reports.alias("r")).agg(
        F.sum(F.expr("cast(aggregate(r, 0, (s, x) -> s + coalesce(x.taken, 0)) as bigint)")).alias("taken"),
        F.sum(F.expr("cast(aggregate(r, 0, (s, x) -> s + coalesce(x.orphan, 0)) as bigint)")).alias("orphan"),
    )
    row = sums.first()
    return {"new field already exists": row["taken"] or 0, "parent of new field does not exist": row["orphan"] or 0}


def add_default(df: DataFrame, path: str, value: object, root: str = "entry") -> DataFrame:
    """Fill a missing field of every existing parent; a collection that has elements is left alone."""
    parts = parts_of(path)
    dtype = df.schema[root].dataType

    def fill(old: Column | None, old_type: T.DataType | None, _parent: Column) -> Column:
        default = value if isinstance(value, Column) else F.lit(value)
        if old is None or old_type is None:
            return default
        if isinstance(old_type, T.ArrayType):
            try:
                default = default.cast(old_type) if isinstance(value, (list, Column)) else F.lit(None).cast(old_type)
            except TypeError:
                default = F.lit(None).cast(old_type)
            return F.when(F.size(F.coalesce(old, F.array().cast(old_type))) > 0, old).otherwise(F.coalesce(default, old))
        return F.coalesce(old, default.cast(old_type))

    return df.withColumn(root, update(F.col(root), dtype, parts, fill))


# ---------------------------------------------------------------- search and replace


def replace_text(df: DataFrame, replacements: DataFrame, root: str = "entry") -> DataFrame:
    """Replace substrings in every string of the entries named by ``replacements(id, pos, search, replace)``.
    A column ``resource`` beside ``id`` tells collections with equal ids apart.

    Returns the changed entries only, as update commands would carry them. The edits of one entry are applied in
    order, as one small script per entry; entries without edits never leave the scan side of the join.
    """
    keys = [c for c in ("resource", "id") if c in replacements.columns and c in df.columns]
    scripts = replacements.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "search", "replace"))).alias("edits")
    )
    joined = df.join(scripts, keys)
    dtype = df.schema[root].dataType

    def edit(leaf: Column) -> Column:
        return F.aggregate(
            F.col("edits"), leaf, lambda s, e: F.replace(s, e.getField("search"), e.getField("replace"))
        )

    changed = joined.withColumn("_new", string_leaves(F.col(root), dtype, edit))
    changed = changed.filter(~F.col("_new").eqNullSafe(F.col(root)))
    return changed.withColumn(root, F.col("_new")).select(*df.columns)


__all__ = [
    "add_default",
    "explode_path",
    "field_inventory",
    "flat_type",
    "flatten_extra",
    "flatten_paths",
    "path_text",
    "rename_field",
    "replace_text",
    "RenameError",
]
