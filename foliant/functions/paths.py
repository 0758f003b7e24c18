"""Dotted paths through structs and arrays, compiled from the schema to nested built-in expressions.

A path maps over arrays, one level of nesting per array crossed. It may hold integer positions. Inside an array
element a path is rooted at that element, which is how sibling values are looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans.spec import split_path

Leaf = Callable[[Column, T.DataType], Column]


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def parts_of(path: str | list) -> list:
    """Path components; digits in a dotted path are positions."""
    return [int(p) if isinstance(p, str) and p.isdigit() else p for p in split_path(path)]


def path_text(path: str | list, strip_positions: bool = False) -> str:
    return ".".join(str(p) for p in parts_of(path) if not (strip_positions and isinstance(p, int)))


def type_at(dtype: T.DataType, path: str | list) -> T.DataType | None:
    """The type of one value at a path (arrays crossed are not counted), or None where there is no such field."""
    for part in parts_of(path):
        if isinstance(part, int):
            if not isinstance(dtype, T.ArrayType):
                return None
            dtype = dtype.elementType
            continue
        while isinstance(dtype, T.ArrayType):
            dtype = dtype.elementType
        if not isinstance(dtype, T.StructType) or part not in dtype.fieldNames():
            return None
        dtype = dtype[part].dataType
    return dtype


def array_depth(dtype: T.DataType) -> int:
    return 1 + array_depth(dtype.elementType) if isinstance(dtype, T.ArrayType) else 0


def descend(col: Column, dtype: T.DataType, parts: list, leaf: Leaf) -> Column:
    """Apply ``leaf`` to every value at ``parts``, keeping one array level per array crossed."""
    if not parts:
        return leaf(col, dtype)
    if isinstance(dtype, T.ArrayType):
        if isinstance(parts[0], int):
            return descend(F.get(col, F.lit(parts[0])), dtype.elementType, parts[1:], leaf)
        return F.transform(col, lambda x: descend(x, dtype.elementType, parts, leaf))
    if not isinstance(dtype, T.StructType) or parts[0] not in dtype.fieldNames():
        raise KeyError(f"no field {parts[0]!r}")
    return descend(col.getField(parts[0]), dtype[parts[0]].dataType, parts[1:], leaf)


def get_path(df: DataFrame, path: str | list) -> Column:
    """The value at a path that starts at a column of ``df``."""
    head, *rest = parts_of(path)
    return descend(F.col(f"`{head}`"), df.schema[head].dataType, rest, lambda c, _: c)


def flatten_all(col: Column, dtype: T.DataType) -> Column:
    """Any depth of nested arrays as one array; a single value becomes an array of one."""
    depth = array_depth(dtype)
    if depth == 0:
        return F.when(col.isNotNull(), F.array(col)).otherwise(F.array().cast(T.ArrayType(dtype)))
    out = col
    while depth > 1:
        # a null inner array would null the whole result
        out = F.flatten(F.filter(out, lambda x: x.isNotNull()))
        depth -= 1
    return out


def path_type(dtype: T.DataType, parts: list) -> T.DataType:
    """The type ``descend`` gives: nested arrays around the value."""
    if not parts:
        return dtype
    if isinstance(dtype, T.ArrayType):
        if isinstance(parts[0], int):
            return path_type(dtype.elementType, parts[1:])
        return T.ArrayType(path_type(dtype.elementType, parts))
    return path_type(dtype[parts[0]].dataType, parts[1:])


def values_at(col: Column, dtype: T.DataType, path: str | list) -> Column:
    """All values at a path as one flat array without nulls."""
    parts = parts_of(path)
    nested = descend(col, dtype, parts, lambda c, _: c)
    flat = flatten_all(nested, path_type(dtype, parts))
    return F.filter(F.coalesce(flat, F.array().cast(flat_type(dtype, parts))), lambda x: x.isNotNull())


def flat_type(dtype: T.DataType, parts: list) -> T.ArrayType:
    inner = path_type(dtype, parts)
    while isinstance(inner, T.ArrayType):
        inner = inner.elementType
    return T.ArrayType(inner)


def has_value(col: Column, dtype: T.DataType) -> Column:
    """Whether a value is present: some non-null member for arrays and objects."""
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(col, lambda x: has_value(x, dtype.elementType)), F.lit(False))
    if isinstance(dtype, T.StructType):
        found = F.lit(False)
        for f in dtype.fields:
            found = found | has_value(col.getField(f.name), f.dataType)
        return found
    return col.isNotNull()


def has_path(df: DataFrame, path: str | list) -> Column:
    """Whether a path occurs: the field itself is there, whatever it holds (an empty array holds no occurrence)."""
    head, *rest = parts_of(path)
    dtype = df.schema[head].dataType
    if type_at(dtype, rest) is None:
        return F.lit(False)

    def present(col: Column, dt: T.DataType, parts: list) -> Column:
        if isinstance(dt, T.ArrayType):
            if parts and isinstance(parts[0], int):
                item = F.get(col, F.lit(parts[0]))
                return present(item, dt.elementType, parts[1:])
            return F.exists(col, lambda x: present(x, dt.elementType, parts))
        if not parts:
            return col.isNotNull()
        return present(col.getField(parts[0]), dt[parts[0]].dataType, parts[1:])

    return F.coalesce(present(F.col(f"`{head}`"), dtype, rest), F.lit(False))


Update = Callable[[Column | None, T.DataType | None, Column], Column | None]


def update(col: Column, dtype: T.DataType, parts: list, fn: Update) -> Column:
    """Rebuild ``col`` with the value at ``parts`` replaced by ``fn(old, type, parent)``; None drops the field.

    Only the structs and arrays along the path are rebuilt. A missing parent stays missing.
    """
    if isinstance(dtype, T.ArrayType):
        if parts and isinstance(parts[0], int):
            position, rest = parts[0], parts[1:]
            if not rest:
                return F.transform(col, lambda x, i: F.when(i == position, fn(x, dtype.elementType, col)).otherwise(x))
            return F.transform(
                col, lambda x, i: F.when(i == position, update(x, dtype.elementType, rest, fn)).otherwise(x)
            )
        return F.transform(col, lambda x: update(x, dtype.elementType, parts, fn))
    if not isinstance(dtype, T.StructType):
        raise KeyError(f"no object above {parts[0]!r}")
    name, rest = parts[0], parts[1:]
    known = name in dtype.fieldNames()
    if rest:
        if not known:
            raise KeyError(f"no field {name!r}")
        rebuilt = update(col.getField(name), dtype[name].dataType, rest, fn)
        return F.when(col.isNotNull(), col.withField(name, rebuilt))
    value = fn(col.getField(name) if known else None, dtype[name].dataType if known else None, col)
    if value is None:
        if not known:
            return col
        if len(dtype.fields) == 1:  # a struct keeps at least one member
            return F.when(col.isNotNull(), col.withField(name, F.lit(None).cast(dtype[name].dataType)))
        return col.dropFields(name)
    return F.when(col.isNotNull(), col.withField(name, value))


def set_path(df: DataFrame, path: str | list, value: Column) -> DataFrame:
    """Set the value at a position (or, without positions, everywhere the parent exists)."""
    head, *rest = parts_of(path)
    if not rest:
        return df.withColumn(head, value)
    return df.withColumn(head, update(F.col(f"`{head}`"), df.schema[head].dataType, rest, lambda *_: value))


def del_path(df: DataFrame, path: str | list) -> DataFrame:
    """Delete a field. At a position the field becomes absent in that element only; an element is removed whole."""
    head, *rest = parts_of(path)
    if not rest:
        return df.drop(head)
    dtype = df.schema[head].dataType
    if type_at(dtype, rest) is None:
        raise KeyError(path_text(path))
    if rest and isinstance(rest[-1], int):
        position = rest[-1]

        def without(arr: Column | None, _t: T.DataType | None, _p: Column) -> Column:
            return F.filter(arr, lambda _x, i: i != position)

        return df.withColumn(head, update(F.col(f"`{head}`"), dtype, rest[:-1], without))
    if any(isinstance(p, int) for p in rest):
        return df.withColumn(
            head, update(F.col(f"`{head}`"), dtype, rest, lambda _c, t, _p: F.lit(None).cast(t))
        )
    return df.withColumn(head, update(F.col(f"`{head}`"), dtype, rest, lambda *_: None))


Keep = Callable[[tuple, Column, T.DataType], Column | None]


def prune(col: Column, dtype: T.DataType, keep: Keep, at: tuple = ()) -> Column:
    """Keep only members and elements for which ``keep(path, value, type)`` holds, at every level.

    ``keep`` returns None for values it has no opinion on; those stay.
    """
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        test = keep(at, F.lit(None).cast(inner), inner)
        kept = col if test is None else F.filter(col, lambda x: F.coalesce(keep(at, x, inner), F.lit(True)))
        if isinstance(inner, (T.StructType, T.ArrayType)):
            kept = F.transform(kept, lambda x: prune(x, inner, keep, at))
        return kept
    if isinstance(dtype, T.StructType):
        members = []
        for f in dtype.fields:
            value, path = col.getField(f.name), (*at, f.name)
            test = keep(path, value, f.dataType)
            pruned = prune(value, f.dataType, keep, path)
            members.append((pruned if test is None else F.when(F.coalesce(test, F.lit(True)), pruned)).alias(f.name))
        return F.when(col.isNotNull(), F.struct(*members))
    return col


def string_leaves(col: Column, dtype: T.DataType, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to every string in a nested value."""
    if isinstance(dtype, T.StringType):
        return fn(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: string_leaves(x, dtype.elementType, fn))
    if isinstance(dtype, T.StructType):
        members = [string_leaves(col.getField(f.name), f.dataType, fn).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*members))
    return col


# ---------------------------------------------------------------- visibility


def visible(col: Column, dtype: T.DataType, printed: bool = False) -> Column:
    """The part of a nested value a reader sees: objects whose ``visas`` is not false and, for print, whose
    ``endastDigitalt`` is not true."""

    def keep(_path: tuple, value: Column, dt: T.DataType) -> Column | None:
        return is_visible(value, dt, printed) if isinstance(dt, T.StructType) else None

    return prune(col, dtype, keep)


def is_visible(value: Column, dtype: T.StructType, printed: bool = False) -> Column:
    names = dtype.fieldNames()
    shown = F.coalesce(value.getField("visas"), F.lit(True)) if "visas" in names else F.lit(True)
    if printed and "endastDigitalt" in names:
        shown = shown & ~F.coalesce(value.getField("endastDigitalt"), F.lit(False))
    return shown
