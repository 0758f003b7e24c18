"""Members of a record that its typed body cannot hold, kept as one variant beside it.

``rest_of`` takes from a JSON record what the spec does not declare, at any depth, explicit nulls, and values of another
type than declared. ``merged`` puts body and rest together again, so that a record comes out with the members, the
nesting and the nulls that it came in with. ``rest_changes`` lists the differences of two rests leaf by leaf.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import bind
from foliant.plans.spec import SCALARS, Field, Spec

MEMBERS = "map<string,variant>"
NUMBER = r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"
#: Shapes of single values that are held whole by the types declared for them.
SHAPES = {"boolean": "BOOLEAN", "integer": "BIGINT", "number": NUMBER, "dense_vector": rf"ARRAY<(?:{NUMBER}|VOID)>"}


def _shape(f: Field) -> str:
    """A pattern of the shapes of values, without any null in them, that a declared field holds whole."""
    if f.is_object:
        names = [(name, g) for name, g in f.fields.items() if not g.virtual]
        known = "|".join(f"(?:{re.escape(name)}|`{re.escape(name.replace('`', '``'))}`): {_shape(g)}" for name, g in names)
        one = f"OBJECT<(?:(?:{known})(?:, |(?=>)))*>" if names else "OBJECT<>"
    else:
        one = SHAPES.get(f.type, "STRING" if SCALARS[f.type] == T.StringType() else "(?!)")
    return f"ARRAY<(?:{one}|VOID)>" if f.collection else one


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", MEMBERS)


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _none() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))


def _object(members: Column) -> Column:
    return F.to_variant_object(F.coalesce(members, _none()))


def _fits(v: Column, f: Field) -> Column:
    """Whether a value has the shape of one declared value."""
    if f.is_object:
        return _members(v).isNotNull()
    shape = F.schema_of_variant(v)
    if SCALARS[f.type] == T.StringType():
        return shape == "STRING"
    if f.type == "boolean":
        return shape == "BOOLEAN"
    if f.type == "dense_vector":
        return _items(v).isNotNull()
    number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    if f.type == "integer":
        value = F.try_variant_get(v, "$", "double")
        return (shape == "BIGINT") | (number & (value == F.floor(value)))
    return number


def _fitting(f: Field):
    return lambda x: F.is_variant_null(x) | F.coalesce(_fits(x, f), F.lit(False))


def _kept_of(member: Column, f: Field, plain: Column) -> Column:
    """What to keep of a declared member, as a variant; null if its body holds all of it.

    Objects are mostly held whole, which their shape tells in one step: the shape of all elements of an array names every
    member that one of them has, and mixed types are none that is declared. Only nulls do not show in it, so it counts
    for records without any (``plain``). All others are looked into member by member.
    """
    kept = _looked_into(member, f, plain)
    if not f.is_object:
        return kept
    whole = plain & F.rlike(F.schema_of_variant(member), F.lit(rf"\A{_shape(f)}\z"))
    return F.when(whole, F.lit(None).cast("variant")).otherwise(kept)


def _looked_into(member: Column, f: Field, plain: Column) -> Column:
    if not f.collection:
        fits = F.coalesce(_fits(member, f), F.lit(False)) & ~F.is_variant_null(member)
        below = bind(_rest(member, f.fields, plain), lambda m: F.when(m.isNotNull(), F.to_variant_object(m))) if f.is_object else F.lit(None).cast("variant")
        return F.when(fits, below).otherwise(member)

    def of_items(items: Column) -> Column:
        fits = F.coalesce(F.forall(items, _fitting(f)), F.lit(False))
        if not f.is_object:
            return F.when(~fits, member)
        each = F.transform(items, _resting(f.fields, plain))
        some = bind(each, lambda rests: F.when(F.exists(rests, lambda x: x.isNotNull()), F.to_variant_object(F.transform(rests, _object))))
        return F.when(fits, some).otherwise(member)

    return bind(_items(member), of_items)


def _rest(v: Column, fields: dict[str, Field], plain: Column) -> Column:
    """The members to keep of an object, as a map; null if there are none."""
    declared = {name: f for name, f in fields.items() if not f.virtual}

    def of_members(given: Column) -> Column:
        kept = given
        if declared:
            names = F.array(*map(F.lit, declared))
            pairs = [F.struct(F.lit(n).alias("key"), bind(F.element_at(given, F.lit(n)), _keeping(f, plain)).alias("value")) for n, f in declared.items()]
            parts = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
            kept = F.map_concat(F.map_filter(given, lambda k, _x: ~F.array_contains(names, k)), parts)
        return bind(kept, lambda m: F.when(F.size(m) > 0, m))

    return bind(_members(v), of_members)


def _keeping(f: Field, plain: Column):
    return lambda member: F.when(member.isNotNull(), _kept_of(member, f, plain))


def _resting(fields: dict[str, Field], plain: Column):
    return lambda x: _rest(x, fields, plain)


def rest_of(raw: Column, spec: Spec) -> Column:
    """What the body of a JSON record does not hold, as a variant; null if that is nothing or the text is no object."""
    plain = ~F.contains(raw, F.lit("null"))
    return bind(_rest(F.try_parse_json(raw), spec.fields, plain), lambda kept: F.when(kept.isNotNull(), F.to_variant_object(kept)))


def _merged(body: Column, rest: Column, fields: dict[str, Field]) -> Column:
    """The members of a body and its rest, as a map."""

    def with_rest(more: Column) -> Column:
        pairs = []
        for name, f in fields.items():
            if f.virtual:
                continue
            value, beside = body.getField(name), F.element_at(more, F.lit(name))
            if f.collection and f.is_object:
                shown = bind(_items(beside), _merging_all(value, f.fields))
            elif f.is_object:
                shown = _object(_merged(value, beside, f.fields))
            else:  # what the rest holds of such a field is the whole value
                shown = F.to_variant_object(value) if f.collection or f.type == "dense_vector" else value.cast("variant")
                shown = F.coalesce(beside, shown)
            pairs.append(F.struct(F.lit(name).alias("key"), F.when(value.isNotNull(), shown).alias("value")))
        if not pairs:
            return more
        typed = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
        return bind(typed, lambda t: F.map_concat(t, F.map_filter(more, lambda k, _x: ~F.map_contains_key(t, k))))

    return bind(F.coalesce(_members(rest), _none()), with_rest)


def _merging_all(value: Column, fields: dict[str, Field]):
    return lambda items: F.to_variant_object(F.transform(value, _merging(items, fields)))


def _merging(items: Column, fields: dict[str, Field]):
    return lambda x, i: F.when(x.isNotNull(), _object(_merged(x, F.get(items, i), fields))).otherwise(F.parse_json(F.lit("null")))


def merged(body: Column, rest: Column, spec: Spec, derived: Column | None = None) -> Column:
    """The record that body and rest were made of, as a variant; null where both are. ``derived``: a struct of more members."""
    members = _merged(body, rest, spec.fields)
    if derived is not None:
        more = F.coalesce(_members(F.parse_json(F.to_json(derived))), _none())
        members = bind(members, lambda m: F.map_concat(m, F.map_filter(more, lambda k, _x: ~F.map_contains_key(m, k))))
    return F.when(body.isNotNull() | rest.isNotNull(), _object(members))


def _show(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _changes(a, b, at: str, out: list) -> None:
    if isinstance(a, dict) and isinstance(b, dict):
        for name in sorted(a.keys() | b.keys()):
            path = f"{at}.{name}" if at else name
            if name not in b:
                out.append(("REMOVED", path, _show(a[name]), None))
            elif name not in a:
                out.append(("ADDED", path, None, _show(b[name])))
            else:
                _changes(a[name], b[name], path, out)
    elif isinstance(a, list) and isinstance(b, list):
        for i in range(max(len(a), len(b))):
            path = f"{at}[{i}]"
            if i >= len(b):
                out.append(("REMOVED", path, _show(a[i]), None))
            elif i >= len(a):
                out.append(("ADDED", path, None, _show(b[i])))
            else:
                _changes(a[i], b[i], path, out)
    elif type(a) is not type(b) or a != b:
        out.append(("CHANGE", at, _show(a), _show(b)))


CHANGE_ROW = "array<struct<type:string,field:string,before:string,after:string>>"


def _json_changes(a: str | None, b: str | None):
    out: list = []
    if a != b:
        _changes(json.loads(a) if a else {}, json.loads(b) if b else {}, "", out)
    return out


def rest_changes(a: Column, b: Column) -> Column:
    """Differences from rest ``a`` to rest ``b``; values as text, nulls as ``null``. The depth is not known beforehand, so
    the leaves are compared by a small helper in Arrow batches."""
    return F.udf(_json_changes, CHANGE_ROW, useArrow=True)(F.to_json(a), F.to_json(b))
