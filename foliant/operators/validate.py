"""Checking records against a declared schema, as expressions over their parsed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.paths import bind
from foliant.plans.spec import Field, Spec

_KIND = {"string": "string", "long_string": "string", "integer": "integer", "number": "number", "boolean": "boolean"}


def _no() -> Column:
    return F.array().cast("array<string>")


def _message(bad: Column, text: str) -> Column:
    return F.when(bad, F.array(F.lit(text))).otherwise(_no())


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def _scalar(v: Column, f: Field, path: str) -> Column:
    kind = _KIND[f.type]
    found = F.schema_of_variant(v)
    if kind == "string":
        good = found == "STRING"
    elif kind == "boolean":
        good = found == "BOOLEAN"
    else:
        number = F.rlike(found, F.lit(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"))
        if kind == "integer":
            value = F.try_variant_get(v, "$", "double")
            number = number & (value == F.floor(value))
        good = number
    return _message(~F.coalesce(good, F.lit(False)), f"{path} must be {kind}")


def _value(v: Column, f: Field, path: str) -> Column:
    if not f.is_object:
        return _scalar(v, f, path)
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    return F.when(is_object, _members(v, f.fields, path + ".")).otherwise(F.array(F.lit(f"{path} must be object")))


def _members(v: Column, fields: dict[str, Field], prefix: str) -> Column:
    out = []
    for name, f in fields.items():
        member, path = _member(v, name), prefix + name
        if f.virtual:
            out.append(_message(member.isNotNull(), f"{path} must not be given"))
            continue
        if f.collection:
            items = F.try_variant_get(member, "$", "array<variant>")
            checked = F.when(items.isNull(), F.array(F.lit(f"{path} must be array"))).otherwise(
                F.flatten(F.transform(items, _one_argument(f, path)))
            )
        else:
            checked = _value(member, f, path)
        absent = F.array(F.lit(f"{path} is required")) if f.required else _no()
        out.append(F.when(member.isNull(), absent).otherwise(checked))
    return F.flatten(F.array(*out)) if out else _no()


def _one_argument(f: Field, path: str):
    def each(x: Column) -> Column:
        return _value(x, f, f"{path}[]")

    return each


def problems(raw: Column, spec: Spec) -> Column:
    """The reasons a JSON record breaks its spec, as an array; empty for a valid one."""

    def judge(v: Column) -> Column:
        is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
        found = _members(v, spec.fields, "")
        if not spec.additional_properties:
            known = F.array(*[F.lit(n) for n in spec.fields]) if spec.fields else _no()
            undeclared = F.array_except(F.json_object_keys(raw), known)
            extra = F.transform(undeclared, lambda k: F.concat(k, F.lit(" is not declared")))
            found = F.concat(found, F.coalesce(extra, _no()))
        return (
            F.when(v.isNull(), F.array(F.lit("not valid JSON")))
            .when(~is_object, F.array(F.lit("record must be object")))
            .otherwise(found)
        )

    # the text is parsed once per record
    return bind(F.try_parse_json(raw), judge)


def check(df: DataFrame, spec: Spec, raw: str = "raw") -> DataFrame:
    """Records with their ``problems``."""
    return df.withColumn("problems", problems(F.col(raw), spec))


def validate(df: DataFrame, spec: Spec, raw: str = "raw", as_import: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid records, invalid records with ``problems``).

    ``as_import`` takes the record from the ``entry`` member of an envelope and leaves out delete commands.
    """
    if as_import:
        df = df.filter(~F.coalesce(F.get_json_object(raw, "$.cmdtype") == "delete_entry", F.lit(False)))
        df = df.withColumn(raw, F.get_json_object(raw, "$.entry"))
    checked = check(df, spec, raw)
    good = F.size("problems") == 0
    return checked.filter(good).drop("problems"), checked.filter(~good)


def error_count(invalid: DataFrame) -> DataFrame:
    return invalid.agg(F.count(F.lit(1)).alias("errors"))
