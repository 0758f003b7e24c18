"""Derived functions for dictionary collections; importing this module makes them available by name.

``inflection`` (lemma, table, kind), ``valency`` (valens), ``forward_references`` (entry), ``id_info`` (entry),
``neighbours`` (id, class, vector). An empty path as parameter stands for the whole entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import references, vectors
from foliant.operators.derive import register
from foliant.operators.inflection import forms, table
from foliant.operators.valency import expand_patterns

_TEXT = {"type": "string"}


def _objects(fields: dict, **more) -> dict:
    return {"type": "object", "collection": True, "fields": fields, "cache_plugin_expansion": False, **more}


def _inflection(_fixed: dict, p: dict):
    return table(forms(p["lemma"], p["kind"] if "kind" in p else F.lit(None).cast("string"), p["table"].getField("definition")))


def _valency(_context, _fixed: dict, combos: DataFrame) -> DataFrame:
    """The variants of each distinct pattern; an array holds those of one pattern."""
    made = expand_patterns(combos, ["valens"], "valens")
    variants = made.groupBy("valens").agg(F.array_sort(F.collect_list(F.struct("position", "variant"))).alias("v"))
    joined = combos.join(variants.withColumnRenamed("valens", "_v"), F.col("valens") == F.col("_v"), "left")
    rows = F.transform("v", lambda x: F.struct(x["variant"].alias("exp_valens")))
    return joined.select("valens", F.coalesce(rows, F.array().cast("array<struct<exp_valens:string>>")).alias("result"))


def _neighbours(_context, fixed: dict, combos: DataFrame) -> DataFrame:
    """The nearest entries of each, at most ``k`` of them."""
    found = vectors.knn(combos, int(fixed.get("k", vectors.K)))
    near = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("n"))
    rows = F.transform("n", lambda x: F.struct(x["neighbour"].cast("string").alias("id"), x["similarity"].alias("score")))
    joined = combos.join(near.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    return joined.select("id", "class", "vector", rows.alias("result"))


register(
    "inflection",
    _inflection,
    _objects(
        {
            "heading": _TEXT,
            "rows": _objects(
                {
                    "linenumber": {"type": "number"},
                    "preform": _objects({"prescript": _TEXT, "form": _TEXT, "tag": _TEXT}),
                    "postscript": _TEXT,
                    "extra": _TEXT,
                }
            ),
        }
    ),
)
register("valency", _valency, _objects({"exp_valens": _TEXT}), "table")
register(
    "forward_references",
    lambda _f, p, types: references.forward_refs_of(p["entry"], types["entry"]),
    _objects({"ref": _TEXT, "visas": {"type": "boolean"}}),
    "typed",
)
register(
    "id_info",
    lambda _f, p, types: references.id_info_of(p["entry"], types["entry"]),
    _objects({"id": _TEXT, **{a: _TEXT for a in references.ATTRIBUTES}}),
    "typed",
)
register("neighbours", _neighbours, _objects({"id": _TEXT, "score": {"type": "number"}}), "table")
