import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import paths as P
from foliant.operators import records as R

SHOP = "name string, aisles array<struct<floor:int,racks:array<struct<boxes:array<int>,open:boolean>>>>, owner struct<since:int,sold:struct<year:int>>"
BOOKS = {
    "name": "corner",
    "aisles": [
        {"floor": 0, "racks": [{"boxes": [7, 8], "open": True}, {"boxes": []}]},
        {"floor": 2, "racks": []},
        {"racks": [{"open": False}]},
    ],
    "owner": {"since": 1990},
}


def load(spark, doc, ddl=SHOP):
    row = spark.createDataFrame([(json.dumps(doc),)], "j string")
    return row.select(F.lit("1").alias("id"), F.from_json("j", ddl).alias("entry"))


def body(df):
    return json.loads(df.select(F.to_json("entry").alias("j")).first().j)


def value(df, path):
    return df.select(P.get_path(df, path).alias("v")).first().v


def test_reading(spark):
    df = load(spark, BOOKS)
    assert value(df, "entry.owner.since") == 1990 and value(df, "entry.owner.sold.year") is None
    assert value(df, "entry.aisles.floor") in ([0, 2, None], [0, 2])
    assert value(df, ["entry", "aisles", 1, "floor"]) == 2
    assert value(df, ["entry", "aisles", 0, "racks", 0, "boxes"]) == [7, 8]
    assert value(df, ["entry", "aisles", 0, "racks", 0, "boxes", 1]) == 8
    assert value(df, ["entry", "aisles", 0, "racks", "open"])[0] is True


def test_writing(spark):
    df = load(spark, BOOKS)
    changed = body(P.set_path(df, ["entry", "aisles", 0, "racks", 0, "boxes"], F.array(F.lit(1))))
    assert changed["aisles"][0]["racks"][0] == {"boxes": [1], "open": True} and changed["aisles"][1:] == body(df)["aisles"][1:]
    assert body(P.set_path(df, "entry.owner.since", F.lit(2001)))["owner"] == {"since": 2001}
    gone = body(P.del_path(df, ["entry", "aisles", 0, "racks", 0, "open"]))
    assert gone["aisles"][0]["racks"][0] == {"boxes": [7, 8]} and gone["aisles"][2] == {"racks": [{"open": False}]}
    assert body(P.del_path(df, "entry.aisles.racks"))["aisles"] == [{"floor": 0}, {"floor": 2}, {}]
    assert "owner" not in body(P.del_path(df, "entry.owner"))


def test_pruning(spark):
    ddl = "top struct<words:array<string>,one:string>, rest array<string>"
    df = load(spark, {"top": {"words": ["keep", "?", "keep too"], "one": "?"}, "rest": ["?"]}, ddl)
    kept = P.prune(F.col("entry"), df.schema["entry"].dataType, lambda _p, c, t: c != "?" if t.simpleString() == "string" else None)
    out = body(df.withColumn("entry", kept))
    assert out["top"] == {"words": ["keep", "keep too"]} and not out.get("rest")


def test_visible(spark):
    ddl = "so struct<visas:boolean,parts:array<struct<visas:boolean,endastDigitalt:boolean,n:int>>>"
    df = load(spark, {"so": {"parts": [{"n": 4}, {"visas": False, "n": 5}, {"visas": True, "endastDigitalt": True, "n": 6}]}}, ddl)
    dtype = df.schema["entry"].dataType
    shown = body(df.withColumn("entry", P.visible(F.col("entry"), dtype)))["so"]["parts"]
    assert [x["n"] for x in shown] == [4, 6]
    printed = body(df.withColumn("entry", P.visible(F.col("entry"), dtype, printed=True)))["so"]["parts"]
    assert [x["n"] for x in printed] == [4]


def test_all_paths_and_fields(spark):
    df = load(spark, BOOKS)
    rows = [r.path for r in R.flatten_paths(df, ["id"], inner=True).collect()]
    assert {"name", "aisles", "aisles.0.racks.0.boxes.1", "aisles.2.racks.0.open", "owner.since"} <= set(rows)
    assert len(rows) == len(set(rows)) and not any(p.startswith(("owner.sold", "aisles.2.floor")) for p in rows)
    fields = {r.field: (r["values"], r.entries) for r in R.field_inventory(df).collect()}
    assert fields["aisles.floor"] == (2, 1) and fields["owner.since"] == (1, 1) and fields["aisles.racks.open"] == (2, 1)


def test_expand_path(spark):
    df = load(spark, BOOKS)

    def found(path, **kw):
        return [r.path for r in R.explode_path(df, path, ["id"], **kw).collect()]

    assert found("aisles") == ["aisles.0", "aisles.1", "aisles.2"] and found("aisles", arrays=False) == ["aisles"]
    assert found("aisles.floor") == ["aisles.0.floor", "aisles.1.floor"]
    assert found("aisles.2.racks.open") == ["aisles.2.racks.0.open"]
    assert found("owner.since") == ["owner.since"] and found("owner.sold.year") == []


def test_has_path(spark):
    df = load(spark, BOOKS)
    expected = {"entry.aisles.floor": True, "entry.aisles.2.floor": False, "entry.aisles.1.floor": True, "entry.owner.sold": False, "entry.name": True, "entry.nowhere": False}
    assert {p: df.select(P.has_path(df, p).alias("h")).first().h for p in expected} == expected


def test_renaming(spark):
    df = load(spark, {"owner": {"since": 3, "sold": {"year": 4}}, "name": "x"})
    lower = R.rename_field(df, "owner.since", "owner.sold.since")
    assert body(lower) == {"owner": {"sold": {"year": 4, "since": 3}}, "name": "x"}
    assert body(R.rename_field(lower, "owner.sold.since", "owner.since")) == body(df)
    assert body(R.rename_field(df, "owner.sold", "owner.handed_on"))["owner"] == {"since": 3, "handed_on": {"year": 4}}
    assert body(R.rename_field(df, "owner.since", "owner.since")) == body(df)
    assert body(R.rename_field(df, "owner.unknown", "elsewhere")) == body(df)
    for source, target, problem in (
        ("owner.since", "name", "already exists"),
        ("owner", "owner.inside", "overlap"),
        ("owner.since", "owner.nowhere.deep", "does not exist"),
    ):
        with pytest.raises(R.RenameError, match=problem):
            R.rename_field(df, source, target)
    many = load(spark, BOOKS)
    with pytest.raises(R.RenameError, match="ambiguous"):
        R.rename_field(many, "name", "aisles.label")


def test_default(spark):
    df = R.add_default(load(spark, BOOKS), "aisles.racks.open", True)
    racks = [[r.get("open") for r in a["racks"]] for a in body(df)["aisles"]]
    assert racks == [[True, True], [], [False]]
    assert body(R.add_default(df, "aisles.checked", False))["aisles"][1]["checked"] is False


def test_replace_text(spark):
    df = load(spark, {"a": "foo bar", "b": [{"c": "foo"}], "n": 1}, "a string, b array<struct<c:string>>, n int")
    edits = spark.createDataFrame([("1", 0, "foo", "x"), ("1", 1, "x", "yy"), ("2", 0, "a", "b")], "id string, pos int, search string, replace string")
    assert body(R.replace_text(df, edits)) == {"a": "yy bar", "b": [{"c": "yy"}], "n": 1}
    none = spark.createDataFrame([("1", 0, "zzz", "x")], "id string, pos int, search string, replace string")
    assert R.replace_text(df, none).count() == 0
    two = df.withColumn("resource", F.explode(F.array(F.lit("p"), F.lit("q"))))
    one = edits.withColumn("resource", F.lit("q"))
    assert [r.resource for r in R.replace_text(two, one).collect()] == ["q"]


def test_paths_without_an_array_of_them_all(spark):
    """Every group of values by itself, without functions on arrays, against a walk over the records."""
    ddl = "id int, entry struct<a:int,l:array<struct<b:string,m:array<struct<c:int>>,n:array<array<int>>>>,o:struct<p:array<string>,q:int>>"
    records = [
        {"a": 1, "l": [{"b": "x", "m": [{"c": 1}, {"c": None}, None], "n": [[1, 2], [], None, [3]]}, None, {"b": None, "m": [], "n": None}], "o": {"p": ["s", None], "q": 5}},
        {"a": None, "l": [], "o": {"p": None, "q": None}},
        {"a": 2, "l": None, "o": None},
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], ddl)
    want, objects = [], []

    def walk(i, value, field, path, positions):
        if isinstance(value, dict):
            objects.append((i, path, "object"))
            for k, v in value.items():
                walk(i, v, f"{field}.{k}", f"{path}.{k}", positions)
        elif isinstance(value, list):
            objects.append((i, path, "array"))
            for k, v in enumerate(value):
                walk(i, v, field, f"{path}.{k}", (*positions, k))
        elif value is not None:
            want.append((i, path[1:], field[1:], positions, str(value), "string" if isinstance(value, str) else "int"))

    for i, r in enumerate(records):
        for k, v in r.items():
            walk(i, v, f".{k}", f".{k}", ())
    rows = R.flatten_paths(df, ["id"])
    assert sorted((r.id, r.path, r.field, tuple(r.positions), r.value, r.kind) for r in rows.collect()) == sorted(want)
    both = sorted((r.id, r.path, r.kind) for r in R.flatten_paths(df, ["id"], inner=True).collect())
    assert both == sorted([(i, p[1:], k) for i, p, k in objects] + [(w[0], w[1], w[5]) for w in want])
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
