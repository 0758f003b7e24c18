import json
import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import ids, rest
from foliant.operators import diff as X
from foliant.operators import lookups as L
from foliant.operators import validate as V
from foliant.operators.commands import apply_commands
from foliant.operators.history import latest
from foliant.plans.spec import Spec
from foliant.queries.tables import order_rows
from foliant.session import new_folder
from foliant.sources import catalog as C
from foliant.sources import entries as E
from foliant.sources import snapshots as S
from foliant.streaming import sync as ST

SPEC = Spec.from_dict(
    {
        "resource_id": "things",
        "fields": {
            "name": {"type": "string", "required": True},
            "n": {"type": "integer"},
            "x": {"type": "number"},
            "flag": {"type": "boolean"},
            "tags": {"type": "string", "collection": True},
            "rows": {"type": "object", "collection": True, "fields": {"k": {"type": "integer", "required": True}, "m": {"type": "string"}}},
            "obj": {"type": "object", "fields": {"a": {"type": "string", "required": True}}},
            "_copy": {"virtual": True, "plugin": "copy", "params": {"config": {"type": "integer"}}, "field_params": {"value": "n"}},
        },
        "additional_properties": False,
    }
)


def test_validation(spark):
    cases = {
        '{"name":"a","n":1,"x":1,"flag":true,"tags":["q"],"rows":[{"k":1}],"obj":{"a":"z"}}': [],
        '{"name":"a","n":1.0,"x":1.5}': [],
        '{"n":1}': ["name is required"],
        '{"name":null}': ["name must be string"],
        '{"name":1}': ["name must be string"],
        '{"name":"a","n":1.5}': ["n must be integer"],
        '{"name":"a","n":"1"}': ["n must be integer"],
        '{"name":"a","flag":"true"}': ["flag must be boolean"],
        '{"name":"a","tags":"q"}': ["tags must be array"],
        '{"name":"a","tags":["q",1]}': ["tags[] must be string"],
        '{"name":"a","rows":[{"k":1},{"m":"x"},3]}': ["rows[].k is required", "rows[] must be object"],
        '{"name":"a","obj":{}}': ["obj.a is required"],
        '{"name":"a","obj":[]}': ["obj must be object"],
        '{"name":"a","_copy":1}': ["_copy must not be given"],
        '{"name":"a","other":1}': ["other is not declared"],
        "[1]": ["record must be object"],
        "{": ["not valid JSON"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.problems for r in V.check(df, SPEC).collect()}
    assert got == cases
    ok, bad = V.validate(df, SPEC)
    assert ok.count() == 2 and V.error_count(bad).first().errors == len(cases) - 2
    env = spark.createDataFrame([('{"cmdtype":"delete_entry","id":"1"}',), ('{"entry":{"name":"a"}}',), ('{"entry":{}}',)], "raw string")
    ok, bad = V.validate(env, SPEC, as_import=True)
    assert ok.count() == 1 and bad.count() == 1


def test_ids(spark):
    rows = spark.createDataFrame([(1.0,), (1000.5,), (1700000000.25,)], "t double")
    made = [r.id for r in ids.with_ulid(rows, F.col("t"), [F.col("t")]).collect()]
    assert [len(i) for i in made] == [26] * 3 and made == sorted(made)
    assert made[0].startswith("00000000Z8") and set("".join(made)) <= set("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    assert made == [r.id for r in ids.with_ulid(rows, F.col("t"), [F.col("t")]).collect()]
    loose = [r.id for r in ids.with_ulid(spark.range(100).select(F.col("id").alias("n"))).collect()]
    assert len(set(loose)) == 100


def write_lines(spark, lines):
    folder = new_folder(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    return folder


def test_reading(spark):
    folder = write_lines(spark, ['{"name":"a","n":1,"zz":{"q":1}}', "{broken", '{"name":"b"}'])
    rows = E.read_entries(spark, folder, SPEC).withColumn("extra", F.to_json("extra")).orderBy("position").collect()
    assert [r.entry and r.entry.name for r in rows] == ["a", None, "b"]
    assert json.loads(rows[0].extra) == {"zz": {"q": 1}} and rows[2].extra is None
    whole = write_lines(spark, ['[{"name":"a"},{"name":"b","n":2}]'])
    assert [r.entry.name for r in E.read_entries(spark, whole, SPEC, array=True).orderBy("position").collect()] == ["a", "b"]
    env = write_lines(spark, ['{"id":"E1","last_modified":5.5,"user":"u","message":"m","entry":{"name":"a"}}', '{"entry":{"name":"b"}}'])
    first, second = E.read_import(spark, env, SPEC, "job", "msg").orderBy("position").collect()
    assert (first.entity_id, first.last_modified, first.user, first.message, first.body.name) == ("E1", 5.5, "u", "m", "a")
    assert len(second.entity_id) == 26 and (second.user, second.message) == ("job", "msg")


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as file:
        file.write(text)
    return f"{folder}/{name}"


def test_arrays_over_splits(spark, tmp_path):
    rng = random.Random(8)
    texts = ["}", "{", "]},{", 'a"b', "\\", "\\\\}", "ä]", "", "x" * 300]
    made = lambda depth: {rng.choice("abc") + str(i): rng.choice(texts) if depth == 0 or rng.random() < 0.5 else [made(depth - 1), rng.choice(texts), None] for i in range(rng.randrange(4))}
    files = {}
    for name, n, indent in (("one", 300, None), ("two", 200, 2), ("none", 0, None), ("long", 3, None)):
        rows = [{"file": name, "i": i, **made(2)} for i in range(n)]
        if name == "long":
            rows[1]["a"] = "}," * 9000  # one record over many splits
            rows[0]["a"] = ["[{"] * 3000
        files[name] = rows
        _write(str(tmp_path), name, json.dumps(rows, indent=indent, ensure_ascii=name == "two"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "1000", "277"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = [json.loads(r.raw) for r in E.read_raw_array(spark, str(tmp_path)).orderBy("position").collect()]
        for name, rows in files.items():
            assert [r for r in read if r["file"] == name] == rows
        assert len(read) == 503
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    "text, whole, faults",
    [
        ('[{"a":1},{"a":2},', 2, 1),
        ('[{"a":1},{"a":2', 1, 1),
        ('[{"a":1},{"a":2}', 2, 1),
        ('[{"a":1},{"a":{"b":2}', 1, 1),
        ('[{"a":1}] more', 1, 1),
        ('[{"a":1},"x',1, 1),
        ('[{"a":1}]\n', 1, 0),
        (' [ ] ', 0, 0),
        ('[{"a":1}, 7, {"a":2}]', 1, 1),
        ('[[{"a":1}], {"a":2}]', 0, 1),
        ('{"a":1}', 0, 1),
    ],
)
def test_broken_arrays(spark, tmp_path, text, whole, faults):
    path = _write(str(tmp_path), "broken.json", text)
    rows = E.read_entries(spark, path, Spec.from_dict({"resource_id": "things", "fields": {"a": {"type": "integer"}}}), array=True)
    good, bad = V.validate(rows, Spec.from_dict({"resource_id": "things", "fields": {"a": {"type": "integer"}}}))
    assert (good.count(), bad.count()) == (whole, faults)


EVERY = [
    {"name": "a", "u": {"b": 2, "c": [1, None]}, "z": None},
    {"name": "b", "n": None, "rows": [{"k": 1, "note": "n"}, {"k": 2}]},
    {"name": "c", "obj": {"a": "z", "more": {"p": [1, {"q": None}]}}},
    {"name": "d", "tags": ["x", None], "flag": True},
    {"name": "e", "rows": [], "obj": {"a": "y"}},
]
OPEN = Spec.from_dict({**{"resource_id": "things"}, "fields": {"name": {"type": "string"}, "n": {"type": "integer"}, "flag": {"type": "boolean"}, "tags": {"type": "string", "collection": True}, "rows": {"type": "object", "collection": True, "fields": {"k": {"type": "integer"}}}, "obj": {"type": "object", "fields": {"a": {"type": "string"}}}, "_copy": {"virtual": True, "plugin": "copy", "params": {"config": {"type": "string"}}, "field_params": {"value": "name"}}}})


def test_every_member_is_kept(spark):
    """Import, history, update, difference, export and back."""
    folder = write_lines(spark, [json.dumps({"id": f"E{i}", "last_modified": float(i), "user": "u", "message": "m", "entry": r}) for i, r in enumerate(EVERY)])
    path, out = new_folder(spark, "hist"), new_folder(spark, "export")
    rows = [json.loads(r) for r, in E.read_import(spark, folder, OPEN, "job").select("raw").collect()]
    assert sorted(r["name"] for r in rows) == list("abcde")
    good = E.read_import(spark, folder, OPEN, "job").drop("body", "extra")
    # nulls of declared members are no valid values
    valid = {r["name"]: r for r in EVERY if r["name"] not in "bd"}
    E.bulk_add(spark, path, good.filter(~F.get_json_object("raw", "$.name").isin("b", "d")), OPEN, "job")
    hist = E.read_history(spark, path, OPEN.body_type())
    E.export(hist, OPEN, out, entry_only=True)
    assert {r["name"]: r for r in (json.loads(x.value) for x in spark.read.text(out).collect())} == valid
    expanded = new_folder(spark, "expanded")
    E.export(hist, OPEN, expanded, expand=True)
    assert {r["entry"]["name"]: r["entry"] for r in (json.loads(x.value) for x in spark.read.text(expanded).collect())} == {n: {**r, "_copy": n} for n, r in valid.items()}
    for r in EVERY:
        row = spark.createDataFrame([(json.dumps(r),)], "raw string").select(E.body_of(F.col("raw"), OPEN).alias("b"), rest.rest_of(F.col("raw"), OPEN).alias("r"))
        assert json.loads(row.select(F.to_json(rest.merged(F.col("b"), F.col("r"), OPEN))).first()[0]) == r
    # a change of undeclared members alone is a new version, and the same record is none
    changed = {"name": "a", "u": {"b": 3, "c": [1]}, "w": "new"}
    sent = spark.createDataFrame([(1, "update_entry", "E0", 1, json.dumps(changed)), (2, "update_entry", "E0", 2, json.dumps(changed)), (3, "update_entry", "E2", 1, json.dumps(EVERY[2])), (4, "delete_entry", "E4", 1, None)], "position long, cmdtype string, entity_id string, version long, raw string")
    commands = sent.select("position", "cmdtype", "entity_id", "version", E.body_of(F.col("raw"), OPEN).alias("body"), rest.rest_of(F.col("raw"), OPEN).alias("extra"), F.lit("v").alias("user"), F.lit("").alias("message"), (F.lit(100.0) + F.col("position")).alias("last_modified"))
    made, conflicts = apply_commands(hist, commands)
    assert conflicts.count() == 0
    E.append_history(spark, path, made, OPEN.body_type())
    hist = E.read_history(spark, path, OPEN.body_type())
    assert sorted((r.entity_id, r.version, r.op) for r in hist.filter("last_modified > 50").collect()) == [("E0", 2, "UPDATED"), ("E4", 2, "DELETED")]
    diffs = {(c.type, c.field, c.before, c.after) for c in X.explode_changes(X.history_diffs(hist).filter("entity_id = 'E0' and version = 2"), ["entity_id"]).collect()}
    wanted = {("CHANGE", "u.b", "2", "3"), ("REMOVED", "u.c[1]", "null", None), ("REMOVED", "z", "null", None), ("ADDED", "w", None, "new")}
    assert diffs == wanted
    assert {(c.type, c.field, c.before, c.after) for c in X.explode_changes(X.version_diff(hist).filter("entity_id = 'E0'"), ["entity_id"]).collect()} == wanted
    again = new_folder(spark, "again")
    E.export(hist, OPEN, again, entry_only=True)
    assert {r["name"]: r for r in (json.loads(x.value) for x in spark.read.text(again).collect())} == {"a": changed, "c": EVERY[2]}


def test_chunked_add(spark):
    raws = [json.dumps({"name": f"n{i}"}) for i in range(12)]
    for broken, kept in ((0, 0), (1, 1), (5, 1), (6, 6), (9, 6), (None, 12)):
        path = new_folder(spark, "hist")
        rows = [(i * 10, "{}" if i == broken else raw) for i, raw in enumerate(raws)]
        _, bad = E.bulk_add(spark, path, spark.createDataFrame(rows, "position long, raw string"), SPEC, "me", chunk=5)
        assert bad.count() == (broken is not None)
        assert E.read_history(spark, path, SPEC.body_type()).count() == kept


def test_append_and_export(spark):
    path = new_folder(spark, "hist")
    raw = spark.createDataFrame([(i, json.dumps({"name": f"n{i}", "n": i})) for i in range(50)], "position long, raw string")
    made, bad = E.bulk_add(spark, path, raw, SPEC, "me")
    assert made.count() == 50 and bad.count() == 0
    hist = E.read_history(spark, path, SPEC.body_type())
    assert sorted(r.history_id for r in hist.collect()) == list(range(50))
    assert hist.filter("version = 1 and op = 'ADDED' and message = 'Entry added.'").count() == 50
    none, bad = E.bulk_add(spark, path, raw.withColumn("raw", F.when(F.col("position") == 3, "{}").otherwise(F.col("raw"))), SPEC, "me")
    assert bad.count() == 1 and E.read_history(spark, path, SPEC.body_type()).count() == 50
    out = new_folder(spark, "export")
    E.export(hist, SPEC, out, expand=True, entry_only=True)
    assert spark.read.schema("name string, n long, _copy long").json(out).filter("_copy = n").count() == 50
    indexed = E.dense_index(spark.range(1000).withColumn("r", F.xxhash64("id")), ["r"], "i")
    assert [r.i for r in indexed.orderBy("r").collect()] == list(range(1000))


CAT = [
    (1, "e1", "places", 1, "P", "t", '{"protected":{"read":true}}', False, 1.0, "u", "", "ADDED", False),
    (2, "e1", "places", 2, "P", "t", '{"protected":{"read":true}}', True, 2.0, "u", "", "UPDATED", False),
    (3, "e2", "plants", 1, "Q", "t", '{"protected":{"write":true}}', True, 3.0, "u", "", "ADDED", False),
    (4, "e3", "words", 1, "W", "t", "{}", True, 4.0, "u", "", "ADDED", False),
    (5, "e4", "drafts", 1, "D", "t", "{}", False, 5.0, "u", "", "ADDED", False),
]


def test_catalog(spark):
    cat = spark.createDataFrame(CAT, C.RESOURCE_TYPE)
    names = lambda df: sorted(r.resource_id for r in df.collect())
    assert names(C.list_resources(cat)) == ["places", "plants", "words"]
    assert names(C.list_resources(cat, published=False)) == ["drafts", "places", "plants", "words"]
    assert names(C.list_resources(cat, globs=["p*s", "w?rds"])) == ["places", "plants", "words"]
    assert names(C.list_resources(cat, globs=["pl?nts"])) == ["plants"]
    assert C.show_resource(cat, "places").first().version == 2 and C.show_resource(cat, "places", 1).first().is_published is False
    assert {r.resource_id: r.protected for r in L.protection(cat).collect()} == {"places": "READ", "plants": "WRITE", "words": None}
    ids = ("places", "plants", "words", "drafts", "unknown")
    asked = spark.createDataFrame([(u, r) for u in ("ann", "bob") for r in ids], "user string, resource_id string")
    grants = spark.createDataFrame([("ann", "places", 1), ("ann", "words", 3), ("bob", "plants", 2)], "user string, resource_id string, level int")
    may = lambda lv: {(r.user, r.resource_id) for r in L.permitted(asked, grants, cat, lv).collect()}
    assert may("WRITE") == {("ann", "words"), ("bob", "plants")} and may("ADMIN") == {("ann", "words")}
    assert may("READ") == {(u, r) for u in ("ann", "bob") for r in ("plants", "words", "drafts")} | {("ann", "places")}
    df = spark.createDataFrame([("places", 1), ("drafts", 2), ("words", 3)], "resource string, n int")
    assert sorted(r.n for r in L.published(df, cat).collect()) == [1, 3]
    assert sorted(r.n for r in L.permitted_entries(df, grants, cat, "bob").collect()) == [2, 3]
    change = [
        ("new", "create", None, "{}"), ("words", "create", None, "{}"), ("places", "update", 2, '{"a":1}'), ("plants", "update", 9, '{"a":1}'),
        ("drafts", "unpublish", 7, None), ("nope", "publish", None, None),
    ]
    changes = spark.createDataFrame([(*c, None, "me", None, 9.0) for c in change], "resource_id string, change string, version int, config string, name string, user string, message string, last_modified double")
    rows, errors, gone = C.resource_changes(cat, changes)
    assert {(r.resource_id, r.version, r.message, r.is_published) for r in rows.collect()} == {("new", 1, "Resource 'new' created.", False), ("places", 3, "updating", True)}
    assert {(r.resource_id, r.error) for r in errors.collect()} == {("words", "exists"), ("plants", "version"), ("nope", "missing")}
    drop = spark.createDataFrame([("places", "delete", None, None, None, None, None, 9.0)], changes.schema)
    _, _, gone = C.resource_changes(cat, drop)
    assert C.forget(cat, gone).filter("resource_id = 'places'").count() == 0


BODY = SPEC.body_type()


def body(i):
    return json.dumps({"name": f"n{i}", "n": i})


def commands(spark, rows, start=0):
    raw = spark.createDataFrame([(start + i, *r) for i, r in enumerate(rows)], "position long, cmdtype string, entity_id string, version long, b string")
    return raw.select(
        "position", "cmdtype", "entity_id", "version", F.from_json("b", BODY).alias("body"), F.lit("u").alias("user"), F.lit("").alias("message"),
        (F.col("position") + 100.0).alias("last_modified"),
    )


def state(df):
    return {r.id: r.entry.n for r in df.collect()}


def test_snapshots(spark):
    path, root = new_folder(spark, "hist"), new_folder(spark, "snaps")
    empty = spark.createDataFrame([], ST.history_type(BODY))
    rows, bad = apply_commands(empty, commands(spark, [("add_entry", f"e{i}", None, body(i)) for i in range(40)]))
    assert bad.count() == 0
    E.append_history(spark, path, rows, BODY)
    hist = E.read_history(spark, path, BODY)
    first = S.publish_snapshot(spark, hist, SPEC, root, buckets=8)
    snap = S.read_snapshot(spark, root, "things")
    assert state(snap) == {f"e{i}": i for i in range(40)} and snap.filter("entry._copy = entry.n").count() == 40
    more = [("update_entry", "e1", 1, body(100)), ("delete_entry", "e2", 1, None), ("add_entry", "f1", None, body(7)), ("delete_entry", "f1", 1, None)]
    rows, bad = apply_commands(hist, commands(spark, more, 1000))
    assert bad.count() == 0
    E.append_history(spark, path, rows, BODY)
    hist = E.read_history(spark, path, BODY)
    assert 1 <= S.sync_snapshot(spark, hist, SPEC, root) <= 3
    expected = {r.entity_id: r.body.n for r in latest(hist).collect()}
    assert state(S.read_snapshot(spark, root, "things")) == expected and expected["e1"] == 100
    assert S.sync_snapshot(spark, hist, SPEC, root) == 0
    # a change with an older time, and an entity whose bucket has nothing left
    rows, bad = apply_commands(hist, commands(spark, [("update_entry", "e3", 1, body(300))], -5000))
    E.append_history(spark, path, rows, BODY)
    hist = E.read_history(spark, path, BODY)
    second = S.publish_snapshot(spark, hist.filter("history_id < 45"), SPEC, root, buckets=100)
    S.sync_snapshot(spark, hist, SPEC, root)
    expected = {r.entity_id: r.body.n for r in latest(hist).collect()}
    assert state(S.read_snapshot(spark, root, "things")) == expected and expected["e3"] == 300
    rows, bad = apply_commands(hist, commands(spark, [("delete_entry", f"e{i}", 1, None) for i in range(10, 30)], 2000))
    E.append_history(spark, path, rows, BODY)
    hist = E.read_history(spark, path, BODY)
    assert S.sync_snapshot(spark, hist, SPEC, root) > 10
    expected = {r.entity_id: r.body.n for r in latest(hist).collect()}
    assert state(S.read_snapshot(spark, root, "things")) == expected and len(expected) == 19
    listed = S.list_snapshots(spark, root, ["things", "absent"]).collect()
    assert sorted((r.resource, r.name, r.current, (r.size or 0) > 0) for r in listed) == [("absent", "missing", False, False), ("things", first, False, True), ("things", second, True, True)]
    S.set_current(spark, root, "things", first)
    assert state(S.read_snapshot(spark, root, "things"))["e3"] == 3
    wanted = spark.createDataFrame([("e3",)], "id string")
    assert S.refresh(spark, hist, SPEC, root, wanted) == 1
    assert state(S.read_snapshot(spark, root, "things"))["e3"] == 300
    S.publish_snapshot(spark, hist, SPEC, root, drop_old=True, buckets=4)
    assert state(S.read_snapshot(spark, root, "things")) == expected
    with pytest.raises(ValueError):
        S.set_current(spark, root, "things", first)
    S.set_current(spark, root, "things", second)
    S.drop_snapshots(spark, root, "things")
    S.drop_snapshots(spark, root, "things")
    assert S.current_snapshot(spark, root, "things") is None
    assert len([r.name for r in S.list_snapshots(spark, root, ["things"]).collect()]) == 1


def test_streams(spark):
    cmd, hist_path, bad_path, root, mirror = (new_folder(spark, n) for n in ("cmd", "hist", "bad", "snaps", "mirror"))
    rng = random.Random(1)
    first = [("add_entry", f"e{i}", None, body(i)) for i in range(20)]
    commands(spark, first).coalesce(1).write.mode("append").json(cmd)
    run = lambda: ST.stream_commands(spark, cmd, hist_path, bad_path, BODY, f"{root}-cp").awaitTermination()
    run()
    second = [("update_entry", f"e{i}", 1, body(i + rng.randint(1, 9))) for i in range(5)] + [("delete_entry", "e9", 1, None)]
    commands(spark, second, 100).coalesce(1).write.mode("append").json(cmd)
    run()
    commands(spark, [("update_entry", "e0", 1, body(1))], 200).coalesce(1).write.mode("append").json(cmd)
    run()
    hist = ST.read_stream_history(spark, hist_path, BODY)
    assert hist.count() == 26 and spark.read.parquet(bad_path).count() == 1
    assert sorted(r.history_id for r in hist.collect()) == list(range(26))
    empty = spark.createDataFrame([], ST.history_type(BODY))
    S.publish_snapshot(spark, empty, SPEC, mirror, buckets=4)
    ST.stream_sync(spark, hist_path, SPEC, mirror, f"{mirror}-cp").awaitTermination()
    assert state(S.read_snapshot(spark, mirror, "things")) == {r.entity_id: r.body.n for r in latest(hist).collect()}


def test_stream_of_commands_with_times_that_go_back(spark):
    cmd, plain, numbered, bad_path = (new_folder(spark, n) for n in ("cmd", "hist", "numbered", "bad"))
    made = commands(spark, [("add_entry", "a", None, body(0)), ("update_entry", "a", 1, body(1)), ("update_entry", "a", 2, body(2))], 10)
    for half in (F.col("position") < 12, F.col("position") >= 12):
        made.filter(half).withColumn("last_modified", 1000.0 - F.col("position")).coalesce(1).write.mode("append").json(cmd)
        ST.stream_commands(spark, cmd, plain, bad_path, BODY, f"{plain}-cp").awaitTermination()
        ST.stream_commands(spark, cmd, numbered, bad_path, BODY, f"{numbered}-cp", numbered=True).awaitTermination()
    seen = lambda path: sorted((r.history_id, r.version, r.body.n) for r in ST.read_stream_history(spark, path, BODY).collect())
    assert seen(plain) == [(0, 1, 0), (1, 2, 1), (2, 3, 2)]
    assert seen(numbered) == [(10, 1, 0), (11, 2, 1), (12, 3, 2)]


class _Unset:
    """A session on one machine, or on a cluster, without a shared folder."""

    def __init__(self, master):
        self.sparkContext = self
        self.master, self.applicationId = master, "app-" + master
        self.conf = self

    def getConf(self):
        return self

    def get(self, *_args):
        return None


def test_work_folder():
    from foliant.session import work_dir

    own = work_dir(_Unset("local[2]"))
    assert own and own == work_dir(_Unset("local[2]"))
    with pytest.raises(RuntimeError):
        work_dir(_Unset("yarn"))


def test_whole_objects_are_settled_by_their_shape(spark):
    """What a shape settles is what looking into every member gives, and it settles objects without undeclared members."""
    rows = [
        {"rows": [{"k": 1}, {"k": 2}, {}], "obj": {"a": "z"}},
        {"rows": [{"k": 1}, {"k": "2"}]}, {"rows": [{"k": 1}, {"k": 1.5}]}, {"rows": [{"k": 1}, {"k": 1.0}]}, {"rows": [{"k": 1, "l": 2}]},
        {"rows": [{"k": None}, {"k": 3}]}, {"rows": [None, {"k": 3}]}, {"rows": [1, {"k": 3}]}, {"rows": [{"k": 1}, {"k": [1]}]}, {"rows": {"k": 1}},
        {"rows": [{"k: BIGINT, k": 1}]}, {"obj": {"a": "null"}}, {"obj": {"a": 1}}, {"obj": {}}, {"obj": []}, {"obj": {"a": {"a": "x"}}}, {"rows": []}, {"note": "x", "rows": [{"k": 2}]},
    ]
    raw, f = F.col("raw"), OPEN.fields["rows"]
    text = lambda m: F.to_json(F.to_variant_object(m))
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")
    slow = text(rest._rest(F.try_parse_json(raw), OPEN.fields, F.lit(False)))
    got = df.select(F.to_json(rest.rest_of(raw, OPEN)).alias("fast"), slow.alias("slow")).collect()
    assert all(r.fast == r.slow for r in got)
    shape = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.rows", "variant"))
    settled = df.select(F.rlike(shape, F.lit(rf"\A{rest._shape(f)}\z")).alias("s")).collect()
    assert [r.s for r in settled[:5]] == [True, False, False, False, False]
    assert settled[-1].s and settled[-2].s


def test_lines_are_gathered_in_the_order_of_the_join(spark):
    """No hash map of arrays, which is sorted when it is full, and one sort of the lines."""
    plan = order_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("SortAggregate") == 1
    assert plan.count("+- Sort [") + plan.count(":- Sort [") == 2
