import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import commands as C
from foliant.operators import diff as D
from foliant.operators import history as H

BODY = "struct<name:string,n:int,tags:array<string>>"
HIST = f"history_id long, entity_id string, version int, last_modified double, last_modified_by string, body {BODY}, status string, message string, op string, discarded boolean"
CMD = f"position long, cmdtype string, entity_id string, version long, body {BODY}, user string, message string, last_modified double"


def hist_row(hid, eid, ver, t, user, name, op="ADDED", dead=False):
    return (hid, eid, ver, float(t), user, (name, 1, ["x"]), "IN-PROGRESS", "", op, dead)


@pytest.fixture(scope="module")
def hist(spark):
    rows, hid = [], 0
    for i, (e, u) in enumerate([("a", "user1"), ("b", "user1"), ("c", "user2"), ("d", "user2")]):
        hid += 1
        rows.append(hist_row(hid, e, 1, i, u, e))
    for i, (e, u) in enumerate([("a", "user2"), ("b", "user2"), ("c", "user1"), ("d", "user1")]):
        hid += 1
        rows.append(hist_row(hid, e, 2, 10 + i, u, e * 2, "UPDATED"))
    for i in range(3, 10):
        hid += 1
        rows.append(hist_row(hid, "a", i, 20 + i, "user4", "a" * i, "UPDATED"))
    rows.append(hist_row(hid + 1, "d", 3, 50, "user1", "dd", "DELETED", True))
    return spark.createDataFrame(rows, HIST).cache()


def test_latest(hist):
    assert {(r.entity_id, r.version) for r in H.latest(hist).collect()} == {("a", 9), ("b", 2), ("c", 2)}
    assert [r.entity_id for r in H.latest(hist, since=12).collect()] == ["a"]
    assert [r.entity_id for r in H.deleted(hist).collect()] == ["d"]
    assert H.deleted(hist, since=50).count() == 0
    assert H.count_entries(hist).first().entries == 3
    assert H.max_modified(hist).first().last_modified == 50
    assert [r.entity_id for r in H.entity_ids(hist).collect()] == ["a", "c", "b"]


def test_as_of(hist, spark):
    a = spark.createDataFrame([("a",)], "entity_id string")

    def versions(**kw):
        return [r.version for r in H.as_of(hist, a, **kw).collect()]

    assert versions(version=4) == [4]
    assert versions(after=10.5) == [3]
    assert versions(before=10.5) == [2]
    assert versions(oldest=True) == [1]
    assert versions() == [9]
    assert versions(version=4, after=0) == [4]


def test_history(hist):
    page, total = H.history(hist, user="user2")
    assert total.first().total == 4
    assert [r.op for r in page.collect()] == ["UPDATED", "UPDATED", "ADDED", "ADDED"]
    assert H.history_filter(hist, entity="b").count() == 2
    assert H.history_filter(hist, entity="a", to_version=2).count() == 1
    assert H.history_filter(hist, entity="a", from_version=8, from_date=0.0).count() == 2
    assert H.history_filter(hist, from_date=10.0, to_date=13.0).count() == 4
    page, _ = H.history(hist, page=1, page_size=5)
    assert page.count() == 5


def test_diffs(hist, spark):
    a = spark.createDataFrame([("a",)], "entity_id string")

    def changes(**kw):
        row = D.version_diff(hist, a, **kw).first()
        return row.from_version, row.to_version, [tuple(c) for c in row["diff"]]

    assert changes(from_version=1, to_version=2) == (1, 2, [("CHANGE", "name", "a", "aa")])
    assert changes(from_date=0.0, to_date=100.0) == (1, 9, [("CHANGE", "name", "a", "a" * 9)])
    assert changes() == (1, 9, [("CHANGE", "name", "a", "a" * 9)])
    supplied = spark.createDataFrame([("a", ("q", None, ["x", "y"]))], f"entity_id string, body {BODY}")
    assert changes(from_version=1, supplied=supplied) == (
        1,
        None,
        [("CHANGE", "name", "a", "q"), ("REMOVED", "n", "1", None), ("ADDED", "tags[1]", None, "y")],
    )
    assert D.impossible_diffs(hist, a, to_version=77).count() == 1
    rows = D.history_diffs(hist).filter("entity_id = 'a'").orderBy("version").collect()
    assert {c.type for c in rows[0]["diff"]} == {"ADDED"}
    assert [tuple(c) for c in rows[3]["diff"]] == [("CHANGE", "name", "aaa", "aaaa")]
    page = D.history_page_diffs(hist, entity="a", to_version=2).collect()
    assert len(page) == 1 and {c.type for c in page[0]["diff"]} == {"ADDED"}


@pytest.mark.parametrize("width", [2, 3, 1 << 16])
def test_previous_over_chunks(hist, width):
    rows = H.with_previous(hist.filter("entity_id = 'a'"), ["version"], width).collect()
    assert sorted((r.version, r.previous_version) for r in rows) == [(1, None)] + [(v, v - 1) for v in range(2, 10)]
    numbered = H.with_versions(hist.withColumnRenamed("version", "v"), width=width)
    assert numbered.filter("v <> version").count() == 0 and numbered.count() == hist.count()


def sequential(base, commands):
    """The commands one after another, assuming that earlier ones were accepted."""
    state = {e: dict(v) for e, v in base.items()}
    made, conflicts = [], []
    for pos, kind, e, ver, body in commands:
        s = state.get(e)
        if kind == C.ADD:
            if s is not None:
                conflicts.append((pos, "exists"))
            else:
                made.append((pos, e, 1, body, "ADDED"))
            if s is None:
                state[e] = {"v": 1, "body": body, "dead": False}
            else:
                s["v"] += 1
                s["body"] = body
        elif s is None:
            conflicts.append((pos, "missing"))
            state[e] = None
            return made, conflicts
        elif kind == C.UPDATE:
            if s["dead"]:
                conflicts.append((pos, "discarded"))
            elif ver != s["v"]:
                conflicts.append((pos, "version"))
            if s["body"] != body:
                if not s["dead"] and ver == s["v"]:
                    made.append((pos, e, s["v"] + 1, body, "UPDATED"))
                s["v"] += 1
                s["body"] = body
        else:
            if s["dead"]:
                continue
            if ver != s["v"]:
                conflicts.append((pos, "version"))
            else:
                made.append((pos, e, s["v"] + 1, s["body"], "DELETED"))
            s["v"] += 1
            s["dead"] = True
        if conflicts:
            return made, conflicts
    return made, conflicts


def test_commands_against_sequential_twin(spark):
    rng = random.Random(5)
    hist_rows, cmd_rows, expected = [], [], {}
    pos = 0
    for trial in range(150):
        ids = [f"{trial}-{i}" for i in range(3)]
        base = {}
        for e in ids[:2]:
            v = rng.randint(1, 3)
            dead = rng.random() < 0.15
            for k in range(1, v + 1):
                hist_rows.append(hist_row(len(hist_rows), e, k, k, "u", f"b{k}", "ADDED", dead and k == v))
            base[e] = {"v": v, "body": f"b{v}", "dead": dead}
        track = {e: dict(s) for e, s in base.items()}
        batch = []
        for _ in range(rng.randint(1, 9)):
            e = rng.choice(ids)
            s = track.get(e)
            kind = C.ADD if s is None and rng.random() < 0.9 else rng.choice([C.UPDATE, C.UPDATE, C.UPDATE, C.DELETE])
            body = rng.choice(["b1", "b2", "x", "y"])
            ver = (s["v"] if s else 1) + (1 if rng.random() < 0.08 else 0)
            batch.append((pos, kind, e, ver, body))
            made, _ = sequential(base, batch)
            track = {e2: dict(s2) for e2, s2 in base.items()}
            for _, e2, v2, b2, op in made:
                track[e2] = {"v": v2, "body": b2, "dead": op == "DELETED"}
            pos += rng.randint(1, 3)
        expected[trial] = sequential(base, batch)
        for p, kind, e, ver, body in batch:
            cmd_rows.append((p, kind, e, ver, None if kind == C.DELETE else (body, 1, ["x"]), "u", "", 1.0))
    hist = spark.createDataFrame(hist_rows, HIST)
    cmds = spark.createDataFrame(cmd_rows, CMD)
    for width in (4, 1 << 20):
        rows, conflicts = C.apply_commands(hist, cmds, width)
        got_rows, got_conflicts = {}, {}
        for r in rows.collect():
            got_rows.setdefault(int(r.entity_id.split("-")[0]), []).append((r.position, r.entity_id, r.version, r.body.name, r.op))
        for r in conflicts.collect():
            got_conflicts.setdefault(int(r.entity_id.split("-")[0]), []).append((r.position, r.conflict))
        clean = 0
        for trial, (made, conf) in expected.items():
            found = sorted(got_conflicts.get(trial, []))
            assert found[:1] == conf[:1], (trial, conf, found)
            if not conf:
                clean += 1
                assert sorted(got_rows.get(trial, [])) == made
        assert clean > 20


def test_idempotent_add(spark, hist):
    rows = spark.createDataFrame(
        [(0, "new", ("n", 1, [])), (1, "new", ("n", 1, [])), (2, "new", ("m", 1, [])), (3, "b", ("bb", 1, ["x"])), (4, "c", ("zz", 1, ["x"]))],
        f"position long, entity_id string, body {BODY}",
    )
    v1 = hist.filter("version = 1")
    add, conflicts = C.add_entries(v1, rows)
    assert [r.position for r in add.collect()] == [0]
    assert sorted(r.position for r in conflicts.collect()) == [2, 3, 4]
    again = spark.createDataFrame([(0, "b", ("b", 1, ["x"]))], f"position long, entity_id string, body {BODY}")
    add, conflicts = C.add_entries(v1, again)
    assert add.count() == 0 and conflicts.count() == 0
    add, conflicts = C.add_entries(hist, again)
    assert conflicts.count() == 1
    assert H.check_unique(hist).count() == 0
    assert H.check_unique(hist.union(hist.limit(1))).count() == 1
    assert F is not None
