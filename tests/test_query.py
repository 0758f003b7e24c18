import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import collections as K
from foliant.operators import derive as D
from foliant.operators import lookups as L
from foliant.operators import predicates as P
from foliant.operators import query as Q
from foliant.operators import stats as S
from foliant.plans.spec import Field, IncompatibleFields, SortError, Spec, SpecError, UnknownField
from tests import data

TOOLS = Spec.from_dict(data.TOOLS_SPEC)
MAKERS = Spec.from_dict(data.MAKERS_SPEC)


@pytest.fixture(scope="module")
def tools(spark):
    return data.entries(spark, data.TOOLS, TOOLS, "key").cache()


@pytest.fixture(scope="module")
def makers(spark):
    return data.entries(spark, data.MAKERS, MAKERS, "key").cache()


def found(df, predicate, spec=TOOLS):
    return sorted(r.id for r in P.matching(df, predicate, spec).collect())


def codes(df, predicate, spec):
    return [int(i) for i in found(df, predicate, spec)]


def having(test, records=data.TOOLS):
    """The keys of the records that a plain test holds for."""
    return sorted(r["key"] for r in records if test(r))


def jobs(r):
    return r.get("jobs") or []


def test_words(spark):
    def words(s):
        return spark.range(1).select(text.analyze(F.lit(s)).alias("w")).first().w

    assert words("Hej-då, Ångström's ÉÊ 3.14") == ["hejdå", "ångström's", "ee", "3.14"]
    assert words("naïve Straße Œuvre Ǻ æ øl") == ["naive", "strasse", "öuvre", "å", "ä", "öl"]
    assert words("å é 日本 foo_bar (x) www.a.b") == ["å", "e", "日", "本", "foo_bar", "x", "www.a.b"]
    assert words("  ") == []


def test_leaf_predicates(tools):
    everyone = having(lambda r: True)
    assert found(tools, P.equals("label", "mallet")) == ["mallet"]
    assert found(tools, P.equals("label", "BENCH vice")) == ["vice"] and found(tools, P.equals("label", "vice bench")) == []
    assert found(tools, P.equals("label", "handdrill")) == ["drill"] and found(tools, P.equals("label", "...")) == []
    assert found(tools, P.contains("label", "L")) == having(lambda r: any("l" in w for w in r["label"].lower().split()))
    assert found(tools, P.contains("label", "e s")) == []
    assert found(tools, P.regexp("label", "[FB].*")) == ["plane", "rule", "saw", "vice"]
    assert found(tools, P.regexp("label", r"\D+")) == everyone and found(tools, P.regexp("label", r"\d+")) == ["drill"]
    assert found(tools, P.regexp("label", r"\p{Lu}.*")) == everyone  # case does not matter
    assert found(tools, P.startswith("label", "RUL")) == ["rule"] and found(tools, P.endswith("label", "ng")) == ["rule"]
    assert found(tools, P.contains("label", r"L\Sn", regex=True)) == ["plane"]
    assert found(tools, P.gt("label", "rule")) == having(lambda r: any(w > "rule" for w in ("saw", "vice", "ångström") if w in r["label"].lower()))
    assert found(tools, P.equals("made.by", "holm")) == having(lambda r: r.get("made", {}).get("by") == "holm")
    assert found(tools, P.startswith("made.by", "ö")) == ["rule", "vice"]
    assert found(tools, P.gte("weight", 0.75)) == having(lambda r: r.get("weight", 0) >= 0.75)
    assert found(tools, P.lt("made.year", 2003)) == having(lambda r: r.get("made", {}).get("year", 9999) < 2003)
    assert found(tools, P.equals("lent", False)) == having(lambda r: r.get("lent") is False)
    assert found(tools, P.exists("made.year")) == having(lambda r: "year" in r.get("made", {}))
    assert found(tools, P.missing("made")) == ["mallet"] and found(tools, P.missing("lent")) == having(lambda r: "lent" not in r)
    assert found(tools, P.equals("jobs.along", "vice")) == having(lambda r: any("vice" in j.get("along", []) for j in jobs(r)))
    assert found(tools, P.gt("jobs.hours", 0.4)) == having(lambda r: any(j.get("hours", 0) > 0.4 for j in jobs(r)))
    assert found(tools, P.equals(P.meta("id"), "saw")) == ["saw"] and found(tools, P.gte(P.meta("version"), 2)) == []
    with pytest.raises(SpecError):
        found(tools, P.regexp("weight", "1"))
    with pytest.raises(UnknownField):
        found(tools, P.equals("nothing", 1))


def test_combinations(tools):
    everyone = having(lambda r: True)
    heavy = lambda r: r.get("weight", 0) > 0.5
    assert found(tools, None) == everyone and found(tools, P.and_()) == everyone and found(tools, P.or_()) == []
    assert found(tools, P.and_(P.equals("made.by", "holm"), P.gt("weight", 0.5))) == ["plane"]
    assert found(tools, P.not_(P.gt("weight", 0.5))) == having(lambda r: not heavy(r))
    assert found(tools, P.not_(P.gt("weight", 0.5), P.equals("label", "gauge"))) == having(lambda r: not heavy(r) and r["key"] != "gauge")
    assert found(tools, P.not_(P.not_(P.gt("weight", 0.5)))) == having(heavy)
    assert found(tools, P.or_(P.equals("label", "mallet"), P.equals("jobs.what", "bore"))) == ["drill", "mallet"]
    one_job = P.sub("jobs", P.and_(P.equals("what", "trim"), P.gt("hours", 0.75)))
    assert found(tools, one_job) == having(lambda r: any("Trim" in j["what"] and j.get("hours", 0) > 0.75 for j in jobs(r)))
    assert found(tools, P.freetext("JOINTS")) == ["gauge", "saw"] and found(tools, P.freetext("2003")) == ["drill", "gauge"]
    assert found(tools, P.freetext("user1")) == everyone
    with pytest.raises(SpecError):
        P.not_()


NESTED = Spec.from_dict(
    {
        "resource_id": "forms",
        "fields": {
            "code": {"type": "integer"},
            "infT": {"type": "object", "collection": True, "fields": {"wf": {"type": "string"}, "msd": {"type": "string"}, "variant": {"type": "boolean"}}},
            "t1": {"type": "object", "fields": {"infT": {"type": "object", "collection": True, "fields": {"wf": {"type": "string"}}}}},
        },
        "sort": "code",
    }
)


def test_same_element_and_any_element(spark):
    rows = [
        {"code": 1, "infT": [{"wf": "a", "msd": "s"}, {"wf": "b", "msd": "t"}], "t1": {"infT": [{"wf": "word"}]}},
        {"code": 2, "infT": [{"wf": "a", "msd": "t"}, {"wf": "b", "msd": "s", "variant": True}]},
        {"code": 3},
    ]
    df = data.entries(spark, rows, NESTED)
    both = P.and_(P.equals("wf", "a"), P.equals("msd", "s"))
    assert codes(df, P.sub("infT", both), NESTED) == [1]
    assert codes(df, P.and_(P.equals("infT.wf", "a"), P.equals("infT.msd", "s")), NESTED) == [1, 2]
    forms = [P.equals("t1.infT.wf", "word"), P.sub("t1", P.equals("infT.wf", "word")), P.sub("t1", P.sub("infT", P.equals("wf", "word"))), P.sub("t1.infT", P.equals("wf", "word"))]
    assert [codes(df, f, NESTED) for f in forms] == [[1]] * 4
    assert codes(df, P.sub("infT", P.freetext("true")), NESTED) == [2]
    assert codes(df, P.missing("infT.variant"), NESTED) == [1, 3]
    assert codes(df, P.sub("infT", P.missing("variant")), NESTED) == [1, 2]
    assert codes(df, P.exists("t1"), NESTED) == [1]
    assert P.sub("a", P.and_(P.equals("b", 1), P.exists("c"))).paths() == {"a.b", "a.c"}


def test_sort_and_pages(tools, makers):
    names = [r.value for r in Q.query(tools, TOOLS, size=None, path="entry.label").hits.collect()]
    assert names == ["Bench vice", "Block plane", "Fine saw", "Folding rule", "Hand-drill 40", "Mallet", "Ångström gauge"]
    some = Q.query(tools, TOOLS, P.lt("weight", 5), sort=["weight|desc", "label"], from_=1, size=2)
    assert [r.id for r in some.hits.collect()] == ["plane", "mallet"]
    assert some.total.first().total == 4 and [tuple(r) for r in some.distribution.collect()] == [("tools", 4)]
    falling = Q.query(tools, TOOLS, sort=["made.year|desc"], size=None).hits.collect()
    assert sorted(r.id for r in falling[-3:]) == having(lambda r: "year" not in r.get("made", {}))
    longest = Q.query(tools, TOOLS, sort=["jobs.hours|desc"], size=2).hits.collect()
    assert [r.id for r in longest] == ["saw", "plane"]
    assert Q.query(tools, TOOLS, size=0).hits.count() == 0
    values = [r.value for r in Q.query(tools, TOOLS, path="entry.jobs.along").hits.collect()]
    assert [["vice", "plane"], None] in values and [] in values
    both = K.union_collections([(tools, TOOLS), (makers, MAKERS)])
    stats = {r.resource: r["count"] for r in Q.distribution(P.matching(both, P.exists("label"), [TOOLS, MAKERS])).collect()}
    assert stats == {"tools": 7, "makers": 3}
    with pytest.raises(IncompatibleFields):
        P.matching(both, P.exists("lent"), [TOOLS, MAKERS])
    with pytest.raises(UnknownField):
        P.matching(both, P.exists("weight"), [TOOLS, MAKERS])
    with pytest.raises(SortError):
        Q.ordered(both, [TOOLS, Spec("xx", {"n": Field(type="integer")}, sort=("n",))])
    with pytest.raises(SortError):
        Q.ordered(tools, TOOLS, ["nope"])


def test_swedish_order(spark):
    spec = Spec.from_dict({"resource_id": "words", "fields": {"w": {"type": "string"}, "arr": {"type": "object", "collection": True, "fields": {"k": {"type": "integer"}}}}, "sort": "w"})
    df = data.entries(spark, [{"w": w, "arr": [{"k": i}, {"k": 9 - i}]} for i, w in enumerate(["ö", "a", "z", "ä", "å", "o"])], spec, "w")
    assert [r.entry.w for r in Q.ordered(df, spec).collect()] == ["a", "o", "z", "å", "ä", "ö"]
    assert [r.entry.w for r in Q.ordered(df, spec, ["arr.k"]).collect()][:1] == ["ö"]
    assert [r.entry.w for r in Q.ordered(df, spec, ["arr.k|desc"]).collect()][:1] == ["ö"]


def test_statistics(tools, spark):
    assert {(r.value, r["count"]) for r in S.statistics(tools, "weight", TOOLS).collect()} == {(0.75, 2), (0.4, 1), (11.0, 1), (1.25, 1)}
    assert [tuple(r) for r in S.statistics(tools, "made.by", TOOLS).collect()] == [("holm", 2), ("öberg", 2), ("nobody", 1)]
    # an entry counts once for a value, however often it has it
    assert {tuple(r) for r in S.statistics(tools, "jobs.along", TOOLS).collect()} == {("vice", 2), ("plane", 1), ("lost", 1), ("saw", 1), ("mallet", 1)}
    with pytest.raises(S.TooManyValues):
        S.statistics(tools, "label", TOOLS, max_values=3)
    nested = data.entries(spark, [{"code": 1, "infT": [{"wf": "a"}, {"wf": "a"}, {"wf": "b"}]}, {"code": 2, "infT": [{"wf": "a"}]}], NESTED)
    assert [tuple(r) for r in S.statistics(nested, "infT.wf").collect()] == [("a", 2), ("b", 1)]


def test_lookups(tools, makers, spark):
    linked = {r.id: (r.link.error, r.link.entry and r.link.entry.label) if r.link else None for r in L.link(tools, makers, "made.by", "key").collect()}
    names = {m["key"]: m["label"] for m in data.MAKERS}
    for r in data.TOOLS:
        by = r.get("made", {}).get("by")
        assert linked[r["key"]] == (None if by is None else (None, names[by]) if by in names else ("not found", None))
    many = {r.id: r.link.error for r in L.link(makers, tools, "key", "made.by").collect()}
    assert many == {"holm": "multiple matches", "öberg": "multiple matches", "kil": "not found"}
    expected = {m["key"]: having(lambda r, m=m: r.get("made", {}).get("by") == m["key"]) for m in data.MAKERS}
    assert {r.id: r.backlinks for r in L.backlink(makers, tools, "made.by", "key", "key").collect()} == expected
    used = {r.id: r.backlinks for r in L.backlink(tools, tools, "jobs.along", "key", "key").collect()}
    assert used == {t["key"]: having(lambda r, t=t: any(t["key"] in j.get("along", []) for j in jobs(r))) for t in data.TOOLS}
    parts = L.backlink(makers, tools, "made.by", "key", "key", limit=1).collect()
    joined = {}
    for r in parts:
        joined.setdefault(r.id, []).extend(r.backlinks)
    assert len(parts) >= 3 and {k: sorted(v) for k, v in joined.items()} == expected
    labels = sorted(names.values())
    assert sorted(L.collect_resource(tools, makers, "label").first()["values"]) == labels
    parts = L.collect_resource(tools, makers, "label", limit=2).collect()
    assert len(parts) == 14 and sorted(v for r in parts if r.id == "saw" for v in r["values"]) == labels
    assert L.collect_resource(tools, makers.limit(0), "label").filter("size(values) = 0 and part = 0").count() == 7
    words = spark.createDataFrame([("lund",), ("söner",), ("holm söner",), ("söner holm",), ("x",)], "word string")
    assert sorted(r.word for r in L.not_found(words, makers, ["label", "towns"]).collect()) == ["söner holm", "x"]
    asked = spark.createDataFrame([(0, "vice"), (1, "saw"), (2, "none")], "query int, value string")
    hits = sorted((r.query, r.hit.id if r.hit else None) for r in L.multi_lookup(asked, tools, "jobs.along").collect())
    assert hits == [(0, "plane"), (0, "saw"), (1, "gauge"), (2, None)]
    assert L.by_ids(tools, spark.createDataFrame([("saw",), ("vice",), ("77",)], "id string")).count() == 2
    both = K.union_collections([(tools, TOOLS), (makers.withColumn("id", F.when(F.col("id") == "kil", "saw").otherwise(F.col("id"))), MAKERS)])
    assert L.by_ids(both, spark.createDataFrame([("saw",)], "id string")).count() == 2
    assert L.by_ids(both, spark.createDataFrame([("tools", "saw")], "resource string, id string")).count() == 1


def test_phrases_stand_where_their_rarest_word_does(spark):
    rng = random.Random(9)
    words = ["a"] * 12 + ["b"] * 5 + ["c", "d", "e", "Å-f", "g9"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    texts = [line(rng.randrange(0, 15)) for _ in range(60)] + ["a " * 500 + "rare", ""]
    plain = Spec.from_dict({"resource_id": "lines", "fields": {"one": {"type": "string"}, "more": {"type": "string", "collection": True}}})
    df = data.entries(spark, [{"one": t, "more": [line(3), line(4)]} for t in texts], plain)
    asked = sorted({line(rng.randrange(1, 6)) for _ in range(200)} | {"a a a rare", "rare a", "x", "", "...", "a a", "rare", "c x"})
    fold = lambda t: t.lower().replace("-", "").split()
    held = [fold(t) for r in df.collect() for t in [r.entry.one, *r.entry.more]]
    holds = lambda w: any(t[i : i + len(w)] == w for t in held for i in range(len(t) - len(w) + 1))
    want = {p for p in asked if not (w := fold(p.strip("."))) or not holds(w)}
    got = L.not_found(spark.createDataFrame([(p,) for p in asked], "word string"), df, ["one", "more"])
    assert {r.word for r in got.collect()} == want and want & {"rare a", "x"} and "a a a rare" not in want


def test_derive(tools, makers):
    context = D.Context({"makers": D.Table(makers, MAKERS), "tools": D.Table(tools, TOOLS)})
    out = {r.id: r.entry._maker for r in D.derive(tools, TOOLS, context, until="indexed").collect()}
    assert out["plane"].entry.towns == ["Ängsö", "Lund"] and out["gauge"].error == "not found" and out["drill"] is None
    spec = D.effective_spec(TOOLS, context)
    everything = D.derive(tools, TOOLS, context)
    assert found(everything, P.sub("_maker", P.freetext("lund")), spec) == having(lambda r: r.get("made", {}).get("by") in ("holm", "öberg"))
    assert found(everything, P.or_(P.freetext("ängsö"), P.freetext("bore")), spec) == ["drill", "plane", "saw"]
    fields = {k: data.MAKERS_SPEC["fields"][k] for k in ("label", "key")}
    fields["_tools"] = {"virtual": True, "plugin": "backlink", "params": {"resource": "tools", "target": "made.by", "field": "key"}, "field_params": {"id": "key"}}
    fields["_labels"] = {"virtual": True, "plugin": "resource", "params": {"resource": "makers", "path": "label"}, "field_params": {}}
    back = Spec.from_dict({"resource_id": "makers", "fields": fields})
    rows = D.derive(makers, back, context).collect()
    assert {r.id: r.entry._tools for r in rows} == {m["key"]: having(lambda r, m=m: r.get("made", {}).get("by") == m["key"]) for m in data.MAKERS}
    assert all(sorted(r.entry._labels) == sorted(m["label"] for m in data.MAKERS) for r in rows)


def with_derived(**extra):
    fields = {k: v for k, v in data.TOOLS_SPEC["fields"].items() if k != "_maker"}
    return Spec.from_dict({"resource_id": "tools", "fields": {**json.loads(json.dumps(fields)), **extra}})


def copy(source, type="integer", **kw):
    return {"virtual": True, "plugin": "copy", "params": {"config": {"type": type}}, "field_params": {"value": source}, **kw}


def test_derive_order_and_flags(tools):
    spec = with_derived(c=copy("b", "number"), a=copy("weight", "number", hidden=True), b=copy("a", "number"))
    assert D.derivation_levels(spec) == [["a"], ["b"], ["c"]]
    row = D.derive(tools, spec).filter("id = 'vice'").first().entry
    assert row.c == 11.0 and row.b == 11.0 and "a" not in row.asDict()
    with pytest.raises(D.DeriveError, match="cycle"):
        D.derive(tools, with_derived(a=copy("b"), b=copy("a")))
    with pytest.raises(D.DeriveError, match="cycle"):
        D.derive(tools, with_derived(a=copy("a")))
    with pytest.raises(D.DeriveError, match="later phase"):
        D.derive(tools, with_derived(a=copy("b"), b=copy("made.year", searchable=False)), until="indexed")
    with pytest.raises(D.DeriveError, match="not found"):
        D.derive(tools, with_derived(a={"virtual": True, "plugin": "nope"}))
    late = with_derived(a=copy("key", "string"), b=copy("a", "string", searchable=False))
    first = D.derive(tools, late, until="indexed")
    assert "b" not in first.schema["entry"].dataType.fieldNames()
    second = D.derive(first, late, start="indexed")
    assert second.filter("entry.b = id and entry.a = id").count() == 7
    gated = with_derived(a={**copy("key", "string"), "field_params": {"value": "key", "include_if": "lent"}})
    assert sorted(r.id for r in D.derive(tools, gated).filter("entry.a is not null").collect()) == having(lambda r: r.get("lent"))
    assert sorted(r.id for r in D.derive(tools, with_derived(a=copy("made.year"))).filter("entry.a is null").collect()) == having(lambda r: "year" not in r.get("made", {}))
    D.register("total", lambda _f, p: F.aggregate(p["values"], F.lit(0.0), lambda s, x: s + x), {"type": "number"})
    listed = with_derived(a={"virtual": True, "plugin": "total", "field_params": {"values": ["weight", "weight"]}})
    assert D.derive(tools, listed).filter("entry.a <> 2 * entry.weight").isEmpty() and D.derive(tools, listed).filter("id = 'rule' and entry.a = 0").count() == 1
    D.register("pair", lambda _f, p: F.concat_ws("-", p["x"], p["y"]), {"type": "string"})
    pairs = with_derived(a={"virtual": True, "plugin": "pair", "collection": True, "flatten_params": True, "field_params": {"x": "jobs.what", "y": "jobs.along"}})
    made = {r.id: r.entry.a for r in D.derive(tools, pairs).collect()}
    assert made["gauge"] == ["Mark joints-saw", "Mark joints-mallet", "Mark joints-saw"] and made["saw"][:2] == ["Cut joints-vice", "Cut joints-plane"] and len(made["saw"]) == 4


def test_derive_inside_collection(spark, makers):
    fields = {
        "code": {"type": "integer"},
        "bids": {
            "type": "object",
            "collection": True,
            "fields": {
                "from": {"type": "long_string"},
                "note": {"type": "string"},
                "_from": {"virtual": True, "plugin": "link", "params": {"resource": "makers", "target": "key"}, "field_params": {"id": "bids.from"}},
                "_note": copy("bids.note", "string"),
                "_code": copy("code"),
            },
        },
    }
    spec = Spec.from_dict({"resource_id": "orders", "fields": fields})
    df = data.entries(spark, [{"code": 1, "bids": [{"from": "kil", "note": "x"}, {"from": "who"}, {"note": "y"}]}, {"code": 2}], spec)
    out = {r.id: r.entry for r in D.derive(df, spec, D.Context({"makers": D.Table(makers, MAKERS)})).collect()}
    bids = out["1"].bids
    assert bids[0]._from.entry.label == "Kil verktyg" and bids[1]._from.error == "not found" and bids[2]._from is None
    assert [b._note for b in bids] == ["x", None, "y"] and [b._code for b in bids] == [1, 1, 1]
    assert out["2"].bids is None


def test_chained_links_read_the_entries_once_a_level(spark):
    """Five links, each through the entry that the one before found: one more table read for each level, not twice as many."""
    n = 40
    plain = Spec.from_dict({"resource_id": "nodes", "fields": {"code": {"type": "integer"}, "next": {"type": "integer"}}})
    nodes = data.entries(spark, [{"code": i, "next": (i * 7 + 3) % (n + 2)} for i in range(n)], plain)
    link = lambda source: {"virtual": True, "plugin": "link", "params": {"resource": "nodes", "target": "code"}, "field_params": {"id": source}}
    reads = []
    for depth in (1, 3, 5):
        fields = {"code": {"type": "integer"}, "next": {"type": "integer"}}
        for k in range(depth):
            fields[f"_l{k}"] = link("next" if k == 0 else f"_l{k - 1}.entry.next")
        spec = Spec.from_dict({"resource_id": "nodes", "fields": fields})
        out = D.derive(nodes, spec, D.Context({"nodes": D.Table(nodes, plain)}))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        reads.append(plan.count("Relation ["))
        for r in out.collect():
            at = r.entry.next
            for k in range(depth):
                found = r.entry[f"_l{k}"]
                if at is None:
                    assert found is None
                elif at < n:
                    assert found.entry.code == at
                    at = found.entry.next
                else:
                    assert found.error == "not found"
                    at = None
    assert reads == [2, 4, 6]


def test_derive_in_nested_collections(spark):
    """Table functions at two levels of collections, with lists, empty ones, and two fields that ask the same."""
    asked = []

    def half(_context, _fixed, combos):
        asked.append(combos)
        return combos.select("*", F.when(F.col("x") % 2 == 0, F.struct((F.col("x") / 2).cast("long").alias("h"))).alias("result"))

    D.register("half", half, {"type": "object", "fields": {"h": {"type": "integer"}}}, "table")
    derived = lambda source, **kw: {"virtual": True, "plugin": "half", "params": {}, "field_params": {"x": source}, **kw}
    inner = {"n": {"type": "integer"}, "m": {"type": "integer", "collection": True}, "_n": derived("rows.cells.n"), "_m": derived("rows.cells.m", collection=True, flatten_params=True)}
    fields = {"code": {"type": "integer"}, "rows": {"type": "object", "collection": True, "fields": {"cells": {"type": "object", "collection": True, "fields": inner}}}, "_c": derived("code")}
    spec = Spec.from_dict({"resource_id": "deep", "fields": fields})
    cell = lambda n, m: {"n": n, "m": m}
    bodies = [
        {"code": 4, "rows": [{"cells": [cell(2, [4, 5, 6]), cell(None, []), cell(3, None)]}, {"cells": []}, {"cells": None}, {"cells": [cell(8, [2])]}]},
        {"code": 5, "rows": []},
        {"code": 6},
        {"code": 8, "rows": [{"cells": [cell(i, list(range(i))) for i in range(30)]} for _ in range(20)]},
    ]
    want = lambda x: {"h": x // 2} if x is not None and x % 2 == 0 else None
    df = data.entries(spark, bodies, spec)
    got = {r.id: r.entry.asDict(True) for r in D.derive(df, spec, D.Context()).collect()}
    assert len(asked) == 1  # one question for all fields
    ids = [r.id for r in df.collect()]
    for i, body in zip(ids, bodies, strict=True):
        assert got[i]["_c"] == want(body["code"])
        for row, given in zip(got[i]["rows"] or [], body.get("rows") or [], strict=True):
            for out, c in zip(row["cells"] or [], given["cells"] or [], strict=True):
                assert out["_n"] == want(c["n"])
                assert out["_m"] == (None if c["m"] is None else [want(x) for x in c["m"]])


def test_preview_and_unstored(tools, spark):
    bodies = tools.select("id", "entry")
    assert D.preview(bodies, with_derived(a=copy("key", "string"))).filter("entry.a = id").count() == 7
    hidden = Spec.from_dict({"resource_id": "tools", "fields": {**data.TOOLS_SPEC["fields"], "weight": {"type": "number", "store": False}}})
    assert "weight" not in K.hide_unstored(tools, hidden).schema["entry"].dataType.fieldNames()
    assert K.with_metadata(tools).columns == ["resource", "id", "entry", "last_modified_by", "last_modified", "version"]


def test_answers_are_sent_to_their_entries_once(spark):
    """Answers in nested places go to their entry in one exchange, whatever the depth."""
    rows = spark.createDataFrame([(r, i, j, f"{r}{i}{j}") for r in range(3) for i in range(2) for j in range(2)], "_row long, _i0 int, _i1 int, _result string")
    made = D._gathered(rows.unionByName(spark.createDataFrame([(3, None, None, None)], rows.schema)), 2, "_a")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {r._row: r._a for r in made.collect()}
    assert got == {**{r: [[f"{r}{i}{j}" for j in range(2)] for i in range(2)] for r in range(3)}, 3: []}
