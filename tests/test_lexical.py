import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import inflection as I
from foliant.operators import predicates as P
from foliant.operators import references as R
from foliant.operators import valency as V
from foliant.operators import vectors as N
from foliant.operators.highlight import highlight
from foliant.functions import text
from foliant.plans.spec import Spec
from tests import data
from tests.test_query import NESTED, TOOLS


@pytest.mark.parametrize("chunk", [1])
def test_rules(spark, chunk):
    cases = [
        ("hund", "+en", "hunden"), ("flicka", "%sp+or", "flickor"), ("flicka", "%sv+or", "flickor"), ("hund", "%sv+x", "hundx"),
        ("hund", "%sk", "hun"), ("pojke", "%ts+x", "pojx"), ("hus", "%ss+x", "hux"), ("hund", "%ss", "hund"),
        ("rymmas", "%fv", "ryms"), ("skrämmas", "%fv", "skräms"), ("cykel", "%fv+n", "cykln"), ("hund", "%fv", "hund"),
        ("tak", "%dk", "tack"), ("hot", "%dk+a", "hotta"), ("bo", "%dk", "bo"), ("hamn", "%ek", "hamn"), ("komma", "%ek", "koma"),
        ("bok", "%om+er", "böker"), ("man", "%om", "män"), ("gås", "%om", "gäs"), ("hund", "%om", "hönd"), ("sten", "%om", "sten"), ("fly", "%om", "flö"),
        ("binda", "%ava", "binda"), ("binda", "%sp%ava", "banda"[:4]), ("skriv", "%ave", "skrev"), ("fly", "%avö", "flö"),
        ("ligga", "%tj", "liggja"), ("ljuga", "%ej", "ljuga"), ("gjuta", "%ej", "guta"), ("skjuta", "%ej", "skuta"), ("stjäla", "%ej", "stäla"),
        ("hund", "%asc", "hunds"), ("hus", "%asc", "hus"), ("tv", "%ascc", "tv:s"), ("box", "%ascc", "box"),
        ("vara", "=", "vara"), ("vara", "är", "är"), ("vara", "=+s", "varas"), ("bil", "+a/r", "bilar"), ("bok", "%om%dk+er", "böcker"),
        ("", "%sp", None), ("a", "%ts", None), ("hund", "", "hund"),
    ]
    df = spark.createDataFrame(cases, "w string, r string, e string")
    wrong = df.withColumn("got", I.apply_rules(F.col("w"), F.col("r"))).filter("not got <=> e").collect()
    assert wrong == []


def paradigm(name, *rows):
    return {"name": name, "definition": [dict(zip(("row", "rules", "heading", "tagg"), r, strict=True), prescript="", postscript="", extra="") for r in rows]}


def paradigms(spark):
    rows = [
        paradigm("s2", (1, "=", "Singular", "SNI"), (1, "+en", "Singular", "SND"), (2, "+ens", "Singular", "SGD"), (3, "+ar", "Plural", "PNI")),
        paradigm("s1", (1, "=", "Singular", "SNI"), (1, "%sp+an", "Singular", "SND"), (3, "%sp+or", "Plural", "PNI")),
        paradigm("v1", (1, "=", "Infinitiv", "V0N0A"), (2, "+r", "Presens", "VPN"), (3, "+s", "Passiv", "V0N0P"), (4, "+d", "Perfekt particip", "AF00"), (5, "=", "Imperativ", "V0M0A")),
    ]
    js = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    return js.select(F.from_json("j", f"struct<name:string,definition:{I.DEFINITION}>").alias("p")).select("p.*")


def test_tables(spark):
    lemmas = spark.createDataFrame([("hund", "s2", None), ("leta upp", "v1", "partikelverb"), ("tvätta sig", "v1", "reflexivt_verb"), ("duscha sig", "v1", "partikelverb")], "lemma string, paradigm string, kind string")
    made = I.inflect(lemmas, paradigms(spark)).withColumn("t", I.table(F.col("forms")))
    rows = {r.lemma: r.t for r in made.collect()}
    hund = rows["hund"]
    assert [h.heading for h in hund] == ["Singular", "Plural"]
    assert [[p.form for p in row.preform] for row in hund[0].rows] == [["hund", "hunden"], ["hundens"]]
    assert [[p.form for p in row.preform] for row in hund[1].rows] == [["hundar"]]
    upp = {p.tag: p.form for h in rows["leta upp"] for row in h.rows for p in row.preform}
    assert upp == {"V0N0A": "leta upp", "VPN": "letar upp", "V0N0P": "letas upp", "AF00": "uppletad", "V0M0A": "leta upp"}
    assert [h.heading for h in rows["tvätta sig"]] == ["Infinitiv", "Presens"]
    assert [h.heading for h in rows["duscha sig"]] == ["Infinitiv", "Presens"]
    assert I.inflection_rows(I.inflect(lemmas, paradigms(spark))).count() == 4 + 5 + 2 + 2


def test_match(spark):
    lemmas = spark.createDataFrame(
        [("hund", None, "hunden,hundar|PNI", ""), ("flicka", None, "flickan", None), ("flicka", None, "", "flickan"), ("hund", None, "hundar|SNI", "")],
        "lemma string, kind string, include string, exclude string",
    )
    got = sorted((r.lemma, r.name) for r in I.match_paradigms(lemmas, paradigms(spark)).collect())
    assert got == [("flicka", "s1"), ("flicka", "s2"), ("flicka", "v1"), ("hund", "s2")]
    named = lemmas.withColumn("paradigm", F.lit("s1"))
    assert sorted((r.lemma, r.name) for r in I.match_paradigms(named, paradigms(spark)).collect()) == [("flicka", "s1")]
    assert I.conditions("a|b,c") == [("a", "b"), ("c", None)] and I.conditions("") == []


def test_match_is_what_trying_every_paradigm_gives(spark):
    """The stem index against every word tried with every paradigm."""
    rng = random.Random(12)
    chains = ["=", "+en", "+a/r", "%sv+an", "%sv+or", "%om+er", "%om", "%asc", "%ascc", "%dk+t", "%av" + "i%dk", "%sp+de", "%ek", "%fv+ar", "+x%om+y", "fast", "fast%asc", "%ts", "=+s", "%ss+sar"]
    made = [(f"p{i}", [(float(k), rng.choice(chains), rng.choice(["A", "B", "Perfekt particip"]), rng.choice(["T1", "T2", "P"])) for k in range(rng.randrange(1, 4))]) for i in range(60)]
    names = ("row", "rules", "heading", "tagg", "prescript", "postscript", "extra")
    js = spark.createDataFrame([(n, json.dumps([dict(zip(names, (*r, "", "", ""), strict=True)) for r in rows])) for n, rows in made], "name string, j string")
    every = js.select("name", F.from_json("j", I.DEFINITION).alias("definition")).cache()
    words = ["hus", "flicka", "man", "bok", "a", "s", "gata", "leta upp", "tvätta sig", "stå fast", "ö", "kummel"]
    kinds = {"leta upp": "partikelverb", "tvätta sig": "reflexivt_verb", "stå fast": "partikelverb"}
    plain = spark.createDataFrame([(w, kinds.get(w)) for w in words], "lemma string, kind string")
    pairs = plain.crossJoin(every).withColumn("forms", I.forms(F.col("lemma"), F.col("kind"), F.col("definition"))).cache()
    given = {}
    for r in pairs.collect():
        given.setdefault(r.lemma, []).extend((f.form, f.tag) for f in r.forms if f.form)
    asked = []
    for w in words:
        for _ in range(6):
            some = rng.sample(given[w], min(len(given[w]), rng.randrange(0, 3)))
            include = ",".join(f if rng.random() < 0.6 else f"{f}|{t}" for f, t in some)
            asked.append((w, kinds.get(w), include, rng.choice([None, "", rng.choice(given[w])[0], "none"])))
        asked.append((w, kinds.get(w), None, None))
    lemmas = spark.createDataFrame(asked, "lemma string, kind string, include string, exclude string")
    want = lemmas.join(pairs.select("lemma", "name", "forms"), "lemma").filter(I.fits(F.col("forms"), F.col("include"), F.col("exclude")))
    rows = lambda df: sorted((r.lemma, r.name, str(r.forms)) for r in df.collect())
    got = rows(I.match_paradigms(lemmas, every))
    assert got == rows(want) and len(got) > 500


def test_approximate_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    vectors = centres[rng.integers(0, 60, 3000)] + rng.normal(scale=0.15, size=(3000, 16))
    df = spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, class int, vector array<double>")
    exact = N.knn(df, 5).cache()
    found = N.approximate(df, 5, cells=300, probes=24)
    row = N.recall(found, exact).first()
    assert (row.vectors, row.wanted) == (3000, 15000) and row.recall >= 0.95
    assert N.recall(N.approximate(df, 5, cells=300, probes=300, groups=300), exact).first().recall == 1.0
    assert found.filter("id = neighbour").isEmpty() and N.approximate(df.limit(0)).isEmpty()


def test_the_lexicon_of_arrays_is_made_once(spark, monkeypatch):
    from foliant.queries import lexical

    names = []
    monkeypatch.setattr(lexical, "materialise", lambda df, name="table": names.append(name) or df.cache())
    monkeypatch.setattr(lexical, "lexicon", lambda spark, _d: spark.createDataFrame([], shape))
    shape = "resource string, id string, entry struct<ortografi:string, ordklass:string, so:struct<l_nr:string, homografNr:bigint, text:string, huvudbetydelser:array<struct<x_nr:string, visas:boolean>>>>"
    assert lexical.backward_arrays(spark, "").isEmpty() and names == ["lexicon"]


def test_neighbours_are_sent_to_blocks_not_to_cells(spark, monkeypatch):
    """Vectors without clusters look into nearly all cells: what is written must not grow with the number of those."""
    written = []
    real = N.materialise

    def counted(df, name="table"):
        out = real(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(N, "materialise", counted)
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 24)))]
    df = spark.createDataFrame(rows, "id long, class int, vector array<double>")
    got = {(r.id, r.neighbour) for r in N.knn(df, 5, block=50).collect()}
    assert got == brute(rows, 5)
    by_vector = {(r.id, r.neighbour, r.similarity) for r in N.approximate(df, 5, cells=40, probes=20, groups=6, block=10).collect()}
    assert sum(n for _, n in written) > 600 * 10  # probes are fewer than blocks: by vector
    written.clear()
    by_block = {(r.id, r.neighbour, r.similarity) for r in N.approximate(df, 5, cells=40, probes=20, groups=6, block=300).collect()}
    assert by_block == by_vector and all(n <= 600 for _, n in written)
    assert {(r.id, r.neighbour) for r in N.knn(df, 5, block=50).collect()} == got and all(n <= 600 for _, n in written)


def test_valency(spark):
    cases = {
        "a/b c": ["a c", "b c"],
        "x (a/b) y": ["x (a) y", "x (b) y"],
        "det[caps /något till] z": ["det z", "[caps något till] z"],
        "ngn / ngt gör/ger": ["ngn gör", "ngn ger", "ngt gör", "ngt ger"],
        "plain (text) [caps x y]": [],
        "a/(b c)/d": ["a", "(b c)", "d"],
        "[caps (] a/b [caps )]": ["( a )".replace(" a ", " a "), "( b )"],
        "(a (b/c))": ["(a (b))", "(a (c))"],
        "x_y/z": ["x y", "z"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {}
    for r in V.expand_patterns(df.withColumn("key", F.col("p")), ["key"], "p").orderBy("key", "position").collect():
        got.setdefault(r.key, []).append(r.variant)
    assert {k: got.get(k, []) for k in cases} == cases


def test_valency_ranges(spark):
    """A pattern with very many variants: its numbers are dealt in ranges, and all variants come out once."""
    from pyspark.sql import types as T

    patterns = [("long", " ".join(f"a{i}/b{i}" for i in range(18))), ("wide", "x (" + "/".join(f"c{i}" for i in range(40)) + ") y/z"), ("short", "p/q"), ("none", "a / "), ("nothing", None)]
    df = spark.createDataFrame(patterns, "key string, p string")
    rows = V.expand_patterns(df, ["key"], "p", numbers=1 << 12)
    assert rows.schema["position"].dataType == T.LongType()
    kept = rows.withColumn("task", F.spark_partition_id()).cache()
    sizes = {r.key: (r.n, r.different, r.low, r.high) for r in kept.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("variant").alias("different"), F.min("position").alias("low"), F.max("position").alias("high")).collect()}
    assert sizes == {"long": (1 << 18, 1 << 18, 0, (1 << 18) - 1), "wide": (80, 80, 0, 79), "short": (2, 2, 0, 1)}
    assert kept.filter("key = 'long'").select("task").distinct().count() > 2
    few = {r.position: r.variant for r in kept.filter("key = 'long' and position in (0, 1, 5000, 262143)").collect()}
    assert few == {n: " ".join(f"{'ab'[n >> (17 - i) & 1]}{i}" for i in range(18)) for n in (0, 1, 5000, 262143)}


def brute(rows, k):
    out = set()
    for i, c, v in rows:
        sims = []
        for j, d, w in rows:
            if d == c and j != i:
                dot = sum(a * b for a, b in zip(v, w, strict=True))
                sims.append((-round(dot / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in w)), 9), j))
        out.update((i, j) for _, j in sorted(sims)[:k])
    return out


@pytest.mark.parametrize("cells,block", [(4, 16), (8, 1000), (1, 7)])
def test_neighbours(spark, cells, block):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    rows = []
    for i in range(240):
        c = rng.choice(centres)
        rows.append((i, 0 if i % 3 else i % 4, [x + rng.gauss(0, 0.3) for x in c]))
    rows += [(1000 + i, 0, rows[5][2]) for i in range(20)]  # copies
    df = spark.createDataFrame(rows, "id long, class int, vector array<double>")
    got = {(r.id, r.neighbour) for r in N.knn(df, 5, cells, block).collect()}
    assert got == brute(rows, 5)
    near = {(r.id, r.neighbour) for r in N.knn(df, 5, cells, block, probes=cells).collect()}
    assert near == got


SO = {
    "resource_id": "dictionary",
    "fields": {
        "ortografi": {"type": "string"},
        "ordklass": {"type": "string"},
        "visas": {"type": "boolean"},
        "so": {
            "type": "object",
            "fields": {
                "l_nr": {"type": "string"},
                "homografNr": {"type": "integer"},
                "visas": {"type": "boolean"},
                "text": {"type": "string"},
                "huvudbetydelser": {
                    "type": "object",
                    "collection": True,
                    "fields": {
                        "x_nr": {"type": "string"},
                        "visas": {"type": "boolean"},
                        "definition": {"type": "string"},
                        "hänvisningar": {"type": "object", "collection": True, "fields": {"hänvisning": {"type": "string"}, "visas": {"type": "boolean"}}},
                        "underbetydelser": {"type": "object", "collection": True, "fields": {"kc_nr": {"type": "string"}, "definition": {"type": "string"}, "visas": {"type": "boolean"}}},
                    },
                },
            },
        },
        "saol": {"type": "object", "fields": {"id": {"type": "string"}, "homografNr": {"type": "integer"}, "moderverb": {"type": "string"}, "text": {"type": "string"}}},
    },
    "sort": "ortografi",
}
ENTRIES = [
    {
        "ortografi": "ett",
        "so": {
            "l_nr": "1",
            "homografNr": 2,
            "text": "se +två(refid=lnr2) och +x(refid=xnr20) +y(refid=zzz9)",
            "huvudbetydelser": [
                {"x_nr": "10", "definition": "[i bra] +ord(refid=lnr2)", "hänvisningar": [{"hänvisning": "lnr2", "visas": False}, {"hänvisning": "kcnr30"}, {"hänvisning": "bad"}]},
                {"x_nr": "11", "visas": False, "hänvisningar": [{"hänvisning": "xnr21"}, {"hänvisning": "kcnr30"}]},
                {"x_nr": "12", "definition": "d", "underbetydelser": [{"kc_nr": "30", "definition": "under"}, {"kc_nr": "31", "visas": False}]},
            ],
        },
        "saol": {"id": "1", "moderverb": "2", "text": "refid=lnr3"},
    },
    {"ortografi": "två", "ordklass": "subst", "so": {"l_nr": "2", "homografNr": 7, "huvudbetydelser": [{"x_nr": "20"}]}, "saol": {"id": "2", "homografNr": 4}},
    {"ortografi": "dold", "visas": False, "so": {"l_nr": "3", "text": "refid=lnr1"}},
]


@pytest.fixture(scope="module")
def lexicon(spark):
    spec = Spec.from_dict(SO)
    return data.entries(spark, ENTRIES, spec, "ortografi").cache()


def test_references(lexicon):
    edges = R.forward_edges(lexicon).cache()
    got = {(r.id, r.ref): r.visas for r in edges.collect()}
    assert got == {
        ("ett", "so.lnr2"): True,
        ("ett", "so.xnr20"): True,
        ("ett", "so.kcnr30"): True,
        ("ett", "so.xnr21"): False,
        ("ett", "saol.lnr2"): True,
        ("ett", "saol.lnr3"): True,
        ("dold", "so.lnr1"): False,
    }
    ids = {(r.id, r.kind, r.ref) for r in R.find_ids(lexicon).collect()}
    assert ("ett", "KCNR", "so.kcnr31") in ids and ("två", "SAOL_LNR", "saol.lnr2") in ids and len(ids) == 11
    back = {(r.id, r.from_id, r.ref, r.ortografi, r.homografNr, r.visas) for r in R.backward_edges(lexicon, edges).collect()}
    assert ("två", "ett", "so.lnr2", "ett", "2", True) in back and ("två", "ett", "saol.lnr2", "ett", None, True) in back
    assert ("ett", "dold", "so.lnr1", "dold", None, False) in back
    nested = R.backward_edges(lexicon, edges).filter("id = 'ett'").limit(1)
    arrays = {r.id: r.references for r in R.backward_refs(lexicon, edges, nested).collect()}
    assert len(arrays["två"]) == 3 and [x.subobject for x in arrays["ett"]].count(True) == 1


def test_directory(lexicon):
    directory = R.id_info(lexicon).cache()
    rows = {r.id: r for r in directory.collect()}
    assert set(rows) == {"so.lnr1", "so.xnr10", "so.xnr12", "so.kcnr30", "saol.lnr1", "so.lnr2", "so.xnr20", "saol.lnr2"} | ({"so.lnr3"} if "so.lnr3" in rows else set())
    assert (rows["so.xnr10"].huvudbetydelseNr, rows["so.xnr12"].huvudbetydelseNr, rows["so.xnr20"].huvudbetydelseNr) == ("1", "2", None)
    assert rows["so.kcnr30"].huvudbetydelseNr == "2" and rows["so.lnr2"].homografNr == "7" and rows["so.lnr2"].ordklass == "subst"
    info = {(r.from_id, r.id) for r in R.reference_info(R.forward_edges(lexicon), directory, "so.").collect()}
    assert info >= {("ett", "lnr2"), ("ett", "xnr20"), ("ett", "kcnr30")}


def test_sense_text(lexicon):
    dtype = lexicon.schema["entry"].dataType["so"].dataType["huvudbetydelser"].dataType.elementType
    senses = lexicon.filter("id = 'ett'").select(F.explode("entry.so.huvudbetydelser").alias("s"))
    got = [r.t for r in senses.select(R.sense_text(F.lit("ett"), F.lit("böj"), F.col("s"), dtype).alias("t")).collect()]
    assert [g and " ".join(g.split()) for g in got] == ["ett böj bra ord", None, "ett böj d under"]


def test_markup(spark):
    row = spark.range(1).select(
        text.clean_refs(F.lit("se +få fram(refid=xnr12) nu")).alias("a"),
        text.clean_tags(F.lit("[i en text] [b x]")).alias("b"),
        text.extract_segments(F.lit('<l name="ord_1"><e a="1">ordet</e>\n<e>två</e> name="x y">')).alias("c"),
    ).first()
    assert row.a == "se få fram nu" and row.b == "en text [b x]"
    assert row.c.lemmata == ["ord_1"] and row.c.wordforms == ["ordet", "två"]


def test_highlight(spark):
    tools = data.entries(spark, data.TOOLS, TOOLS, "key")

    def marks(p, df=tools, spec=TOOLS, **kw):
        return {r.id: r.highlight for r in highlight(P.matching(df, p, spec), p, spec, **kw).collect()}

    assert marks(P.equals("jobs.what", "trim")) == {"saw": {"jobs.what": ["<em>Trim</em>"]}, "plane": {"jobs.what": ["<em>Trim</em> edges"]}}
    assert marks(P.equals("label", "BENCH vice")) == {"vice": {"label": ["<em>Bench</em> <em>vice</em>"]}}
    assert marks(P.regexp("label", r"\d+")) == {"drill": {"label": ["Hand-drill <em>40</em>"]}}
    assert marks(P.regexp("label", r"\D+"))["drill"] == {"label": ["<em>Hand-drill</em> 40"]}
    assert marks(P.startswith("label", r"f\S", regex=True)) == {"saw": {"label": ["<em>Fine</em> saw"]}, "rule": {"label": ["<em>Folding</em> rule"]}}
    assert marks(P.freetext("joints"))["gauge"] == {"jobs.what": ["Mark <em>joints</em>"]}
    assert marks(P.equals("weight", 11)) == {"vice": None}
    assert marks(None)["saw"] is None
    nested = data.entries(spark, [{"code": 1, "infT": [{"wf": "väl-känd x"}, {"wf": "y"}, {"wf": "välkänd"}]}], NESTED)
    p = P.sub("infT", P.startswith("wf", "välk"))
    assert marks(p, nested, NESTED) == {"1": {"infT.wf": ["<em>väl-känd</em> x", "<em>välkänd</em>"]}}
    assert marks(p, nested, NESTED, positions=True) == {"1": {"infT[0].wf": ["<em>väl-känd</em> x"], "infT[2].wf": ["<em>välkänd</em>"]}}
    assert list(itertools.chain()) == []


def test_derived_functions(spark, lexicon):
    from foliant.operators import builtin  # noqa: F401
    from foliant.operators import derive as D

    def virtual(plugin, **field_params):
        return {"virtual": True, "plugin": plugin, "field_params": field_params}

    spec = Spec.from_dict({**SO, "fields": {**SO["fields"], "refs": virtual("forward_references", entry=""), "ids": virtual("id_info", entry="")}})
    rows = {r.id: r.entry for r in D.derive(lexicon, spec).collect()}
    assert {(x.ref, x.visas) for x in rows["dold"].refs} == {("so.lnr1", False)} and len(rows["ett"].refs) == 6
    assert {x.id for x in rows["två"].ids} == {"so.lnr2", "so.xnr20", "saol.lnr2"}

    fields = {"valens": {"type": "string"}, "word": {"type": "string"}, "kind": {"type": "string"}, "group": {"type": "string"}, "vec": {"type": "dense_vector"}}
    derived = {"v": virtual("valency", valens="valens"), "near": {**virtual("neighbours", id="valens", **{"class": "group", "vector": "vec"}), "params": {"k": 1}}}
    spec = Spec.from_dict({"resource_id": "pats", "fields": {**fields, **derived}})
    records = [{"valens": "a/b", "group": "g", "vec": [1.0, 0.0]}, {"valens": "c", "group": "g", "vec": [1.0, 0.1]}, {"valens": "d", "group": "g", "vec": [0.0, 1.0]}]
    df = data.entries(spark, records, spec, "valens")
    got = {r.id: r.entry for r in D.derive(df, spec).collect()}
    assert [x.exp_valens for x in got["a/b"].v] == ["a", "b"] and got["c"].v == []
    assert [x.id for x in got["a/b"].near] == ["c"] and [x.id for x in got["d"].near] == ["c"]

    D.register("first_paradigm", lambda _f, p: F.struct(F.from_json(F.lit(json.dumps(paradigm("s2", (1, "+en", "S", "t"))["definition"])), I.DEFINITION).alias("definition")), {"type": "string"})
    words = Spec.from_dict({"resource_id": "words", "fields": {"word": {"type": "string"}, "tab": virtual("first_paradigm", word="word"), "infl": {**virtual("inflection", lemma="word", table="tab"), "hidden": False}}})
    out = D.derive(data.entries(spark, [{"word": "hund"}], words, "word"), words).first().entry
    assert out.infl[0].heading == "S" and out.infl[0].rows[0].preform[0].form == "hunden"


def test_words_meet_their_paradigms_where_they_are(spark):
    """No shuffle by the name of a paradigm, of which there are few, and each table of forms is made once."""
    lemmas = spark.createDataFrame([(w, None, f"{w}en", f"{w}x") for w in ("hund", "katt")], "lemma string, kind string, include string, exclude string")
    few = paradigms(spark)
    named = lemmas.withColumn("paradigm", F.lit("s1"))
    for df in (I.match_paradigms(lemmas, few), I.match_paradigms(named, few), I.inflect(named, few)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [name" not in plan and "SortMergeJoin [paradigm" not in plan
    steps = [df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") for df in (I.match_paradigms(named, few), I.inflect(named, few))]
    assert steps[0] == steps[1]
