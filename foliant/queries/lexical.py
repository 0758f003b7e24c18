"""Markup, valency, inflection, references, spelling and neighbours on the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import inflection as I
from foliant.operators import lookups as L
from foliant.operators import references as R
from foliant.operators import valency as V
from foliant.operators import vectors as N
from foliant.operators.collections import as_entries
from foliant.plans.spec import Spec
from foliant.queries import tables as T
from foliant.queries.tables import as_long
from foliant.session import materialise, spread

QUERIES: dict[str, tuple] = {}


def add(name: str, sql: str | None):
    def put(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return put


# ---------------------------------------------------------------- markup and patterns


@add("T6_clean_markup", "SELECT p_partkey AS code, p_name || ' och ' || p_type || ' (' || p_brand || ')' AS text FROM part")
def clean_markup(spark, d):
    rows = T.load(spark, d, "part")
    written = F.expr("concat('+', p_name, '(refid=xnr', p_partkey, ') och [i ', p_type, ' (', p_brand, ')]')")
    return rows.select(F.col("p_partkey").alias("code"), text.clean_tags(text.clean_refs(written)).alias("text"))


@add("T7_segments", f"WITH w AS (SELECT conv_id, turn, {T.sql_words('text')} AS words FROM conversations) SELECT conv_id, turn, len(words) AS n, array_to_string(words, ' ') AS lemmata, array_to_string(words, ' ') AS wordforms FROM w")
def segments(spark, d):
    turns = T.load(spark, d, "conversations")
    tagged = F.transform(text.analyze(F.col("text")), lambda w: F.concat(F.lit('<l name="'), w, F.lit('"><e n="1">'), w, F.lit("</e></l>")))
    got = turns.select("conv_id", "turn", text.extract_segments(F.array_join(tagged, "\n")).alias("s"))
    return got.select("conv_id", "turn", as_long(F.size("s.lemmata"), "n"), F.array_join("s.lemmata", " ").alias("lemmata"), F.array_join("s.wordforms", " ").alias("wordforms"))


@add("T7_segments_in_pages", "SELECT page_id, len(regexp_extract_all(html, 'name=\"([\\p{L}\\p{N}_]+)\">', 1)) AS names, len(regexp_extract_all(html, '<e.*?>(.+?)</e>', 1)) AS bodies FROM pages")
def segments_in_pages(spark, d):
    got = T.load(spark, d, "pages").select("page_id", text.extract_segments(F.col("html")).alias("s"))
    return got.select("page_id", as_long(F.size("s.lemmata"), "names"), as_long(F.size("s.wordforms"), "bodies"))


@add(
    "T8_valency",
    """WITH p AS (SELECT p_partkey AS code, string_split(p_name, ' ') AS a, [p_type, p_brand] AS b FROM part),
x AS (SELECT code, unnest(b) AS second, generate_subscripts(b, 1) AS j, a FROM p),
y AS (SELECT code, second, j, unnest(a) AS first, generate_subscripts(a, 1) AS i FROM x)
SELECT code, (j - 1) * 2 + i - 1 AS position, first || ' (' || second || ')' AS variant FROM y""",
)
def valency(spark, d):
    pattern = F.expr("concat(replace(p_name, ' ', ' / '), '  (', p_type, ' /', p_brand, ')')")
    # patterns are read one by one: worth all cores
    rows = spread(T.load(spark, d, "part")).select(F.col("p_partkey").alias("code"), pattern.alias("pattern"))
    return V.expand_patterns(rows, ["code"], "pattern")


# ---------------------------------------------------------------- inflection

# Three paradigms, as (name, rows of (line, rules, heading, tag)).
PARADIGMS = (
    ("n1", ((1, "=", "Singular", "SNI"), (1, "+en", "Singular", "SND"), (2, "+/ar", "Plural", "PNI"))),
    ("n2", ((1, "=", "Singular", "SNI"), (1, "%sv+an", "Singular", "SND"), (2, "%sv+or", "Plural", "PNI"))),
    ("v1", ((1, "=", "Infinitiv", "V0N0A"), (2, "%om+r", "Presens", "VPN"), (3, "%asc", "Passiv", "VPP"), (4, "%avi%dk", "Supinum", "VS"))),
)


def paradigms(spark) -> DataFrame:
    names = ("row", "rules", "heading", "tagg", "prescript", "postscript", "extra")
    rows = [(name, json.dumps([dict(zip(names, (*r, "", "", ""), strict=True)) for r in table])) for name, table in PARADIGMS]
    return spark.createDataFrame(rows, "name string, j string").select("name", F.from_json("j", I.DEFINITION).alias("definition"))


def _vocabulary(spark, d) -> DataFrame:
    return T.load(spark, d, "documents").select(F.explode(F.array_distinct(text.analyze(F.col("text")))).alias("lemma")).distinct()


_VOCAB = f"voc AS (SELECT DISTINCT unnest({T.sql_words('text')}) AS lemma FROM documents)"
_LAST = "regexp_extract(lemma, '^(.*)([{0}])([^{0}]*)$', {1})"
_OM = f"CASE WHEN regexp_matches(lemma, '[aouåy]') THEN {_LAST.format('aouåy', 1)} || translate({_LAST.format('aouåy', 2)}, 'aouåy', 'äööäö') || {_LAST.format('aouåy', 3)} ELSE lemma END"
_AV = f"CASE WHEN regexp_matches(lemma, '[aouåeiyäö]') THEN {_LAST.format('aouåeiyäö', 1)} || 'i' || {_LAST.format('aouåeiyäö', 3)} ELSE lemma END"
_DK = f"CASE WHEN ends_with({_AV}, 'k') THEN left({_AV}, len({_AV}) - 1) || 'ck' WHEN regexp_matches({_AV}, '[bcdfghjlmnpqrstvwxz]$') THEN {_AV} || right({_AV}, 1) ELSE {_AV} END"
_STEM = "regexp_replace(lemma, '[aouåeiyäö]$', '')"
_FORMS = f"""f AS (
  SELECT lemma, 'n1' AS name, 'SNI' AS tag, lemma AS form FROM voc UNION ALL SELECT lemma, 'n1', 'SND', lemma || 'en' FROM voc UNION ALL SELECT lemma, 'n1', 'PNI', lemma || 'ar' FROM voc
  UNION ALL SELECT lemma, 'n2', 'SNI', lemma FROM voc UNION ALL SELECT lemma, 'n2', 'SND', {_STEM} || 'an' FROM voc UNION ALL SELECT lemma, 'n2', 'PNI', {_STEM} || 'or' FROM voc
  UNION ALL SELECT lemma, 'v1', 'V0N0A', lemma FROM voc UNION ALL SELECT lemma, 'v1', 'VPN', {_OM} || 'r' FROM voc
  UNION ALL SELECT lemma, 'v1', 'VPP', CASE WHEN regexp_matches(lemma, '[sxz]$') THEN lemma ELSE lemma || 's' END FROM voc
  UNION ALL SELECT lemma, 'v1', 'VS', {_DK} FROM voc)"""
_CHOSEN = "CASE WHEN regexp_matches(lemma, '[aeiouyåäö]$') THEN 'n2' WHEN ends_with(lemma, 's') THEN 'v1' ELSE 'n1' END"


@add("T9_inflection", f"WITH {_VOCAB}, {_FORMS} SELECT lemma, name AS paradigm, tag, form FROM f WHERE name = {_CHOSEN}")
def inflection(spark, d):
    chosen = F.when(F.rlike("lemma", F.lit("[aeiouyåäö]$")), "n2").when(F.endswith("lemma", F.lit("s")), "v1").otherwise("n1")
    lemmas = _vocabulary(spark, d).select("lemma", chosen.alias("paradigm"), F.lit(None).cast("string").alias("kind"))
    return I.inflection_rows(I.inflect(lemmas, paradigms(spark))).select("lemma", "paradigm", "tag", "form")


@add("T9_inflection_tables", f"WITH {_VOCAB} SELECT lemma, CASE WHEN {_CHOSEN} = 'v1' THEN 4 ELSE 2 END AS headings, CASE WHEN {_CHOSEN} = 'v1' THEN 4 ELSE 2 END AS lines, CASE WHEN {_CHOSEN} = 'v1' THEN 4 ELSE 3 END AS forms FROM voc")
def inflection_tables(spark, d):
    chosen = F.when(F.rlike("lemma", F.lit("[aeiouyåäö]$")), "n2").when(F.endswith("lemma", F.lit("s")), "v1").otherwise("n1")
    lemmas = _vocabulary(spark, d).select("lemma", chosen.alias("paradigm"), F.lit(None).cast("string").alias("kind"))
    tables = I.inflect(lemmas, paradigms(spark)).select("lemma", I.table(F.col("forms")).alias("t"))
    lines = F.flatten(F.transform("t", lambda h: h["rows"]))
    return tables.select("lemma", F.size("t").alias("headings"), F.size(lines).alias("lines"), F.size(F.flatten(F.transform(lines, lambda r: r["preform"]))).alias("forms"))


@add("L14_match_paradigms", f"WITH {_VOCAB}, {_FORMS} SELECT lemma, name FROM f GROUP BY lemma, name HAVING bool_or(tag = 'SNI' AND form = lemma) AND NOT bool_or(form = lemma || 'an')")
def match_paradigms(spark, d):
    lemmas = _vocabulary(spark, d).select(
        "lemma", F.lit(None).cast("string").alias("kind"), F.concat("lemma", F.lit("|SNI")).alias("include"), F.concat("lemma", F.lit("an")).alias("exclude")
    )
    return I.match_paradigms(lemmas, paradigms(spark)).select("lemma", "name")


# ---------------------------------------------------------------- references: orders as dictionary entries

LEXICON = Spec.from_dict(
    {
        "resource_id": "lexicon",
        "fields": {
            "ortografi": {"type": "string"},
            "ordklass": {"type": "string"},
            "so": {
                "type": "object",
                "fields": {
                    "l_nr": {"type": "string"},
                    "homografNr": {"type": "integer"},
                    "text": {"type": "string"},
                    "huvudbetydelser": {
                        "type": "object",
                        "collection": True,
                        "fields": {
                            "x_nr": {"type": "string"},
                            "visas": {"type": "boolean"},
                            "hänvisningar": {"type": "object", "collection": True, "fields": {"hänvisning": {"type": "string"}}},
                        },
                    },
                },
            },
        },
        "sort": "ortografi",
    }
)


def lexicon(spark, d) -> DataFrame:
    """An order is an entry, its lines are senses that refer to their supplier, returned lines are not shown."""
    rows = T.order_rows(spark, d)
    sense = F.transform(
        "lines",
        lambda x: F.struct(
            x["part"].cast("string").alias("x_nr"),
            (x["flag"] != "R").alias("visas"),
            F.array(F.struct(F.concat(F.lit("lnr"), x["supplier"].cast("string")).alias("hänvisning"))).alias("hänvisningar"),
        ),
    )
    so = F.struct(
        F.col("code").cast("string").alias("l_nr"),
        F.col("customer").alias("homografNr"),
        F.concat(F.lit("se +kund(refid=kcnr"), F.col("customer").cast("string"), F.lit(") nu")).alias("text"),
        sense.alias("huvudbetydelser"),
    )
    rows = rows.select("code", F.col("priority").alias("ortografi"), F.col("status").alias("ordklass"), so.alias("so"))
    return as_entries(rows, LEXICON, F.col("code"))


_EDGES = f"""{T.SQL_LINES},
edges AS (SELECT CAST(code AS VARCHAR) AS id, 'so.lnr' || supplier AS ref, bool_or(flag <> 'R') AS visas FROM l GROUP BY ALL
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'so.kcnr' || o_custkey, TRUE FROM orders)"""


@add("L5_forward_references", f"WITH {_EDGES} SELECT id, ref, visas FROM edges")
def forward_references(spark, d):
    return R.forward_edges(lexicon(spark, d)).select("id", "ref", "visas")


@add("L6_backward_references", f"WITH {_EDGES} SELECT CAST(t.o_orderkey AS VARCHAR) AS id, ref, edges.id AS from_id, s.o_orderpriority AS ortografi, CAST(s.o_custkey AS VARCHAR) AS \"homografNr\", visas, FALSE AS subobject FROM edges JOIN orders t ON ref = 'so.lnr' || t.o_orderkey JOIN orders s ON CAST(s.o_orderkey AS VARCHAR) = edges.id")
def backward_references(spark, d):
    df = lexicon(spark, d)
    return R.backward_edges(df, R.forward_edges(df)).drop("resource")


@add("L6_backward_arrays", f"WITH {_EDGES} SELECT CAST(o_orderkey AS VARCHAR) AS id, 0 AS part, count(*) AS n, count(*) FILTER (visas) AS shown FROM edges JOIN orders ON ref = 'so.lnr' || o_orderkey GROUP BY o_orderkey")
def backward_arrays(spark, d):
    df = materialise(lexicon(spark, d), "lexicon")
    rows = R.backward_refs(df, R.forward_edges(df))
    return rows.select("id", "part", as_long(F.size("references"), "n"), as_long(F.size(F.filter("references", lambda r: r["visas"])), "shown"))


_DIRECTORY = f"""{T.SQL_LINES}, o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS entry_id FROM orders),
seen AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY pos) AS nr, count(*) OVER (PARTITION BY code) AS n FROM l WHERE flag <> 'R'),
dir AS (SELECT entry_id, 'so.lnr' || o_orderkey AS id, o_orderpriority AS ortografi, o_orderstatus AS ordklass, CAST(o_custkey AS VARCHAR) AS "homografNr", CAST(NULL AS VARCHAR) AS "huvudbetydelseNr" FROM o
  UNION ALL SELECT entry_id, 'so.xnr' || part, o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR), CASE WHEN n > 1 THEN CAST(nr AS VARCHAR) END FROM o JOIN seen ON code = o_orderkey)"""


@add("L7_id_directory", f"WITH {_DIRECTORY} SELECT * FROM dir")
def id_directory(spark, d):
    return R.id_info(lexicon(spark, d)).drop("resource", "ingångstyp")


@add("L8_reference_targets", f"WITH {_DIRECTORY}, edges AS (SELECT DISTINCT CAST(code AS VARCHAR) AS from_id, supplier FROM l WHERE flag <> 'R') SELECT from_id, CAST(supplier AS VARCHAR) AS id, ortografi, ordklass, \"homografNr\" FROM edges JOIN dir ON dir.id = 'so.lnr' || supplier")
def reference_targets(spark, d):
    df = lexicon(spark, d)
    info = R.reference_info(R.forward_edges(df), R.id_info(df), "so.lnr")
    return info.select("from_id", "id", "ortografi", "ordklass", "homografNr")


@add("T11_reference_codes", "SELECT l_orderkey AS code, l_partkey AS part, CASE l_returnflag WHEN 'R' THEN 'so.lnr' WHEN 'A' THEN 'so.xnr' ELSE 'so.kcnr' END || l_partkey AS ref, CASE l_returnflag WHEN 'R' THEN 'SAOL_LNR' WHEN 'A' THEN 'SAOL_XNR' ELSE 'KCNR' END AS kind FROM lineitem")
def reference_codes(spark, d):
    prefix = F.when(F.col("l_returnflag") == "R", "lnr").when(F.col("l_returnflag") == "A", "xnr").otherwise("kcnr")
    rows = T.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("code"), F.col("l_partkey").alias("part"), F.concat(prefix, F.col("l_partkey").cast("string")).alias("written"))
    parsed = rows.select("code", "part", R.parse_ref(F.col("written"), "so").alias("so"), R.parse_ref(F.col("written"), "saol").alias("saol"))
    return parsed.select("code", "part", R.format_ref(F.col("so.kind"), F.col("so.ref")).alias("ref"), F.col("saol.kind").alias("kind"))


@add("T10_sense_text", "SELECT p_partkey AS code, CASE WHEN p_size >= 5 THEN p_name || ' ' || p_brand || ' ' || p_type || CASE WHEN p_size > 20 THEN ' ' || p_name ELSE '' END END AS text FROM part")
def sense_text(spark, d):
    sub = F.array(F.struct(F.lit("").alias("definition"), F.col("p_name").alias("definitionstillägg"), (F.col("p_size") > 20).alias("visas")))
    sense = F.struct(F.concat(F.lit("[i "), "p_type", F.lit("]")).alias("definition"), (F.col("p_size") >= 5).alias("visas"), sub.alias("underbetydelser"))
    rows = T.load(spark, d, "part").select(F.col("p_partkey").alias("code"), "p_name", "p_brand", sense.alias("s"))
    made = R.sense_text(F.col("p_name"), F.col("p_brand"), F.col("s"), rows.schema["s"].dataType)
    return rows.select("code", F.trim(F.regexp_replace(made, " +", " ")).alias("text"))


# ---------------------------------------------------------------- spelling and neighbours


@add("L9_words_not_found", f"WITH c AS (SELECT DISTINCT unnest({T.sql_words('text')}) AS word FROM conversations), v AS (SELECT DISTINCT unnest({T.sql_words('text')}) AS word FROM documents) SELECT word FROM c WHERE word NOT IN (SELECT word FROM v)")
def words_not_found(spark, d):
    words = T.load(spark, d, "conversations").select(F.explode(F.array_distinct(text.analyze(F.col("text")))).alias("word"))
    return L.not_found(words, T.documents(spark, d), ["text"], max_words=1)


@add("L9_phrases_not_found", "SELECT DISTINCT p_name || ' ' || lower(p_type) AS word FROM part EXCEPT SELECT p_name || ' ' || lower(p_type) FROM part WHERE p_size > 30")
def phrases_not_found(spark, d):
    rows = T.load(spark, d, "part")
    words = rows.select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("word"))
    texts = rows.filter("p_size > 30").select(F.col("p_partkey").alias("code"), F.concat_ws(" ", F.lit("The"), "p_name", "p_type", F.lit("here")).alias("name"))
    spec = Spec.from_dict({"resource_id": "texts", "fields": {"code": {"type": "integer"}, "name": {"type": "string"}}})
    return L.not_found(words, as_entries(texts, spec, F.col("code")), ["name"])


@add(
    "L13_nearest_neighbours",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS rank FROM p QUALIFY rank <= 10""",
)
def nearest_neighbours(spark, d):
    vectors = T.load(spark, d, "embeddings").selectExpr("vec_id id", "label class", "embedding vector")
    return N.knn(vectors).select("id", "neighbour", "rank")


@add("L13_neighbours_in_near_cells", None)
def neighbours_in_near_cells(spark, d):
    vectors = T.load(spark, d, "embeddings").selectExpr("vec_id id", "label class", "embedding vector")
    return N.knn(vectors, probes=8).select("id", "neighbour", "similarity", "rank")


@add("L13_approximate_recall", "SELECT count(*) AS vectors, TRUE AS enough FROM embeddings a WHERE embedding IS NOT NULL AND (SELECT count(*) FROM embeddings b WHERE b.label = a.label) > 1")
def approximate_recall(spark, d):
    """The inverted file against the exact neighbours: with 300 cells, nine of ten are found. These vectors have no
    clusters, so a vector has to look into many cells."""
    vectors = T.load(spark, d, "embeddings").selectExpr("vec_id id", "label class", "embedding vector")
    measured = N.recall(N.approximate(vectors, cells=300, probes=192, groups=17), N.knn(vectors))
    return measured.select("vectors", (F.col("recall") >= 0.9).alias("enough"))
