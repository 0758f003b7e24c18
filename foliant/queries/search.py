"""Predicates, analysis, sorting, paging, counting and highlights on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import highlight as H
from foliant.operators import predicates as P
from foliant.operators import query as Q
from foliant.operators import stats as S
from foliant.operators.collections import as_entries, union_collections, with_metadata
from foliant.operators.history import as_of, latest
from foliant.plans.spec import Spec
from foliant.queries import tables as T

QUERIES: dict[str, tuple] = {}


def add(name: str, sql: str | None):
    def put(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return put


WORDS = f"w AS (SELECT doc_id, lang, n_chars, {T.sql_words('text')} AS words FROM documents)"


def _docs(spark: SparkSession, d: str, p: P.Predicate | None) -> DataFrame:
    return P.matching(T.documents(spark, d), p, T.DOCUMENTS).select(F.col("id").cast("long").alias("doc_id"))


def _orders(spark: SparkSession, d: str, p: P.Predicate | None) -> DataFrame:
    return P.matching(T.orders(spark, d), p, T.ORDERS).select(F.col("entry.code").alias("code"))


@add("P1_exists", f"WITH {T.SQL_LINES} SELECT DISTINCT code FROM l")
def exists(spark, d):
    return _orders(spark, d, P.exists("lines.part"))


@add("P2_missing", f"WITH {T.SQL_LINES} SELECT o_orderkey AS code FROM orders WHERE o_orderkey NOT IN (SELECT code FROM l WHERE flag IS NOT NULL)")
def missing(spark, d):
    return _orders(spark, d, P.missing("lines.flag"))


@add("P3_equals_phrase", f"WITH {WORDS} SELECT doc_id FROM w WHERE {T.sql_phrase('words', 'of', 'the')}")
def equals_phrase(spark, d):
    return _docs(spark, d, P.equals("text", "Of the"))


@add("P3_equals_word", f"WITH {WORDS} SELECT doc_id FROM w WHERE list_contains(words, 'que')")
def equals_word(spark, d):
    return _docs(spark, d, P.equals("text", "qué"))


@add("P4_equals_value", "SELECT o_orderkey AS code FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7 OR o_totalprice = 1000")
def equals_value(spark, d):
    return _orders(spark, d, P.or_(P.and_(P.equals("status", "F"), P.equals("customer", 7)), P.equals("price", 1000)))


@add("P5_regexp", f"WITH {WORDS} SELECT doc_id FROM w WHERE len(list_filter(words, lambda x: regexp_full_match(x, 'an[a-z]+er[eé]'))) > 0")
def regexp(spark, d):
    return _docs(spark, d, P.regexp("text", "an[a-z]+er[eé]"))


@add("P5_regexp_keyword", "SELECT doc_id FROM documents WHERE regexp_full_match(source, 'src1[0-4]')")
def regexp_keyword(spark, d):
    return _docs(spark, d, P.regexp("source", "src1[0-4]"))


@add("P6_contains", f"WITH {WORDS} SELECT doc_id FROM w WHERE len(list_filter(words, lambda x: contains(x, 'tionäre') OR contains(x, 'ouwh'))) > 0")
def contains(spark, d):
    return _docs(spark, d, P.or_(P.contains("text", "Tionäre"), P.contains("text", "ouwh")))


@add("P7_startswith", f"WITH {WORDS} SELECT doc_id FROM w WHERE len(list_filter(words, lambda x: starts_with(x, 'schü') OR starts_with(x, 'thstw'))) > 0")
def startswith(spark, d):
    return _docs(spark, d, P.or_(P.startswith("text", "schü"), P.startswith("text", "THSTW")))


@add("P8_endswith", f"WITH {WORDS} SELECT doc_id FROM w WHERE len(list_filter(words, lambda x: ends_with(x, 'lichen') OR ends_with(x, 'whre'))) > 0")
def endswith(spark, d):
    return _docs(spark, d, P.or_(P.endswith("text", "lichen"), P.endswith("text", "whre")))


@add("P9_ranges", "SELECT o_orderkey AS code FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000.5 AND o_orderstatus >= 'O' AND o_custkey < 500")
def ranges(spark, d):
    p = P.and_(P.gt("price", 100000), P.lte("price", 200000.5), P.gte("status", "O"), P.lt("customer", 500))
    return _orders(spark, d, p)


@add("P9_ranges_on_words", "SELECT p_partkey AS code FROM part WHERE split_part(p_name, ' ', 1) >= 'small' OR split_part(p_name, ' ', 2) >= 'small'")
def ranges_on_words(spark, d):
    return P.matching(T.parts(spark, d), P.gte("name", "small"), T.PARTS).select(F.col("entry.code").alias("code"))


@add(
    "P10_freetext",
    "SELECT c_custkey AS code FROM customer WHERE lower(c_mktsegment) = '19' OR lower(c_name) = '19' OR c_custkey = 19 OR c_nationkey = 19 OR c_acctbal = 19",
)
def freetext(spark, d):
    return P.matching(T.customers(spark, d), P.freetext("19"), T.CUSTOMERS).select(F.col("entry.code").alias("code"))


@add("P10_freetext_nested", f"WITH {T.SQL_LINES} SELECT DISTINCT code FROM l WHERE flag = 'R' OR state = 'r'")
def freetext_nested(spark, d):
    return _orders(spark, d, P.sub("lines", P.freetext("r")))


@add("P11_and", f"WITH {WORDS} SELECT doc_id FROM w WHERE lang = 'de' AND n_chars > 500 AND list_contains(words, 'der')")
def and_(spark, d):
    return _docs(spark, d, P.and_(P.equals("lang", "de"), P.gt("n_chars", 500), P.equals("text", "der")))


@add("P12_or", f"WITH {WORDS} SELECT doc_id FROM w WHERE lang = 'es' OR n_chars > 5000 OR list_contains(words, 'nicht')")
def or_(spark, d):
    return _docs(spark, d, P.or_(P.equals("lang", "es"), P.gt("n_chars", 5000), P.equals("text", "nicht")))


@add("P13_not", f"WITH {WORDS} SELECT doc_id FROM w WHERE NOT (coalesce(lang = 'en', FALSE) OR coalesce(list_contains(words, 'la'), FALSE))")
def not_(spark, d):
    return _docs(spark, d, P.not_(P.equals("lang", "en"), P.equals("text", "la")))


@add("P14_same_element", f"WITH {T.SQL_LINES} SELECT DISTINCT code FROM l WHERE flag = 'R' AND quantity > 40")
def same_element(spark, d):
    return _orders(spark, d, P.sub("lines", P.and_(P.equals("flag", "R"), P.gt("quantity", 40))))


@add(
    "P15_any_element",
    f"WITH {T.SQL_LINES} SELECT code FROM l WHERE flag = 'R' INTERSECT SELECT code FROM l WHERE quantity > 40",
)
def any_element(spark, d):
    return _orders(spark, d, P.and_(P.equals("lines.flag", "R"), P.gt("lines.quantity", 40)))


@add("P16_metadata", f"WITH {T.SQL_HEADS} SELECT entity_id, version FROM heads WHERE NOT discarded AND version >= 60 AND last_modified_by <> 'view' AND entity_id <> '7'")
def metadata(spark, d):
    rows = as_users(latest(T.history(spark, d)))
    p = P.and_(P.gte(P.meta("version"), 60), P.not_(P.equals(P.meta("last_modified_by"), "view"), P.equals(P.meta("id"), "7")))
    return P.matching(rows, p, T.EVENT_BODY).select(F.col("id").alias("entity_id"), "version")


def as_users(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.lit("users").alias("resource"), F.col("entity_id").alias("id"), "version", "last_modified", "last_modified_by", F.col("body").alias("entry")
    )


@add("P18_everything", "SELECT doc_id FROM documents")
def everything(spark, d):
    return _docs(spark, d, None)


# ---------------------------------------------------------------- text


@add("T1_analyze", f"WITH {WORDS}, e AS (SELECT doc_id, unnest(words) AS word FROM w) SELECT word, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM e GROUP BY word")
def analyze(spark, d):
    # occurrences are counted per document first, so documents need no distinct
    counts = T.load(spark, d, "documents").select("doc_id", F.explode(text.analyze(F.col("text"))).alias("word"))
    per = counts.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("documents"))


@add("T2_raw_values", "SELECT p_name AS value, count(*) AS count FROM part GROUP BY p_name")
def raw_values(spark, d):
    return S.statistics(T.parts(spark, d), "name", T.PARTS)


@add(
    "T3_swedish_order",
    f"WITH {WORDS}, e AS (SELECT DISTINCT unnest(words) AS word FROM w) SELECT word FROM e ORDER BY word COLLATE sv DESC LIMIT 200",
)
def swedish_order(spark, d):
    words = T.load(spark, d, "documents").select(F.explode(F.array_distinct(text.analyze(F.col("text")))).alias("word")).distinct()
    return words.orderBy(text.sv_sort(F.col("word")).desc()).limit(200)


@add("T4_highlight", "SELECT p_partkey AS code, 'name' AS field, regexp_replace(p_name, '\\bring\\b', '<em>ring</em>', 'g') AS fragment FROM part WHERE regexp_matches(p_name, '\\bring\\b')")
def highlight(spark, d):
    p = P.equals("name", "Ring")
    hits = H.highlight(P.matching(T.parts(spark, d), p, T.PARTS), p, T.PARTS)
    rows = hits.select(F.col("entry.code").alias("code"), F.explode("highlight").alias("field", "fragments"))
    return rows.select("code", "field", F.get("fragments", F.lit(0)).alias("fragment"))


@add("T4_highlight_regexp", "SELECT p_partkey AS code, 'name' AS field, regexp_replace(p_name, '([\\p{L}\\p{N}_]*n[\\p{L}\\p{N}_]*)', '<em>\\1</em>', 'g') AS fragment FROM part WHERE regexp_matches(p_name, 'n')")
def highlight_regexp(spark, d):
    """Words without a digit that hold an n: what the pattern finds is what is marked."""
    p = P.regexp("name", r"\D*N\D*")
    hits = H.highlight(P.matching(T.parts(spark, d), p, T.PARTS), p, T.PARTS)
    rows = hits.select(F.col("entry.code").alias("code"), F.explode("highlight").alias("field", "fragments"))
    return rows.select("code", "field", F.get("fragments", F.lit(0)).alias("fragment"))


@add("T5_highlight_positions", f"WITH {T.SQL_LINES} SELECT code, 'lines[' || pos || '].flag' AS field, '<em>R</em>' AS fragment FROM l WHERE flag = 'R'")
def highlight_positions(spark, d):
    p = P.sub("lines", P.equals("flag", "r"))
    hits = H.highlight(P.matching(T.orders(spark, d), p, T.ORDERS), p, T.ORDERS, positions=True)
    rows = hits.select(F.col("entry.code").alias("code"), F.explode("highlight").alias("field", "fragments"))
    return rows.select("code", "field", F.get("fragments", F.lit(0)).alias("fragment"))


# ---------------------------------------------------------------- order and pages


@add("O1_sort", "SELECT c_custkey AS code, c_mktsegment AS segment, c_acctbal AS balance FROM customer ORDER BY c_mktsegment DESC, c_acctbal, CAST(c_custkey AS VARCHAR) LIMIT 40")
def sort(spark, d):
    hits = Q.query(T.customers(spark, d), T.CUSTOMERS, sort=["segment|desc", ("balance", "asc")], size=40).hits
    return hits.select("entry.code", "entry.segment", "entry.balance")


@add("O2_default_sort", "SELECT p_partkey AS code FROM part ORDER BY p_name, p_partkey LIMIT 25")
def default_sort(spark, d):
    return Q.query(T.parts(spark, d), T.PARTS).hits.select("entry.code")


@add("O3_sort_on_array", f"WITH {T.SQL_LINES}, m AS (SELECT code, max(amount) AS top FROM l GROUP BY code) SELECT o_orderkey AS code FROM orders LEFT JOIN m ON code = o_orderkey ORDER BY top DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) LIMIT 30")
def sort_on_array(spark, d):
    return Q.query(T.orders(spark, d), T.ORDERS, sort=["lines.amount|desc"], size=30).hits.select("entry.code")


@add("O4_page", "SELECT o_orderkey AS code FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET 100")
def page(spark, d):
    return Q.query(T.orders(spark, d), T.ORDERS, P.equals("status", "F"), sort=["price|desc"], from_=100).hits.select("entry.code")


@add("O5_unbounded", "SELECT o_orderkey AS code FROM orders WHERE o_totalprice > 250000")
def unbounded(spark, d):
    return Q.query(T.orders(spark, d), T.ORDERS, P.gt("price", 250000), size=None).hits.select("entry.code")


@add("O6_history_page", f"WITH {T.SQL_HISTORY} SELECT history_id, entity_id, version, op, (SELECT count(*) FROM h WHERE last_modified_by = 'purchase') AS total FROM h WHERE last_modified_by = 'purchase' ORDER BY last_modified DESC, history_id DESC LIMIT 100 OFFSET 200")
def history_page(spark, d):
    from foliant.operators.history import history

    rows, total = history(T.history(spark, d), page=2, user="purchase")
    return rows.select("history_id", "entity_id", "version", "op").withColumn("total", total.scalar())


# ---------------------------------------------------------------- counts


@add("A1_total", f"WITH {WORDS} SELECT count(*) AS total FROM w WHERE list_contains(words, 'the')")
def total(spark, d):
    return Q.query(T.documents(spark, d), T.DOCUMENTS, P.equals("text", "the")).total


def _both(spark, d):
    specs = [T.CUSTOMERS, T.SUPPLIERS]
    return union_collections([(T.customers(spark, d), specs[0]), (T.suppliers(spark, d), specs[1])]), specs


@add(
    "A2_distribution",
    "SELECT 'customers' AS resource, count(*) AS count FROM customer WHERE c_acctbal > 5000 HAVING count(*) > 0 UNION ALL SELECT 'suppliers', count(*) FROM supplier WHERE s_acctbal > 5000 HAVING count(*) > 0",
)
def distribution(spark, d):
    df, specs = _both(spark, d)
    return Q.query(df, specs, P.gt("balance", 5000)).distribution


@add("A3_statistics", "SELECT source AS value, count(*) AS count FROM documents GROUP BY source")
def statistics(spark, d):
    return S.statistics(T.documents(spark, d), "source", T.DOCUMENTS)


@add("A4_statistics_nested", f"WITH {T.SQL_LINES} SELECT supplier AS value, count(DISTINCT code) AS count FROM l GROUP BY supplier")
def statistics_nested(spark, d):
    return S.statistics(T.orders(spark, d), "lines.supplier", T.ORDERS)


@add("A5_bucket_guard", f"WITH {T.SQL_LINES} SELECT quantity AS value, count(DISTINCT code) AS count FROM l GROUP BY quantity")
def bucket_guard(spark, d):
    counts = S.value_counts(T.orders(spark, d), "lines.quantity")
    S.check_values(counts)
    return counts


@add("U1_union", "SELECT 'customers' AS resource, c_custkey AS code, c_name AS name FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def union(spark, d):
    df, specs = _both(spark, d)
    return P.matching(df, P.equals("nation", 3), specs).select("resource", "entry.code", "entry.name")


@add("J14_metadata", f"WITH {T.SQL_HEADS} SELECT 'users' AS resource, entity_id AS id, last_modified_by, last_modified, version, k FROM heads WHERE NOT discarded")
def attach_metadata(spark, d):
    hits = with_metadata(as_users(latest(T.history(spark, d))))
    return hits.select("resource", "id", "last_modified_by", "last_modified", "version", "entry.k")


# ---------------------------------------------------------------- the flagship

FLAGSHIP_SQL = f"""
WITH {WORDS} SELECT doc_id, n_chars, count(*) OVER () AS total FROM w WHERE lang = 'de' AND {T.sql_phrase('words', 'der', 'die')}
ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR) LIMIT 25"""


@add("phrase_page_with_total", FLAGSHIP_SQL)
def flagship(spark, d):
    """German documents that hold a phrase: the longest, with the exact total."""
    found = Q.query(T.documents(spark, d), T.DOCUMENTS, P.and_(P.equals("lang", "de"), P.equals("text", "der Die")), sort=["n_chars|desc"])
    hits = found.hits.select(F.col("id").cast("long").alias("doc_id"), "entry.n_chars")
    return hits.withColumn("total", found.total.scalar())


SHORT = Spec.from_dict({"resource_id": "turns", "fields": {"role": {"type": "long_string"}, "text": {"type": "string"}}, "sort": "role"})


@add("P3_phrase_in_conversations", f"WITH w AS (SELECT conv_id, turn, role, {T.sql_words('text')} AS words FROM conversations) SELECT conv_id, turn FROM w WHERE role = 'user' AND {T.sql_phrase('words', 'of', 'the')}")
def phrase_in_conversations(spark, d):
    turns = T.load(spark, d, "conversations")
    rows = as_entries(turns, SHORT, F.concat_ws(":", "conv_id", "turn"))
    hits = P.matching(rows, P.and_(P.equals("role", "user"), P.equals("text", "of the")), SHORT)
    key = F.split("id", ":")
    return hits.select(F.get(key, F.lit(0)).cast("long").alias("conv_id"), F.get(key, F.lit(1)).cast("long").alias("turn"))


@add("V5_as_of_each_user", f"WITH {T.SQL_HISTORY} SELECT entity_id, version, k FROM h WHERE last_modified <= {T.MIDDLE} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY last_modified DESC, history_id DESC) = 1")
def as_of_each_user(spark, d):
    users = T.load(spark, d, "events").select(F.col("user_id").cast("string").alias("entity_id")).distinct()
    return as_of(T.history(spark, d), users, before=T.MIDDLE).select("entity_id", "version", "body.k")
