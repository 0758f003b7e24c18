"""The driver tables as collections, and the SQL fragments that say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators.collections import as_entries
from foliant.operators.history import with_versions
from foliant.plans.spec import Spec
from foliant.session import spread, tune


TEXTS = ("documents", "conversations", "pages")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark)
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    # texts are analysed word by word: worth all cores
    return spread(table) if name in TEXTS else table


# ---------------------------------------------------------------- flat collections

DOCUMENTS = Spec.from_dict(
    {
        "resource_id": "documents",
        "fields": {
            "text": {"type": "string"},
            "lang": {"type": "long_string"},
            "source": {"type": "long_string"},
            "n_chars": {"type": "integer"},
        },
        "sort": "n_chars",
    }
)
CUSTOMERS = Spec.from_dict(
    {
        "resource_id": "customers",
        "fields": {
            "code": {"type": "integer"},
            "name": {"type": "string"},
            "nation": {"type": "integer"},
            "balance": {"type": "number"},
            "segment": {"type": "string"},
        },
        "sort": "name",
        "id": "code",
    }
)
SUPPLIERS = Spec.from_dict(
    {
        "resource_id": "suppliers",
        "fields": {
            "code": {"type": "integer"},
            "name": {"type": "string"},
            "nation": {"type": "integer"},
            "balance": {"type": "number"},
        },
        "sort": "name",
        "id": "code",
    }
)
PARTS = Spec.from_dict(
    {
        "resource_id": "parts",
        "fields": {
            "code": {"type": "integer"},
            "name": {"type": "string"},
            "brand": {"type": "long_string"},
            "kind": {"type": "long_string"},
            "size": {"type": "integer"},
            "price": {"type": "number"},
        },
        "sort": ["name", "code"],
        "id": "code",
    }
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return as_entries(load(spark, folder, "documents"), DOCUMENTS, F.col("doc_id"))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "customer").selectExpr(
        "c_custkey code", "c_name name", "c_nationkey nation", "c_acctbal balance", "c_mktsegment segment"
    )
    return as_entries(rows, CUSTOMERS, F.col("code"))


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "supplier").selectExpr("s_suppkey code", "s_name name", "s_nationkey nation", "s_acctbal balance")
    return as_entries(rows, SUPPLIERS, F.col("code"))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "part").selectExpr(
        "p_partkey code", "p_name name", "p_brand brand", "p_type kind", "p_size size", "p_retailprice price"
    )
    return as_entries(rows, PARTS, F.col("code"))


# ---------------------------------------------------------------- orders with their line items inside

ORDERS = Spec.from_dict(
    {
        "resource_id": "orders",
        "fields": {
            "code": {"type": "integer", "required": True},
            "customer": {"type": "integer"},
            "status": {"type": "long_string"},
            "price": {"type": "number"},
            "priority": {"type": "string"},
            "lines": {
                "type": "object",
                "collection": True,
                "fields": {
                    "number": {"type": "integer"},
                    "part": {"type": "integer"},
                    "supplier": {"type": "integer"},
                    "quantity": {"type": "number"},
                    "amount": {"type": "number"},
                    "flag": {"type": "string"},
                    "state": {"type": "long_string"},
                },
            },
        },
        "sort": "code",
        "id": "code",
    }
)

LINE = "struct(l_linenumber number, l_partkey part, l_suppkey supplier, l_quantity quantity, l_extendedprice amount, l_returnflag flag, l_linestatus state)"


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the array of their lines, ordered by all line members. An order is one record.

    Both sides are joined where the shuffle by order has put them: the nested lines are far wider than their statistics
    say, so they are not offered for broadcasting, and all work on orders that follows runs in the shuffled tasks. Lines
    are sent as they are and gathered in the order of their orders, which the join goes on with.
    """
    lines = load(spark, folder, "lineitem").repartition("l_orderkey").sortWithinPartitions("l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.expr(f"collect_list({LINE})")).alias("lines"))
    orders = load(spark, folder, "orders")
    return orders.join(lines.hint("merge"), orders.o_orderkey == lines.l_orderkey, "left").selectExpr(
        "o_orderkey code", "o_custkey customer", "o_orderstatus status", "o_totalprice price", "o_orderpriority priority", "lines"
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return as_entries(order_rows(spark, folder), ORDERS, F.col("code"))


# lines with their position in the order
SQL_LINES = """
l AS (SELECT l_orderkey AS code, l_linenumber AS number, l_partkey AS part, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS amount,
  l_returnflag AS flag, l_linestatus AS state,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS pos
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""

# ---------------------------------------------------------------- events as a change log

EVENT_BODY = Spec.from_dict(
    {
        "resource_id": "users",
        "fields": {"value": {"type": "number"}, "k": {"type": "integer"}, "kind": {"type": "long_string"}},
        "sort": "k",
    }
)


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    body = F.struct(
        F.col("value").alias("value"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind")
    )
    return load(spark, folder, "events").select(
        F.col("event_id").alias("history_id"),
        F.col("user_id").cast("string").alias("entity_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last_modified"),
        F.col("event_type").alias("last_modified_by"),
        body.alias("body"),
        (F.col("event_type") == "error").alias("discarded"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Events as history: the entity is the user, an error deletes it."""
    rows = with_versions(event_rows(spark, folder))
    op = F.when(F.col("discarded"), "DELETED").when(F.col("version") == 1, "ADDED").otherwise("UPDATED")
    return rows.select(
        "history_id", "entity_id", "version", "last_modified", "last_modified_by", "body",
        F.lit("IN-PROGRESS").alias("status"), F.lit("").alias("message"), op.alias("op"), "discarded",
    )


# the middle of the events' month, as epoch seconds
MIDDLE = 1705320000.0

SQL_HISTORY = """
h AS (SELECT event_id AS history_id, CAST(user_id AS VARCHAR) AS entity_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS version,
  epoch_us(ts) / 1e6 AS last_modified, event_type AS last_modified_by, value,
  CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k, event_type AS kind, event_type = 'error' AS discarded,
  CASE WHEN event_type = 'error' THEN 'DELETED' WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'ADDED' ELSE 'UPDATED' END AS op
  FROM events)"""
SQL_HEADS = SQL_HISTORY + ",\nheads AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY history_id DESC) = 1)"

# ---------------------------------------------------------------- orders as the catalog's change log


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer stands for a collection and each order for a change of it."""
    rows = load(spark, folder, "orders").selectExpr(
        "o_orderkey history_id", "cast(o_custkey as string) entity_id", "concat('cust_', o_custkey) resource_id",
        "concat('Customer ', o_custkey) name", "concat('t', o_custkey) table_name",
        "case o_orderpriority when '1-URGENT' then '{\"protected\":{\"admin\":true}}' when '2-HIGH' then '{\"protected\":{\"write\":true}}'"
        " when '3-MEDIUM' then '{\"protected\":{\"read\":true}}' else '{}' end config",
        "o_orderstatus <> 'P' is_published", "unix_micros(cast(o_orderdate as timestamp)) / 1e6D last_modified", "o_orderpriority last_modified_by",
        "'' message", "'UPDATED' op", "o_orderstatus = 'P' and o_orderpriority = '5-LOW' discarded",
    )
    return with_versions(rows)


SQL_CATALOG = """
c AS (SELECT o_orderkey AS history_id, 'cust_' || o_custkey AS resource_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version, 'Customer ' || o_custkey AS name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ADMIN' WHEN '2-HIGH' THEN 'WRITE' WHEN '3-MEDIUM' THEN 'READ' END AS protected,
  o_orderstatus <> 'P' AS is_published, o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS discarded
  FROM orders),
now AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY history_id DESC) = 1)"""

# ---------------------------------------------------------------- words in SQL

_CLASSES = "".join(c.lower() for c in text.TO_AA + text.TO_AE + text.TO_OE)
_TARGETS = "å" * len(text.TO_AA) + "ä" * len(text.TO_AE) + "ö" * len(text.TO_OE)
_LETTER_JOINTS = {".": "", ":": "", "'": ""}
_DIGIT_JOINTS = {".": "", ",": "", ";": ""}


def sql_fold(col: str) -> str:
    out = f"translate(replace(lower({col}), '-', ''), '{_CLASSES}', '{_TARGETS}')"
    out = f"translate(strip_accents(translate({out}, 'åäö', '')), '', 'åäö')"
    return f"replace({out}, 'ß', 'ss')"


def sql_words(col: str) -> str:
    """The words of a text: marks between letters or digits are made part of the word, then put back."""
    out = sql_fold(col)
    for kind, joints in (("L", _LETTER_JOINTS), ("N", _DIGIT_JOINTS)):
        for mark, stand_in in joints.items():
            sign = "''" if mark == "'" else f"[{mark}]"
            for _ in range(2):
                out = f"regexp_replace({out}, '(\\p{{{kind}}}){sign}(\\p{{{kind}}})', '\\1{stand_in}\\2', 'g')"
    stand_ins = ""
    out = f"regexp_extract_all({out}, '[\\p{{L}}\\p{{N}}_{stand_ins}]+')"
    return f"list_transform({out}, lambda x: translate(x, '{stand_ins}', '.:'',;'))"


def sql_phrase(words: str, *wanted: str) -> str:
    """Whether a list of words holds a phrase, by position."""
    tests = [f"{words}[i + {n}] = '{w}'" if n else f"{words}[i] = '{w}'" for n, w in enumerate(wanted)]
    return f"len(list_filter(range(1, len({words}) + 1), lambda i: {' AND '.join(tests)})) > 0"


def as_long(col: str | Column, name: str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long").alias(name)
