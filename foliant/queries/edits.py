"""History, versions, differences, command batches, the catalog and permissions on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import commands as C
from foliant.operators import diff as X
from foliant.operators import history as H
from foliant.operators import lookups as L
from foliant.queries import tables as T
from foliant.queries.tables import as_long
from foliant.sources import catalog as K

QUERIES: dict[str, tuple] = {}


def add(name: str, sql: str | None):
    def put(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return put


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("entity_id", "version", "history_id", "body.value", "body.k")


SHOW = "entity_id, version, history_id, value, k"


@add("A8_latest_per_key", f"WITH {T.SQL_HEADS} SELECT {SHOW} FROM heads")
def latest_per_key(spark, d):
    return _flat(H.heads(T.history(spark, d)))


@add("V1_latest", f"WITH {T.SQL_HEADS} SELECT {SHOW} FROM heads WHERE NOT discarded")
def latest(spark, d):
    return _flat(H.latest(T.history(spark, d)))


@add("V2_deleted", f"WITH {T.SQL_HEADS} SELECT entity_id FROM heads WHERE discarded")
def deleted(spark, d):
    return H.deleted(T.history(spark, d))


# late in the events' month, so that entities differ in whether they changed since
LATE = 1706630000.0


@add("V3_changed_since", f"WITH {T.SQL_HEADS} SELECT {SHOW}, discarded FROM heads WHERE last_modified > {LATE}")
def changed_since(spark, d):
    hist = T.history(spark, d)
    kept = _flat(H.latest(hist, LATE)).withColumn("discarded", F.lit(False))
    gone = H.heads(hist.join(H.deleted(hist, LATE), "entity_id", "left_semi"))
    return kept.unionByName(_flat(gone).withColumn("discarded", F.lit(True)))


@add("V4_ids_newest_first", f"WITH {T.SQL_HEADS} SELECT entity_id, last_modified FROM heads WHERE NOT discarded ORDER BY last_modified DESC, entity_id")
def ids_newest_first(spark, d):
    return H.entity_ids(T.history(spark, d))


@add("A6_count_entries", f"WITH {T.SQL_HEADS} SELECT count(*) AS entries FROM heads WHERE NOT discarded")
def count_entries(spark, d):
    return H.count_entries(T.history(spark, d))


@add("A7_max_modified", "SELECT max(epoch_us(ts) / 1e6) AS last_modified FROM events")
def max_modified(spark, d):
    return H.max_modified(T.history(spark, d))


def _as_of(**kw):
    return lambda spark, d: _flat(H.as_of(T.history(spark, d), **kw))


QUERIES["V5_exact_version"] = (_as_of(version=3), f"WITH {T.SQL_HISTORY} SELECT {SHOW} FROM h WHERE version = 3")
QUERIES["V5_first_after"] = (
    _as_of(after=T.MIDDLE),
    f"WITH {T.SQL_HISTORY} SELECT {SHOW} FROM h WHERE last_modified >= {T.MIDDLE} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY last_modified, history_id) = 1",
)
QUERIES["V5_last_before"] = (
    _as_of(before=T.MIDDLE),
    f"WITH {T.SQL_HISTORY} SELECT {SHOW} FROM h WHERE last_modified <= {T.MIDDLE} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY last_modified DESC, history_id DESC) = 1",
)
QUERIES["V5_oldest"] = (_as_of(oldest=True), f"WITH {T.SQL_HISTORY} SELECT {SHOW} FROM h WHERE version = 1")
QUERIES["V5_newest"] = (_as_of(), f"WITH {T.SQL_HEADS} SELECT {SHOW} FROM heads")


@add("V6_history_filter", f"WITH {T.SQL_HISTORY} SELECT {SHOW} FROM h WHERE last_modified_by = 'signup' AND last_modified BETWEEN {T.MIDDLE} AND {LATE}")
def history_filter(spark, d):
    return _flat(H.history_filter(T.history(spark, d), user="signup", from_date=T.MIDDLE, to_date=LATE))


@add("V6_history_versions", f"WITH {T.SQL_HISTORY} SELECT {SHOW}, (SELECT count(*) FROM h WHERE entity_id = '7' AND version >= 5) AS total FROM h WHERE entity_id = '7' AND version >= 5 AND version < 1000 ORDER BY last_modified DESC LIMIT 100")
def history_versions(spark, d):
    rows, total = H.history(T.history(spark, d), entity="7", from_version=5, to_version=1000, from_date=9e9)
    return _flat(rows).withColumn("total", total.scalar())


# ---------------------------------------------------------------- differences

_LEAVES = {"value": "CAST({0}.value AS VARCHAR)", "k": "CAST({0}.k AS VARCHAR)", "kind": "{0}.kind"}


def _diff_sql(pairs: str, keys: str, a: str = "a", b: str = "b") -> str:
    each = []
    for name, cast in _LEAVES.items():
        before, after = cast.format(a), cast.format(b)
        kind = f"CASE WHEN {a}.{name} IS NULL THEN 'ADDED' WHEN {b}.{name} IS NULL THEN 'REMOVED' ELSE 'CHANGE' END"
        each.append(f"SELECT {keys}, {kind} AS type, '{name}' AS field, {before} AS before, {after} AS after FROM {pairs} WHERE {a}.{name} IS DISTINCT FROM {b}.{name}")
    return " UNION ALL ".join(each)


_CHAIN = "h b LEFT JOIN h a ON a.entity_id = b.entity_id AND a.version = b.version - 1"


@add("V7_history_diffs", f"WITH {T.SQL_HISTORY} " + _diff_sql(_CHAIN, "b.entity_id, b.version"))
def history_diffs(spark, d):
    return X.explode_changes(X.history_diffs(T.history(spark, d)), ["entity_id", "version"])


@add(
    "V7_page_diffs",
    f"WITH {T.SQL_HISTORY}, p AS (SELECT *, row_number() OVER (ORDER BY last_modified DESC, history_id DESC) AS r FROM h ORDER BY last_modified DESC, history_id DESC LIMIT 100) "
    + _diff_sql("p b LEFT JOIN p a ON a.r = b.r - 1", "b.history_id"),
)
def page_diffs(spark, d):
    return X.explode_changes(X.history_page_diffs(T.history(spark, d)), ["history_id"])


@add("V9_structural_diff", f"WITH {T.SQL_HISTORY} " + _diff_sql("h a JOIN h b ON a.entity_id = b.entity_id AND a.version = 1 AND b.version = 2", "b.entity_id"))
def structural_diff(spark, d):
    hist = T.history(spark, d)
    one = hist.filter("version = 1").select("entity_id", F.col("body").alias("a"))
    two = hist.filter("version = 2").select("entity_id", F.col("body").alias("b"))
    rows = one.join(two, "entity_id").select("entity_id", X.diff(F.col("a"), F.col("b"), hist.schema["body"].dataType).alias("diff"))
    return X.explode_changes(rows, ["entity_id"])


_FIRST = f"f AS (SELECT * FROM h WHERE last_modified >= {T.MIDDLE} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY last_modified, history_id) = 1)"


@add("V10_version_diff", f"WITH {T.SQL_HEADS}, {_FIRST} " + _diff_sql("f a JOIN heads b ON a.entity_id = b.entity_id", "a.entity_id, a.version AS from_version, b.version AS to_version"))
def version_diff(spark, d):
    return X.explode_changes(X.version_diff(T.history(spark, d), from_date=T.MIDDLE), ["entity_id", "from_version", "to_version"])


@add("V15_unique_versions", """SELECT CAST(user_id AS VARCHAR) AS entity_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS version, count(*) AS count FROM events GROUP BY ALL HAVING count(*) > 1""")
def unique_versions(spark, d):
    return H.check_unique(T.event_rows(spark, d).select("entity_id", F.col("body.k").alias("version")))


# ---------------------------------------------------------------- command batches
# the entity is a user and a tenth of k; the first half of the month is history, the rest arrives as commands


def _edit_rows(spark, d) -> DataFrame:
    rows = T.event_rows(spark, d)
    entity = F.concat_ws(":", "entity_id", F.floor(F.col("body.k") / 10).cast("string"))
    level = F.floor(F.col("body.value") / 40).cast("long")
    return rows.select("history_id", entity.alias("entity_id"), "last_modified", F.col("body.kind").alias("kind"), F.struct(level.alias("level")).alias("body"))


def base_history(spark, d) -> DataFrame:
    rows = H.with_versions(_edit_rows(spark, d).filter(F.col("last_modified") < T.MIDDLE))
    return rows.select(
        "history_id", "entity_id", "version", "last_modified", F.col("kind").alias("last_modified_by"), "body",
        F.lit("IN-PROGRESS").alias("status"), F.lit("").alias("message"), F.lit("UPDATED").alias("op"), (F.col("kind") == "error").alias("discarded"),
    )


def edit_commands(spark, d) -> DataFrame:
    """Errors delete, sign-ups add, everything else updates; the version each expects counts the earlier events."""
    rows = H.with_versions(_edit_rows(spark, d)).filter(F.col("last_modified") >= T.MIDDLE)
    kind = F.when(F.col("kind") == "error", C.DELETE).when(F.col("kind") == "signup", C.ADD).otherwise(C.UPDATE)
    return rows.select(
        F.col("history_id").alias("position"), kind.alias("cmdtype"), "entity_id", (F.col("version") - 1).cast("long").alias("version"),
        F.when(F.col("kind") != "error", F.col("body")).alias("body"), F.col("kind").alias("user"), F.lit("").alias("message"), "last_modified",
    )


_EDITS = f"""
e AS (SELECT event_id AS pos, user_id || ':' || CAST(floor(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) / 10) AS BIGINT) AS id,
  epoch_us(ts) / 1e6 AS t, event_type AS kind, CAST(floor(value / 40) AS BIGINT) AS level FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS expected FROM e),
base AS (SELECT id, count(*) AS version, arg_max(level, pos) AS level, arg_max(kind, pos) = 'error' AS dead FROM e WHERE t < {T.MIDDLE} GROUP BY id),
cmd AS (SELECT n.*, CASE kind WHEN 'error' THEN 'delete_entry' WHEN 'signup' THEN 'add_entry' ELSE 'update_entry' END AS cmdtype,
  base.version AS bversion, base.level AS blevel, coalesce(base.dead, FALSE) AS bdead FROM n LEFT JOIN base USING (id) WHERE t >= {T.MIDDLE}),
s AS (SELECT *,
  coalesce(max(CASE WHEN cmdtype = 'add_entry' THEN 1 ELSE 0 END) OVER w, 0) = 1 OR bversion IS NOT NULL AS known,
  coalesce(max(CASE WHEN cmdtype = 'delete_entry' THEN 1 ELSE 0 END) OVER w, 0) = 1 OR bdead AS dead,
  coalesce(last_value(CASE WHEN cmdtype <> 'delete_entry' THEN level END IGNORE NULLS) OVER w, blevel) AS before
  FROM cmd WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN cmdtype = 'add_entry' THEN 1 WHEN cmdtype = 'delete_entry' THEN CASE WHEN dead THEN 0 ELSE 1 END
  WHEN before IS DISTINCT FROM level THEN 1 ELSE 0 END AS eff FROM s),
v AS (SELECT *, coalesce(bversion, 0) + coalesce(sum(eff) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS now FROM f),
j AS (SELECT *, CASE WHEN cmdtype = 'add_entry' AND known THEN 'exists' WHEN cmdtype <> 'add_entry' AND NOT known THEN 'missing'
  WHEN cmdtype = 'update_entry' AND dead THEN 'discarded' WHEN cmdtype = 'update_entry' AND expected <> now THEN 'version'
  WHEN cmdtype = 'delete_entry' AND NOT dead AND expected <> now THEN 'version' END AS conflict FROM v)"""


@add("V8_command_conflicts", f"WITH {_EDITS} SELECT pos AS position, id AS entity_id, cmdtype, CAST(now AS BIGINT) AS current_version, conflict FROM j WHERE conflict IS NOT NULL")
def command_conflicts(spark, d):
    _, conflicts = C.apply_commands(base_history(spark, d), edit_commands(spark, d))
    return conflicts.select("position", "entity_id", "cmdtype", "current_version", "conflict")


@add(
    "V8_command_rows",
    f"WITH {_EDITS} SELECT pos AS position, id AS entity_id, CAST(now + 1 AS INTEGER) AS version, CASE WHEN cmdtype = 'delete_entry' THEN before ELSE level END AS level, "
    "CASE cmdtype WHEN 'add_entry' THEN 'ADDED' WHEN 'update_entry' THEN 'UPDATED' ELSE 'DELETED' END AS op, cmdtype = 'delete_entry' AS discarded FROM j WHERE conflict IS NULL AND eff = 1",
)
def command_rows(spark, d):
    rows, _ = C.apply_commands(base_history(spark, d), edit_commands(spark, d))
    return rows.select("position", "entity_id", "version", "body.level", "op", "discarded")


@add("V8_commands_over_chunks", QUERIES["V8_command_conflicts"][1])
def commands_over_chunks(spark, d):
    """The same batch cut into narrow position chunks, as one entity with very many commands would be."""
    _, conflicts = C.apply_commands(base_history(spark, d), edit_commands(spark, d), width=500)
    return conflicts.select("position", "entity_id", "cmdtype", "current_version", "conflict")


_ADDS = """
r AS (SELECT o_orderkey AS pos, CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN c_mktsegment ELSE 'OTHER' END AS seg, c_nationkey < 13 AS known, c_mktsegment AS kept
  FROM orders JOIN customer ON c_custkey = o_custkey),
q AS (SELECT *, CASE WHEN known THEN kept ELSE first_value(seg) OVER (PARTITION BY id ORDER BY pos) END AS wanted, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM r)"""


def _adds(spark, d):
    people = T.load(spark, d, "customer")
    body = F.struct(F.col("c_mktsegment").alias("seg"))
    first = people.filter("c_nationkey < 13").select(
        F.col("c_custkey").alias("history_id"), F.col("c_custkey").cast("string").alias("entity_id"), F.lit(1).alias("version"),
        F.lit(0.0).alias("last_modified"), F.lit("u").alias("last_modified_by"), body.alias("body"), F.lit("").alias("status"),
        F.lit("").alias("message"), F.lit("ADDED").alias("op"), F.lit(False).alias("discarded"),
    )
    orders = T.load(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    seg = F.when(F.col("o_orderstatus") == "F", F.col("c_mktsegment")).otherwise("OTHER")
    rows = orders.select(F.col("o_orderkey").alias("position"), F.col("o_custkey").cast("string").alias("entity_id"), F.struct(seg.alias("seg")).alias("body"))
    return C.add_entries(first, rows)


@add("V11_idempotent_adds", f"WITH {_ADDS} SELECT pos AS position, id AS entity_id, seg FROM q WHERE NOT known AND n = 1")
def idempotent_adds(spark, d):
    return _adds(spark, d)[0].select("position", "entity_id", "body.seg")


@add("V11_add_conflicts", f"WITH {_ADDS} SELECT pos AS position, id AS entity_id, 61 AS code FROM q WHERE seg <> wanted")
def add_conflicts(spark, d):
    return _adds(spark, d)[1]


# ---------------------------------------------------------------- catalog


@add("S7_list_resources", f"WITH {T.SQL_CATALOG} SELECT resource_id, version, name FROM now WHERE NOT discarded AND is_published AND (resource_id LIKE 'cust_1%' OR regexp_full_match(resource_id, 'cust_.7'))")
def list_resources(spark, d):
    return K.list_resources(T.catalog(spark, d), globs=["cust_1*", "cust_?7"]).select("resource_id", "version", "name")


@add("S7_list_all_resources", f"WITH {T.SQL_CATALOG} SELECT resource_id, version, is_published FROM now WHERE NOT discarded")
def list_all_resources(spark, d):
    return K.list_resources(T.catalog(spark, d), published=False).select("resource_id", "version", "is_published")


@add("S8_show_resource", f"WITH {T.SQL_CATALOG} SELECT resource_id, version, name, history_id, is_published FROM c WHERE version = 2")
def show_resource(spark, d):
    return K.show_resource(T.catalog(spark, d), None, 2).select("resource_id", "version", "name", "history_id", "is_published")


@add("L10_published", f"WITH {T.SQL_CATALOG} SELECT o_orderkey AS code FROM orders WHERE 'cust_' || o_custkey IN (SELECT resource_id FROM now WHERE NOT discarded AND is_published)")
def published(spark, d):
    df = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("code"), F.concat(F.lit("cust_"), "o_custkey").alias("resource"))
    return L.published(df, T.catalog(spark, d)).select("code")


def _orders_as(spark, d) -> DataFrame:
    """Order priorities stand for users, customers for collections."""
    level = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    user, resource = F.col("o_orderpriority").alias("user"), F.concat(F.lit("cust_"), "o_custkey").alias("resource_id")
    return T.load(spark, d, "orders").select(user, resource, level.alias("level"), "o_totalprice")


def _permitted(level: str):
    def run(spark, d):
        rows = _orders_as(spark, d)
        requests = rows.select("user", "resource_id").distinct()
        grants = rows.filter("o_totalprice > 350000").select("user", "resource_id", "level")
        return L.permitted(requests, grants, T.catalog(spark, d), level).select("user", "resource_id")

    return run


_GRANTS = """a AS (SELECT o_orderpriority AS "user", 'cust_' || o_custkey AS resource_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS level, o_totalprice > 350000 AS granted FROM orders),
q AS (SELECT "user", resource_id, coalesce(max(level) FILTER (granted), 0) AS level FROM a GROUP BY ALL)"""
QUERIES["L11_permitted_to_write"] = (
    _permitted("WRITE"),
    f'WITH {T.SQL_CATALOG}, {_GRANTS} SELECT "user", resource_id FROM q JOIN now USING (resource_id) WHERE NOT discarded AND level >= 2',
)
QUERIES["L11_permitted_to_read"] = (
    _permitted("READ"),
    f"WITH {T.SQL_CATALOG}, {_GRANTS} SELECT \"user\", resource_id FROM q JOIN now USING (resource_id) WHERE NOT discarded AND (level >= 1 OR protected IS DISTINCT FROM 'READ')",
)


@add("L12_protection", f"WITH {T.SQL_CATALOG} SELECT resource_id, protected FROM now WHERE NOT discarded AND is_published")
def protection(spark, d):
    return L.protection(T.catalog(spark, d))


_CHANGES = {"AUTOMOBILE": "create", "BUILDING": "publish", "FURNITURE": "unpublish", "HOUSEHOLD": "update", "MACHINERY": "delete"}
_CHANGE_SQL = " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in _CHANGES.items())
_CHANGED = f"""
ch AS (SELECT 'cust_' || c_custkey AS resource_id, CASE c_mktsegment {_CHANGE_SQL} END AS change, CASE WHEN c_nationkey < 5 THEN c_nationkey END AS asked FROM customer),
jj AS (SELECT ch.*, a.version, a.is_published, a.version IS NOT NULL AS known FROM ch LEFT JOIN (SELECT * FROM now WHERE NOT discarded) a USING (resource_id)),
kk AS (SELECT *, CASE WHEN change = 'create' AND known THEN 'exists' WHEN change <> 'create' AND NOT known THEN 'missing'
  WHEN change IN ('update', 'publish', 'unpublish') AND NOT (change = 'unpublish' AND NOT is_published) AND asked IS NOT NULL AND asked <> version THEN 'version' END AS error FROM jj)"""


def _changed(spark, d):
    change = F.coalesce(*[F.when(F.col("c_mktsegment") == s, c) for s, c in _CHANGES.items()])
    changes = T.load(spark, d, "customer").select(
        F.concat(F.lit("cust_"), "c_custkey").alias("resource_id"), change.alias("change"), F.when(F.col("c_nationkey") < 5, F.col("c_nationkey")).alias("version"),
        F.lit('{"new":1}').alias("config"), F.lit(None).cast("string").alias("name"), F.lit("me").alias("user"), F.lit(None).cast("string").alias("message"), F.lit(9.0).alias("last_modified"),
    )
    return K.resource_changes(T.catalog(spark, d), changes)


@add("V12_resource_changes", f"WITH {T.SQL_CATALOG}, {_CHANGED} SELECT resource_id, CASE WHEN change = 'create' THEN 1 ELSE version + 1 END AS version, CASE change WHEN 'publish' THEN TRUE WHEN 'update' THEN is_published ELSE FALSE END AS is_published FROM kk WHERE error IS NULL AND change <> 'delete' AND NOT (change = 'unpublish' AND NOT is_published)")
def resource_changes(spark, d):
    return _changed(spark, d)[0].select("resource_id", "version", "is_published")


@add("V12_resource_errors", f"WITH {T.SQL_CATALOG}, {_CHANGED} SELECT resource_id, change, error FROM kk WHERE error IS NOT NULL")
def resource_errors(spark, d):
    return _changed(spark, d)[1]


@add("V12_resource_forget", f"WITH {T.SQL_CATALOG}, {_CHANGED} SELECT resource_id, count(*) AS versions FROM c WHERE resource_id NOT IN (SELECT resource_id FROM kk WHERE change = 'delete' AND error IS NULL) GROUP BY resource_id")
def resource_forget(spark, d):
    left = K.forget(T.catalog(spark, d), _changed(spark, d)[2])
    return left.groupBy("resource_id").agg(as_long(F.count(F.lit(1)), "versions"))
