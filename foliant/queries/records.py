"""Paths, nested columns, derived columns, lookups and validation on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import paths as P
from foliant.functions.ids import normalise_ts, with_ulid
from foliant.operators import derive as D
from foliant.operators import lookups as L
from foliant.operators import predicates as W
from foliant.operators import query as Q
from foliant.operators import records as R
from foliant.operators import validate as V
from foliant.operators.collections import as_entries, hide_unstored
from foliant.operators.grouped import grouped_apply
from foliant.plans.spec import Field, Spec
from foliant.queries import tables as T
from foliant.queries.tables import as_long

QUERIES: dict[str, tuple] = {}


def add(name: str, sql: str | None):
    def put(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return put


def code():
    return F.col("entry").getField("code").alias("code")


def numbers(col):
    """Sum of an array of doubles that hold whole numbers."""
    return F.aggregate(col, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


# ---------------------------------------------------------------- paths


@add("J1_get_path", f"WITH {T.SQL_LINES} SELECT o_orderkey AS code, max(quantity) AS top, min(quantity) AS low, max(CASE WHEN pos = 1 THEN part END) AS second FROM orders LEFT JOIN l ON code = o_orderkey GROUP BY o_orderkey")
def get_path(spark, d):
    df = T.orders(spark, d)
    values = P.get_path(df, "entry.lines.quantity")
    second = P.get_path(df, ["entry", "lines", 1, "part"])
    return df.select(code(), F.array_max(values).alias("top"), F.array_min(values).alias("low"), second.alias("second"))


@add("J2_set_path", f"WITH {T.SQL_LINES} SELECT code, sum(CASE WHEN pos = 0 THEN 1000 ELSE quantity END) AS total FROM l GROUP BY code")
def set_path(spark, d):
    df = P.set_path(T.orders(spark, d), ["entry", "lines", 0, "quantity"], F.lit(1000.0))
    return df.filter("entry.lines IS NOT NULL").select(code(), numbers(P.get_path(df, "entry.lines.quantity")).alias("total"))


@add("J3_del_path", f"WITH {T.SQL_LINES} SELECT code, count(*) AS lines, sum(quantity) AS total FROM l WHERE pos > 0 GROUP BY code")
def del_path(spark, d):
    df = P.del_path(P.del_path(T.orders(spark, d), ["entry", "lines", 0]), "entry.lines.amount")
    assert P.type_at(df.schema["entry"].dataType, "lines.amount") is None
    return df.filter("size(entry.lines) > 0").select(code(), as_long(F.size("entry.lines"), "lines"), numbers(P.get_path(df, "entry.lines.quantity")).alias("total"))


@add("J4_prune", f"WITH {T.SQL_LINES} SELECT code, count(*) AS lines, sum(quantity) AS total FROM l WHERE flag <> 'R' AND quantity <= 30 GROUP BY code")
def prune(spark, d):
    df = T.orders(spark, d)

    def keep(path, value, dtype):
        return (value["flag"] != "R") & (value["quantity"] <= 30) if path == ("lines",) and "flag" in dtype.simpleString() and not dtype.simpleString().startswith("array") else None

    pruned = df.withColumn("entry", P.prune(F.col("entry"), df.schema["entry"].dataType, keep))
    return pruned.filter("size(entry.lines) > 0").select(code(), as_long(F.size("entry.lines"), "lines"), numbers(F.col("entry.lines.quantity")).alias("total"))


ORDER_PATHS = f"""WITH {T.SQL_LINES},
p AS (SELECT o_orderkey AS code, 'code' AS field, CAST(o_orderkey AS VARCHAR) AS value, '' AS pos FROM orders
  UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS VARCHAR), '' FROM orders
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, '' FROM orders
  UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, '' FROM orders
  UNION ALL SELECT o_orderkey, 'price', CAST(o_totalprice AS VARCHAR), '' FROM orders
  UNION ALL SELECT code, 'lines.number', CAST(number AS VARCHAR), CAST(pos AS VARCHAR) FROM l
  UNION ALL SELECT code, 'lines.quantity', CAST(quantity AS VARCHAR), CAST(pos AS VARCHAR) FROM l
  UNION ALL SELECT code, 'lines.amount', CAST(amount AS VARCHAR), CAST(pos AS VARCHAR) FROM l
  UNION ALL SELECT code, 'lines.part', CAST(part AS VARCHAR), CAST(pos AS VARCHAR) FROM l
  UNION ALL SELECT code, 'lines.supplier', CAST(supplier AS VARCHAR), CAST(pos AS VARCHAR) FROM l
  UNION ALL SELECT code, 'lines.flag', flag, CAST(pos AS VARCHAR) FROM l
  UNION ALL SELECT code, 'lines.state', state, CAST(pos AS VARCHAR) FROM l)
"""


@add("J6_flatten_paths", ORDER_PATHS + "SELECT field, pos, count(*) AS n, count(DISTINCT value) AS kinds, min(value) AS low FROM p GROUP BY field, pos")
def flatten_paths(spark, d):
    rows = R.flatten_paths(T.orders(spark, d), ["id"])
    keyed = rows.withColumn("pos", F.coalesce(F.get("positions", F.lit(0)).cast("string"), F.lit("")))
    # distinct values by two aggregations with map-side combining
    per = keyed.groupBy("field", "pos", "value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("field", "pos").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("value").alias("low"))


@add("J6_flatten_extra", """SELECT 'k' AS field, regexp_extract(props, '"k": ([0-9]+)', 1) AS value, count(*) AS n FROM events GROUP BY ALL""")
def flatten_extra(spark, d):
    events = T.load(spark, d, "events").select("event_id", "props")
    return R.flatten_extra(events, ["event_id"], "props").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@add(
    "J7_field_inventory",
    f"""WITH {T.SQL_LINES}, m AS (SELECT count(*) AS n FROM orders), k AS (SELECT count(*) AS n, count(DISTINCT code) AS e FROM l)
SELECT unnest(['code','customer','status','price','priority']) AS field, n AS "values", n AS entries, TRUE AS declared FROM m
UNION ALL SELECT unnest(['lines.number','lines.part','lines.supplier','lines.quantity','lines.amount','lines.flag','lines.state']), n, e, TRUE FROM k
UNION ALL SELECT 'lines', e, e, TRUE FROM k UNION ALL SELECT 'note', 0, 0, TRUE FROM k""",
)
def field_inventory(spark, d):
    spec = T.ORDERS.with_fields({**T.ORDERS.fields, "note": Field(type="string")})
    return R.field_inventory(T.orders(spark, d), spec)


@add("J8_explode_path", f"WITH {T.SQL_LINES} SELECT code, 'lines.' || pos || '.flag' AS path, pos AS position, flag AS value FROM l")
def explode_path(spark, d):
    df = T.orders(spark, d).withColumn("code", F.col("entry.code"))
    rows = R.explode_path(df, "lines.flag", ["code"])
    return rows.select("code", "path", as_long(F.get("positions", F.lit(0)), "position"), "value")


@add("J9_has_path", f"WITH {T.SQL_LINES} SELECT o_orderkey AS code, count(code) > 0 AS has_lines, count(code) > 3 AS has_fourth FROM orders LEFT JOIN l ON code = o_orderkey GROUP BY o_orderkey")
def has_path(spark, d):
    df = T.orders(spark, d)
    return df.select(code(), P.has_path(df, "entry.lines.part").alias("has_lines"), P.has_path(df, "entry.lines.3.part").alias("has_fourth"))


@add("J10_rename", f"WITH {T.SQL_LINES} SELECT o_orderkey AS code, o_orderstatus AS state, o_custkey AS owner, count(CASE WHEN flag = 'R' THEN 1 END) AS returned FROM orders LEFT JOIN l ON code = o_orderkey GROUP BY ALL")
def rename(spark, d):
    df = T.orders(spark, d)
    grouped = df.withColumn("entry", F.struct("entry.code", F.struct("entry.status", "entry.customer").alias("head"), "entry.lines"))
    moved = R.rename_field(R.rename_field(grouped, "head.status", "state"), "head.customer", "head.owner")
    moved = R.rename_field(moved, "lines.flag", "lines.mark")
    returned = F.size(F.filter(F.coalesce("entry.lines.mark", F.array().cast("array<string>")), lambda m: m == "R"))
    return moved.select(code(), "entry.state", F.col("entry.head.owner").alias("owner"), as_long(returned, "returned"))


@add("J11_default", """SELECT event_id, CASE WHEN value > 50 THEN -1 ELSE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) END AS k, 'none' AS note FROM events""")
def default(spark, d):
    rows = T.event_rows(spark, d).select(F.col("history_id").alias("event_id"), F.struct(F.when(F.col("body.value") <= 50, F.col("body.k")).alias("k")).alias("entry"))
    filled = R.add_default(R.add_default(rows, "k", -1), "note", "none")
    return filled.select("event_id", "entry.k", "entry.note")


@add("J12_replace_text", "SELECT p_partkey AS code, replace(replace(p_name, split_part(p_name, ' ', 1), p_type), 'ring', 'RING') AS name, replace(replace(p_type, split_part(p_name, ' ', 1), p_type), 'ring', 'RING') AS kind FROM part")
def replace_text(spark, d):
    df = T.parts(spark, d)
    first = F.get(F.split("entry.name", " "), F.lit(0))
    edits = df.select("id", F.lit(0).alias("pos"), first.alias("search"), F.col("entry.kind").alias("replace")).unionByName(
        df.select("id", F.lit(1).alias("pos"), F.lit("ring").alias("search"), F.lit("RING").alias("replace"))
    )
    return R.replace_text(df, edits).select("entry.code", "entry.name", "entry.kind")


@add("J13_project", "SELECT o_orderpriority AS value FROM orders WHERE o_totalprice > 300000")
def project(spark, d):
    return Q.query(T.orders(spark, d), T.ORDERS, W.gt("price", 300000), size=None, path="entry.priority").hits


@add("J15_unstored", "SELECT o_orderkey AS code, o_orderstatus AS status FROM orders WHERE o_totalprice > 200000")
def unstored(spark, d):
    fields = {**T.ORDERS.fields, "price": Field(type="number", store=False), "lines": Field(type="object", collection=True, store=False, fields=T.ORDERS.fields["lines"].fields)}
    spec = T.ORDERS.with_fields(fields)
    hits = hide_unstored(W.matching(T.orders(spark, d), W.gt("price", 200000), spec), spec)
    assert hits.schema["entry"].dataType.fieldNames() == ["code", "customer", "status", "priority"]
    return hits.select("entry.code", "entry.status")


@add("J18_flatten_nested_lists", f"WITH {T.SQL_LINES} SELECT code, 2 * count(*) AS n, sum(part) + sum(supplier) AS total FROM l GROUP BY code")
def flatten_nested_lists(spark, d):
    df = T.orders(spark, d).filter("entry.lines IS NOT NULL")
    pairs = F.transform("entry.lines", lambda x: F.array(F.array(x["part"]), F.array(x["supplier"])))
    df = df.select(code(), pairs.alias("nested"))
    flat = P.flatten_all(F.col("nested"), df.schema["nested"].dataType)
    return df.select("code", as_long(F.size(flat), "n"), F.aggregate(flat, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@add("J19_visible", f"WITH {T.SQL_LINES} SELECT code, count(CASE WHEN flag <> 'R' THEN 1 END) AS shown, count(CASE WHEN flag <> 'R' AND state <> 'O' THEN 1 END) AS printed FROM l GROUP BY code")
def visible(spark, d):
    df = T.orders(spark, d).filter("entry.lines IS NOT NULL")
    marked = F.transform("entry.lines", lambda x: F.struct(x["part"].alias("part"), (x["flag"] != "R").alias("visas"), (x["state"] == "O").alias("endastDigitalt")))
    df = df.withColumn("entry", F.struct("entry.code", marked.alias("lines")))
    dtype = df.schema["entry"].dataType
    return df.select(
        code(),
        as_long(F.size(P.visible(F.col("entry"), dtype)["lines"]), "shown"),
        as_long(F.size(P.visible(F.col("entry"), dtype, printed=True)["lines"]), "printed"),
    )


# ---------------------------------------------------------------- ids and times


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


@add(
    "S3_sortable_ids",
    f"""WITH t AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1e6 * 1000) AS BIGINT) AS ms FROM events)
    SELECT event_id, 26 AS length, TRUE AS wellformed, TRUE AS alone, array_to_string(list_transform(range(9, -1, -1), lambda i: substr('{_CROCKFORD}', ((ms >> (5 * i)) & 31) + 1, 1)), '') AS time,
    rank() OVER (ORDER BY ms) AS place FROM t""",
)
def sortable_ids(spark, d):
    """An id for each event: its time in the first ten places, by which ids sort, and no id twice."""
    from pyspark.sql import Window

    events = T.load(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    made = with_ulid(events, F.col("t"), [F.col("event_id")])
    times = F.substring("id", 1, 10)
    # places by the ids of a time, of which there are fewer than events
    before = made.groupBy(times.alias("time")).agg(F.count(F.lit(1)).alias("n"))
    place = (F.sum("n").over(Window.orderBy("time")) - F.col("n") + 1).alias("place")
    twice = made.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    shown = made.join(twice, "id").select("event_id", F.length("id").alias("length"), F.rlike("id", F.lit(f"^[{_CROCKFORD}]{{26}}$")).alias("wellformed"), (F.col("times") == 1).alias("alone"), times.alias("time"))
    return shown.join(before.select("time", place), "time")


@add("S14_timestamps", "SELECT event_id, CASE WHEN event_type = 'signup' THEN -1 ELSE epoch_us(ts) / 1e6 END AS last_modified FROM events")
def timestamps(spark, d):
    events = T.load(spark, d, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("string")
    written = F.when(F.col("event_type") == "click", seconds).when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("ts").cast("string"))
    done = normalise_ts(events.select("event_id", "event_type", written.alias("last_modified")))
    # a missing time is that of the job, the same for all rows
    now = F.unix_micros(F.current_timestamp()) / 1e6
    recent = (F.col("last_modified") <= now) & (F.col("last_modified") > now - 600)
    return done.select("event_id", F.when((F.col("event_type") == "signup") & recent, -1.0).otherwise(F.col("last_modified")).alias("last_modified"))


# ---------------------------------------------------------------- validation

RECORD = Spec.from_dict(
    {
        "resource_id": "records",
        "fields": {
            "kind": {"type": "string", "required": True},
            "value": {"type": "number"},
            "k": {"type": "integer"},
            "tags": {"type": "string", "collection": True},
            "rows": {"type": "object", "collection": True, "fields": {"n": {"type": "integer", "required": True}}},
            "_made": {"virtual": True, "plugin": "copy", "params": {"config": {"type": "integer"}}, "field_params": {"value": "k"}},
        },
        "additional_properties": False,
    }
)
# events written as JSON; each event type breaks the spec in its own way when k is large
_RAW = """
case when event_type = 'click' and k >= 50 then concat('{"kind":', k, ',"k":"', k, '"}')
     when event_type = 'view' and k >= 50 then concat('{"value":', value, ',"rows":[{"n":1},{"m":2}]}')
     when event_type = 'signup' and k >= 50 then '{"kind":"a","tags":"x","rows":[{"n":1.5}]}'
     when event_type = 'purchase' and k >= 50 then concat('{"kind":"a","_made":', k, '}')
     when event_type = 'error' and k >= 50 then concat('{"kind":"a","other":', k, ',"k":', k, '}')
     else concat('{"kind":"', event_type, '","value":', value, ',"k":', k, ',"tags":["', event_type, '"],"rows":[{"n":', k, '}]}') end"""
_WRONG = {
    "Q1_types": ("click", ["k must be integer", "kind must be string"]),
    "Q2_required": ("view", ["kind is required", "rows[].n is required"]),
    "Q3_collections": ("signup", ["rows[].n must be integer", "tags must be array"]),
    "Q4_derived": ("purchase", ["_made must not be given"]),
    "Q5_unknown": ("error", ["other is not declared"]),
}
_K = """CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT)"""


def raw_events(spark, d) -> DataFrame:
    rows = T.load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select("event_id", "event_type", F.expr(_RAW).alias("raw"))


def _rule(messages: list[str]):
    """The problems of one rule, over all events."""

    def run(spark, d):
        of_rule = F.array_intersect("problems", F.array(*map(F.lit, messages)))
        return V.check(raw_events(spark, d), RECORD).select("event_id", F.array_join(F.array_sort(of_rule), "; ").alias("problems"))

    return run


for _name, (_kind, _messages) in _WRONG.items():
    QUERIES[_name] = (
        _rule(_messages),
        f"SELECT event_id, CASE WHEN {_K} >= 50 AND event_type = '{_kind}' THEN '{'; '.join(_messages)}' ELSE '' END AS problems FROM events",
    )


@add("S6_validate", f"SELECT event_type, count(*) FILTER ({_K} < 50) AS valid, count(*) FILTER ({_K} >= 50) AS invalid FROM events GROUP BY event_type")
def validate(spark, d):
    good, bad = V.validate(raw_events(spark, d), RECORD)
    both = good.select("event_type", F.lit(1).alias("ok")).unionByName(bad.select("event_type", F.lit(0).alias("ok")))
    return both.groupBy("event_type").agg(F.sum("ok").alias("valid"), F.sum(1 - F.col("ok")).alias("invalid"))


# ---------------------------------------------------------------- lookups


@add("L1_batched_lookup", "SELECT c_custkey AS query, o_orderkey AS code FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def batched_lookup(spark, d):
    keys = T.load(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.col("c_custkey").alias("value"))
    return L.multi_lookup(keys, T.orders(spark, d), "customer").select("query", F.col("hit.entry.code").alias("code"))


@add("L2_link", "SELECT o_orderkey AS code, CASE WHEN c_custkey IS NULL THEN 'not found' END AS error, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def link(spark, d):
    linked = L.link(T.orders(spark, d), T.customers(spark, d), "customer", "code")
    return linked.select(code(), "link.error", F.col("link.entry.name").alias("name"))


@add(
    "L2_link_errors",
    "WITH s AS (SELECT s_nationkey AS n, count(*) AS c, min(s_name) AS name FROM supplier GROUP BY 1) SELECT c_custkey AS code, CASE WHEN coalesce(c, 0) = 0 THEN 'not found' WHEN c > 1 THEN 'multiple matches' END AS error, CASE WHEN c = 1 THEN name END AS name FROM customer LEFT JOIN s ON n = c_nationkey",
)
def link_errors(spark, d):
    linked = L.link(T.customers(spark, d), T.suppliers(spark, d), "nation", "nation")
    return linked.select(code(), "link.error", F.col("link.entry.name").alias("name"))


@add("L3_backlink", "SELECT c_custkey AS code, 0 AS part, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def backlink(spark, d):
    linked = L.backlink(T.customers(spark, d), T.orders(spark, d), "customer", "code", "code")
    return linked.select(code(), "part", F.array_join("backlinks", ",").alias("orders"))


@add("L3_backlink_edges", f"WITH {T.SQL_LINES} SELECT DISTINCT supplier AS ref, code AS value FROM l")
def backlink_edges(spark, d):
    return L.backlink_edges(T.orders(spark, d), "lines.supplier", "code")


NATIONS = Spec.from_dict({"resource_id": "regions", "fields": {"code": {"type": "integer"}, "name": {"type": "string"}}})


@add("L4_collect_resource", "SELECT s_suppkey AS code, 0 AS part, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS regions FROM supplier")
def collect_resource(spark, d):
    regions = as_entries(T.load(spark, d, "region").selectExpr("r_regionkey code", "r_name name"), NATIONS, F.col("code"))
    return L.collect_resource(T.suppliers(spark, d), regions, "name").select(code(), "part", F.array_join("values", ",").alias("regions"))


@add("L3_backlink_parts", "SELECT o_orderpriority AS status, count(*) AS n, TRUE AS bounded, TRUE AS spread FROM orders GROUP BY o_orderpriority")
def backlink_parts(spark, d):
    """A few entries that all orders refer to, with equal values: many parts of bounded size that hold all of them."""
    rows = T.load(spark, d, "orders").selectExpr("o_orderkey code", "o_orderpriority priority", "'same' status")
    spec = Spec.from_dict({"resource_id": "marks", "fields": {"code": {"type": "integer"}, "priority": {"type": "string"}, "status": {"type": "string"}}})
    entries = as_entries(rows, spec, F.col("code"))
    first = as_entries(rows.groupBy("priority").agg(F.min("code").alias("code"), F.first("status").alias("status")), spec, F.col("code"))
    linked = L.backlink(first, entries, "priority", "status", "priority", limit=200)
    sizes = linked.select(F.col("entry.priority").alias("status"), F.size("backlinks").alias("n"))
    return sizes.groupBy("status").agg(as_long(F.sum("n"), "n"), (F.max("n") < 400).alias("bounded"), (F.count(F.lit(1)) >= F.sum("n") / 400).alias("spread"))


@add("L15_by_ids", "SELECT c_custkey AS code, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def by_ids(spark, d):
    ids = T.load(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return L.by_ids(T.customers(spark, d), ids).select("entry.code", "entry.name")


@add("A9_grouped_computation", "SELECT o_orderkey AS code, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def grouped(spark, d):
    rows = T.load(spark, d, "orders").selectExpr("o_orderkey code", "o_custkey customer", "o_totalprice price")
    return grouped_apply(rows, ["customer"], {"n": F.count(F.lit(1)), "top": F.max("price")}).select("code", "n", "top")


# ---------------------------------------------------------------- derived columns


def _virtual(plugin: str, field_params: dict, params: dict | None = None, **flags) -> dict:
    return {"virtual": True, "plugin": plugin, "params": params or {}, "field_params": field_params, **flags}


def _copy(source: str, type: str = "integer", **flags) -> dict:
    return _virtual("copy", {"value": source}, {"config": {"type": type}}, **flags)


def _link(resource: str, source: str, **flags) -> dict:
    return _virtual("link", {"id": source}, {"resource": resource, "target": "code"}, **flags)


def spec_with(**fields: dict) -> Spec:
    made = {k: Field.from_dict(v) for k, v in fields.items()}
    return T.ORDERS.with_fields({**T.ORDERS.fields, **made})


def context(spark, d) -> D.Context:
    return D.Context({"customers": D.Table(T.customers(spark, d), T.CUSTOMERS), "parts": D.Table(T.parts(spark, d), T.PARTS)})


D.register("line_total", lambda _f, p: F.round(numbers(F.transform(p["lines"], lambda x: x["quantity"])), 2), {"type": "number"})
D.register("joined", lambda _f, p: F.array_join(p["values"], "/"), {"type": "string"})
D.register("spell", lambda _f, p: F.concat_ws(":", p["part"].cast("string"), p["state"]), {"type": "string"})


@add("D1_derive_in_order", "SELECT o_orderkey AS code, o_custkey AS c, c_name AS owner, c_name AS owner_again FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def derive_in_order(spark, d):
    spec = spec_with(owner_again=_copy("owner", "string"), owner=_copy("who.entry.name", "string"), who=_link("customers", "c"), c=_copy("customer"))
    rows = D.derive(T.orders(spark, d), spec, context(spark, d))
    return rows.select("entry.code", "entry.c", "entry.owner", "entry.owner_again")


@add("D1_derive_in_elements", f"WITH {T.SQL_LINES} SELECT code, pos, p_name AS name FROM l LEFT JOIN part ON p_partkey = part")
def derive_in_elements(spark, d):
    lines = T.ORDERS.fields["lines"]
    inner = Field(type="object", collection=True, fields={**lines.fields, "_part": Field.from_dict(_link("parts", "lines.part"))})
    spec = T.ORDERS.with_fields({**T.ORDERS.fields, "lines": inner})
    rows = D.derive(T.orders(spark, d), spec, context(spark, d))
    return rows.select(code(), F.posexplode("entry.lines").alias("pos", "line")).select("code", as_long("pos", "pos"), F.col("line._part.entry.name").alias("name"))


@add("D4_list_parameters", f"WITH {T.SQL_LINES} SELECT code, pos, p_name AS name FROM l LEFT JOIN part ON p_partkey = part")
def list_parameters(spark, d):
    spec = spec_with(_parts=_link("parts", "lines.part", collection=True, flatten_params=True))
    rows = D.derive(T.orders(spark, d), spec, context(spark, d))
    return rows.select(code(), F.posexplode("entry._parts").alias("pos", "p")).select("code", as_long("pos", "pos"), F.col("p.entry.name").alias("name"))


@add("D4_list_combinations", f"WITH {T.SQL_LINES} SELECT a.code, count(*) AS n, min(a.part || ':' || b.state) AS low, max(a.part || ':' || b.state) AS high FROM l a JOIN l b ON a.code = b.code GROUP BY a.code")
def list_combinations(spark, d):
    spec = spec_with(pairs=_virtual("spell", {"part": "lines.part", "state": "lines.state"}, collection=True, flatten_params=True))
    rows = D.derive(T.orders(spark, d), spec).filter("size(entry.pairs) > 0")
    return rows.select(code(), as_long(F.size("entry.pairs"), "n"), F.array_min("entry.pairs").alias("low"), F.array_max("entry.pairs").alias("high"))


CALLS = "answered"


def _answer(_context, _fixed, combos: DataFrame) -> DataFrame:
    return combos.withColumn("result", F.concat_ws("#", F.lit(CALLS), F.col("id").cast("string")))


D.register("answer", _answer, {"type": "string"}, kind="table")


@add("D5_distinct_evaluation", "SELECT o_orderkey AS code, 'answered#' || o_custkey AS answer FROM orders")
def distinct_evaluation(spark, d):
    spec = spec_with(answer=_virtual("answer", {"id": "customer"}))
    return D.derive(T.orders(spark, d), spec).select("entry.code", "entry.answer")


@add(
    "D6_missing_parameters",
    f"WITH {T.SQL_LINES}, f AS (SELECT code, part, flag FROM l WHERE pos = 2) SELECT o_orderkey AS code, CASE WHEN part IS NOT NULL THEN part END AS third, CASE WHEN flag IS NULL THEN o_orderstatus ELSE o_orderstatus || '/' || flag END AS both, CASE WHEN code IS NOT NULL THEN o_custkey END AS guarded FROM orders LEFT JOIN f ON code = o_orderkey",
)
def missing_parameters(spark, d):
    df = T.orders(spark, d)
    third = F.get("entry.lines", F.lit(2))
    df = df.withColumn("entry", F.col("entry").withField("part", third["part"]).withField("flag", third["flag"]).withField("there", third.isNotNull()))
    spec = spec_with(
        part={"type": "integer"}, flag={"type": "string"}, there={"type": "boolean"},
        third=_copy("part"), both=_virtual("joined", {"values": ["status", "flag"]}),
        guarded=_virtual("copy", {"value": "customer", "include_if": "there"}, {"config": {"type": "integer"}}),
    )
    return D.derive(df, spec).select("entry.code", "entry.third", "entry.both", "entry.guarded")


@add("D7_hidden", "SELECT o_orderkey AS code, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def hidden(spark, d):
    spec = spec_with(who=_link("customers", "customer", hidden=True), segment=_copy("who.entry.segment", "string"))
    rows = D.derive(T.orders(spark, d), spec, context(spark, d))
    assert "who" not in rows.schema["entry"].dataType.fieldNames()
    return rows.select("entry.code", "entry.segment")


@add("D8_two_phases", "SELECT o_orderkey AS code, c_name AS late FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 50")
def two_phases(spark, d):
    spec = spec_with(early=_copy("customer"), who=_link("customers", "early", searchable=False), late=_copy("who.entry.name", "string", searchable=False))
    there = D.derive(T.orders(spark, d), spec, context(spark, d), until="indexed")
    hits = Q.query(there, D.effective_spec(spec, context(spark, d), "indexed"), sort=["price|desc"], size=50).hits
    return D.derive(hits, spec, context(spark, d), start="indexed").select("entry.code", "entry.late")


@add("D9_copy", "SELECT o_orderkey AS code, o_orderstatus AS again FROM orders")
def copy(spark, d):
    return D.derive(T.orders(spark, d), spec_with(again=_copy("status", "string"))).select("entry.code", "entry.again")


@add("D10_preview", f"WITH {T.SQL_LINES} SELECT o_orderkey AS code, coalesce(sum(quantity), 0) AS total FROM orders LEFT JOIN l ON code = o_orderkey GROUP BY o_orderkey HAVING count(code) > 0")
def preview(spark, d):
    rows = T.orders(spark, d).select("id", "entry")
    return D.preview(rows, spec_with(total=_virtual("line_total", {"lines": "lines"}))).filter("entry.total IS NOT NULL").select("entry.code", "entry.total")


D.register("price_band", lambda fixed, p: F.floor(p["price"] / fixed["width"]).cast("long"), {"type": "integer"})


@add("D11_registered_function", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS band, count(*) AS n FROM orders GROUP BY band")
def registered_function(spark, d):
    spec = spec_with(band=_virtual("price_band", {"price": "price"}, {"width": 50000}))
    return D.derive(T.orders(spark, d), spec).groupBy(F.col("entry.band").alias("band")).agg(F.count(F.lit(1)).alias("n"))
