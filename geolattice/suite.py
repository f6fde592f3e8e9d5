"""Queries over the driver's tables, one for each operator, with the SQL that says the same."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice import suite_catalog
from geolattice.functions import aggregates as A
from geolattice.functions import columns as C
from geolattice.functions import documents as D
from geolattice.operators import bands
from geolattice.operators.queryables import missing as missing_queryables
from geolattice.operators.search import plan, search_df
from geolattice.plans.envelope import envelope, partition_filter
from geolattice.plans.keyset import encode
from geolattice.plans.normalize import prop, search_tree
from geolattice.sources import adapters as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_VIEWS = {"events": (T.events_as_items, T.EVENTS, "event_id"), "orders": (T.orders_as_items, T.ORDERS, "o_orderkey"), "part": (T.parts_as_items, T.PARTS, "p_partkey")}


def _search(name: str, source: str, request: dict, where: str) -> None:
    """A search's matches, by key, against a WHERE clause."""
    items, cte, key = _VIEWS[source]
    QUERIES[name] = lambda spark, d: plan(items(spark, d), request).matched.select(key)
    SQL[name] = f"WITH {cte} SELECT {key} FROM items WHERE {where}"


def _op(op: str, *args) -> dict:
    return {"op": op, "args": list(args)}


P = prop
for _name, _req, _where in [
    ("search_ids", {"ids": ["1", "17", "999999999"]}, "id IN ('1', '17', '999999999')"),
    ("search_collections", {"collections": ["click", "view"]}, "collection IN ('click', 'view')"),
    ("search_datetime_instant", {"datetime": "2024-01-05T12:00:00Z"}, "datetime <= TIMESTAMP '2024-01-05 12:00:00' AND end_datetime >= TIMESTAMP '2024-01-05 12:00:00'"),
    ("search_datetime_interval", {"datetime": "2024-01-05/2024-01-10"}, "datetime <= TIMESTAMP '2024-01-10' AND end_datetime >= TIMESTAMP '2024-01-05'"),
    ("search_datetime_open_start", {"datetime": "../2024-01-03"}, "datetime <= TIMESTAMP '2024-01-03'"),
    ("search_datetime_open_end", {"datetime": ["2024-01-28T00:00:00Z", ".."]}, "end_datetime >= TIMESTAMP '2024-01-28'"),
    ("search_datetime_duration", {"datetime": "2024-01-05/P1DT12H"}, "datetime <= TIMESTAMP '2024-01-06 12:00:00' AND end_datetime >= TIMESTAMP '2024-01-05'"),
    ("cql2_eq", {"filter": _op("=", P("user_id"), 8)}, "user_id = 8"),
    ("cql2_neq", {"filter": _op("<>", P("collection"), "click")}, "collection <> 'click'"),
    ("cql2_lt", {"filter": _op("<", P("value"), 1.5)}, "value < 1.5"),
    ("cql2_lte", {"filter": _op("<=", P("value"), 1.5)}, "value <= 1.5"),
    ("cql2_gt", {"filter": _op(">", P("value"), 100)}, "value > 100"),
    ("cql2_gte", {"filter": _op(">=", P("datetime"), {"timestamp": "2024-01-20T00:00:00Z"})}, "datetime >= TIMESTAMP '2024-01-20'"),
    ("cql2_between", {"filter": _op("between", P("value"), 10, 20)}, "value BETWEEN 10 AND 20"),
    ("cql2_in", {"filter": _op("in", P("user_id"), [1, 2, 3])}, "user_id IN (1, 2, 3)"),
    ("cql2_isnull", {"filter": _op("isNull", P("properties.m"))}, "json_extract_string(properties, '$.m') IS NULL"),
    ("cql2_not", {"filter": _op("not", _op("=", P("collection"), "view"))}, "NOT (collection = 'view')"),
    ("cql2_and_or_nested", {"filter": _op("and", _op("or", _op("=", P("collection"), "click"), _op(">", P("value"), 50)), _op("not", _op("<", P("user_id"), 20)))}, "(collection = 'click' OR value > 50) AND NOT (user_id < 20)"),
    ("cql2_arithmetic", {"filter": _op(">", _op("+", _op("*", P("value"), 2), _op("/", P("user_id"), 4)), _op("-", 120, 20))}, "value * 2 + user_id / 4.0 > 100"),
    ("cql2_json_number", {"filter": _op(">", P("properties.k"), 80)}, "CAST(json_extract_string(properties, '$.k') AS DOUBLE) > 80"),
    ("cql2_json_text_vs_number", {"filter": _op(">", P("k"), "80")}, "json_extract_string(properties, '$.k') > '80'"),
    ("query_ext", {"query": {"k": {"gte": 20, "lt": 40}, "collection": {"eq": "click"}}}, "CAST(json_extract_string(properties, '$.k') AS DOUBLE) >= 20 AND CAST(json_extract_string(properties, '$.k') AS DOUBLE) < 40 AND collection = 'click'"),
    ("cql1_filter", {"filter-lang": "cql-json", "filter": {"and": [{"gt": [P("value"), 50]}, {"in": [P("collection"), ["click", "error"]]}, {"anyinteracts": [P("datetime"), "2024-01-05/2024-01-10"]}]}}, "value > 50 AND collection IN ('click', 'error') AND datetime <= TIMESTAMP '2024-01-10' AND end_datetime >= TIMESTAMP '2024-01-05'"),
    ("bbox_intersects", {"bbox": [-10, -10, 30, 20]}, "xmin <= 30 AND xmax >= -10 AND ymin <= 20 AND ymax >= -10"),
    ("bbox_3d", {"bbox": [-10, -10, 0, 30, 20, 99]}, "xmin <= 30 AND xmax >= -10 AND ymin <= 20 AND ymax >= -10"),
    ("s_disjoint", {"filter": _op("s_disjoint", P("geometry"), [-100, -60, 100, 60])}, "NOT (xmin <= 100 AND xmax >= -100 AND ymin <= 60 AND ymax >= -60)"),
    ("s_within", {"filter": _op("s_within", P("geometry"), [-50, -40, 50, 40])}, "xmin >= -50 AND xmax <= 50 AND ymin >= -40 AND ymax <= 40"),
    ("s_contains", {"filter": _op("s_contains", P("geometry"), [6, 6, 7, 7])}, "xmin <= 6 AND xmax >= 7 AND ymin <= 6 AND ymax >= 7"),
    ("s_equals", {"filter": _op("s_equals", P("geometry"), [-170, -80, -165, -75])}, "xmin = -170 AND xmax = -165 AND ymin = -80 AND ymax = -75"),
    ("s_touches", {"filter": _op("s_touches", P("geometry"), [0, 0, 10, 10])}, "xmin <= 10 AND xmax >= 0 AND ymin <= 10 AND ymax >= 0 AND NOT (xmin < 10 AND xmax > 0 AND ymin < 10 AND ymax > 0)"),
    ("s_overlaps", {"filter": _op("s_overlaps", P("geometry"), [-50, -40, 50, 40])}, "xmin < 50 AND xmax > -50 AND ymin < 40 AND ymax > -40 AND NOT (xmin >= -50 AND xmax <= 50 AND ymin >= -40 AND ymax <= 40) AND NOT (xmin <= -50 AND xmax >= 50 AND ymin <= -40 AND ymax >= 40)"),
]:
    _search(_name, "events", _req, _where)

_LO, _HI = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-06 12:00:00'"
for _name, _where in {
    "t_before": "end_datetime < {lo}", "t_after": "datetime > {hi}",
    "t_overlaps": "datetime < {lo} AND end_datetime > {lo} AND end_datetime < {hi}", "t_overlappedby": "datetime > {lo} AND datetime < {hi} AND end_datetime > {hi}", "t_during": "datetime > {lo} AND end_datetime < {hi}",
    "t_contains": "datetime < {lo} AND end_datetime > {hi}", "t_disjoint": "NOT (datetime <= {hi} AND end_datetime >= {lo})", "t_intersects": "datetime <= {hi} AND end_datetime >= {lo}", "anyinteracts": "datetime <= {hi} AND end_datetime >= {lo}",
}.items():
    _search(_name, "events", {"filter": _op(_name, P("datetime"), {"interval": ["2024-01-05T00:00:00Z", "2024-01-06T12:00:00Z"]})}, _where.format(lo=_LO, hi=_HI))


def _around(op: str, source: str, one: int, lo: tuple[str, int], hi: tuple[str, int], where: str) -> None:
    """A relation that needs equal times, with an interval made from one row's start or end and so many hours."""
    items, cte, key = _VIEWS[source]
    name = op if source == "events" else f"{op}_{source}"

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = items(spark, d)
        row = rows.filter(F.col(key) == one).select("datetime", "end_datetime").first()
        ends = [(row[c] + timedelta(hours=h)).isoformat() + "Z" for c, h in (lo, hi)]
        return plan(rows, {"filter": _op(op, P("datetime"), {"interval": ends})}).matched.select(key)

    QUERIES[name] = query
    one_row = ", ".join(f"{c} + to_hours({h}) AS {n}" for n, (c, h) in (("lo", lo), ("hi", hi)))
    SQL[name] = f"WITH {cte}, one AS (SELECT {one_row} FROM items WHERE {key} = {one}) SELECT {key} FROM items, one WHERE {where}"


for _source, _one in (("events", 30), ("orders", 35)):
    for _name, _lo, _hi, _where in [
        ("t_meets", ("end_datetime", 0), ("end_datetime", 1), "end_datetime = lo"), ("t_metby", ("datetime", -1), ("datetime", 0), "datetime = hi"),
        ("t_starts", ("datetime", 0), ("end_datetime", 1), "datetime = lo AND end_datetime < hi"), ("t_startedby", ("datetime", 0), ("end_datetime", -1), "datetime = lo AND end_datetime > hi"),
        ("t_finishes", ("datetime", -1), ("end_datetime", 0), "datetime > lo AND end_datetime = hi"), ("t_finishedby", ("datetime", 1), ("end_datetime", 0), "datetime < lo AND end_datetime = hi"),
        ("t_equals", ("datetime", 0), ("end_datetime", 0), "datetime = lo AND end_datetime = hi"),
    ]:
        _around(_name, _source, _one, _lo, _hi, _where)

for _name, _req, _where in [
    ("cql2_like", {"filter": _op("like", P("p_name"), "%ring%")}, "p_name LIKE '%ring%'"),
    ("cql2_ilike", {"filter": _op("ilike", P("p_name"), "SMALL%")}, "p_name ILIKE 'SMALL%'"),
    ("cql2_casei", {"filter": _op("=", _op("casei", P("p_brand")), _op("casei", "brand#2"))}, "upper(p_brand) = upper('brand#2')"),
    ("cql2_upper_lower", {"filter": _op("or", _op("=", {"upper": P("p_name")}, "RED WIDGET"), _op("=", _op("lower", P("p_type")), "economy"))}, "upper(p_name) = 'RED WIDGET' OR lower(p_type) = 'economy'"),
    ("a_equals", {"filter": _op("a_equals", P("words"), ["small", "ring"])}, "words = ['small', 'ring']"),
    ("a_contains", {"filter": _op("a_contains", P("properties.tags"), ["red"])}, "list_contains(words, 'red')"),
    ("a_contained_by", {"filter": _op("a_contained_by", P("words"), ["small", "red", "ring", "bolt", "widget"])}, "len(list_filter(words, lambda w: NOT list_contains(['small', 'red', 'ring', 'bolt', 'widget'], w))) = 0"),
    ("a_overlaps", {"filter": _op("a_overlaps", P("tags"), ["blue", "bolt"])}, "list_contains(words, 'blue') OR list_contains(words, 'bolt')"),
    ("cql2_in_text", {"filter": _op("in", P("p_type"), ["ECONOMY", "PROMO"])}, "p_type IN ('ECONOMY', 'PROMO')"),
]:
    _search(_name, "part", _req, _where)


def _define(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_define("cql2_accenti", "SELECT doc_id FROM documents WHERE strip_accents(text) LIKE '%cion de la%' AND lang <> 'en'")
def _(spark, d):
    return plan(T.documents_as_items(spark, d), {"filter": _op("and", _op("like", _op("accenti", P("description")), "%cion de la%"), _op("<>", P("lang"), "en"))}).matched.select("doc_id")


def _freetext(name: str, q: str | list[str], where: str) -> None:
    QUERIES[name] = lambda spark, d: plan(T.documents_as_items(spark, d), {"q": q}).matched.select("doc_id")
    SQL[name] = f"SELECT doc_id FROM documents WHERE {where}"


def _word(w: str) -> str:
    return rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}]){w}($|[^\p{{L}}\p{{N}}])')"


_freetext("q_term", "idiot", _word("idiots?"))
_freetext("q_and", "idiot AND clown", f"{_word('idiots?')} AND {_word('clowns?')}")
_freetext("q_or", ["moron", "scum"], f"{_word('morons?')} OR {_word('scums?')}")
_freetext("q_not", "clown -idiot", f"{_word('clowns?')} AND NOT {_word('idiots?')}")
_freetext("q_phrase", '"general public"', r"regexp_matches(lower(text), '(^|[^\p{L}\p{N}])general[^\p{L}\p{N}]+public($|[^\p{L}\p{N}])')")

# Order, pages, projection

_ORDER = {"sortby": [{"field": "value", "direction": "desc"}, {"field": "datetime", "direction": "asc"}]}


def _page(name: str, request: dict, order: str, limit: int = 10, columns: str = "event_id, value") -> None:
    cols = [c.strip() for c in columns.split(",")]
    QUERIES[name] = lambda spark, d: search_df(T.events_as_items(spark, d), request | {"limit": limit}).select(*cols)
    SQL[name] = f"WITH {T.EVENTS} SELECT {columns} FROM items {order} LIMIT {limit}"


_page("sort_default", {}, "ORDER BY datetime DESC, id DESC, collection DESC")
_page("sort_multi", _ORDER, "ORDER BY value DESC, datetime ASC, id DESC, collection DESC", 25)
_page("topk", {"sortby": ["-value"]}, "ORDER BY value DESC, id DESC, collection DESC", 100)
_NUM_M = "CAST(json_extract_string(properties, '$.m') AS DOUBLE)"


def _with_m(spark, d):
    return T.events_as_items(spark, d).withColumn("m", F.get_json_object("properties", "$.m").cast("double"))


QUERIES["sort_nulls_asc"] = lambda s, d: search_df(_with_m(s, d), {"sortby": [{"field": "m", "direction": "asc"}], "limit": 4000}).select("event_id", "m")
SQL["sort_nulls_asc"] = f"WITH {T.EVENTS} SELECT event_id, {_NUM_M} AS m FROM items ORDER BY m ASC NULLS LAST, id ASC, collection ASC LIMIT 4000"
QUERIES["sort_nulls_desc"] = lambda s, d: search_df(_with_m(s, d), {"sortby": [{"field": "m", "direction": "desc"}], "limit": 4000}).select("event_id", "m")
SQL["sort_nulls_desc"] = f"WITH {T.EVENTS} SELECT event_id, {_NUM_M} AS m FROM items ORDER BY m DESC NULLS FIRST, id DESC, collection DESC LIMIT 4000"

_SEEK = {"sortby": [{"field": "collection", "direction": "asc"}, {"field": "m", "direction": "desc"}], "limit": 20}
_SEEK_ORDER = "collection ASC, m DESC NULLS FIRST, id ASC"


def _token(spark, d, place: int) -> list[str | None]:
    """Sort values of one row of the whole order, as a client would have them from a page."""
    rows = search_df(_with_m(spark, d), _SEEK | {"limit": place}).select("collection", "m", "id").collect()
    r = rows[-1]
    return [r[0], None if r[1] is None else repr(r[1]), r[2]]


def _pages(name: str, rows: str, back: bool, place: int) -> None:
    QUERIES[name] = lambda s, d: search_df(_with_m(s, d), _SEEK | {"token": ("prev:" if back else "next:") + encode(_token(s, d, place))}).select("event_id", "collection", "m")
    SQL[name] = f"WITH {T.EVENTS}, placed AS (SELECT *, row_number() OVER (ORDER BY {_SEEK_ORDER}) AS rn FROM (SELECT *, {_NUM_M} AS m FROM items)) SELECT event_id, collection, m FROM placed WHERE {rows}"


QUERIES["page_1"] = lambda s, d: search_df(_with_m(s, d), _SEEK).select("event_id", "collection", "m")
SQL["page_1"] = f"WITH {T.EVENTS} SELECT event_id, collection, m FROM (SELECT *, {_NUM_M} AS m FROM items) ORDER BY {_SEEK_ORDER} LIMIT 20"
_pages("page_2_keyset", "rn BETWEEN 21 AND 40", False, 20)
_pages("page_prev", "rn BETWEEN 20 AND 39", True, 40)


def _fields(spark, d, fields):
    items = T.events_as_items(spark, d).select("event_id", "id", "collection", "properties")

    @F.pandas_udf("string")
    def doc(id: pd.Series, collection: pd.Series, properties: pd.Series) -> pd.Series:
        return pd.Series([D.canonical(D.project({"id": i, "collection": c, "type": "Feature", "properties": json.loads(p)}, fields)) for i, c, p in zip(id, collection, properties)], dtype=object)

    return items.select("event_id", doc("id", "collection", "properties").alias("doc"))


_FIELDS = "WITH " + T.EVENTS + " SELECT event_id, @doc AS doc FROM items"
QUERIES["fields_include"] = lambda s, d: _fields(s, d, {"include": ["properties.k"]})
SQL["fields_include"] = _FIELDS.replace("@doc", """'{"collection":"' || collection || '","id":"' || id || '","properties":{"k":' || json_extract_string(properties, '$.k') || '}}'""")
QUERIES["fields_exclude"] = lambda s, d: _fields(s, d, {"exclude": ["properties.m", "type"]})
SQL["fields_exclude"] = SQL["fields_include"]

# Counts, statistics, extents


@_define("matched_count", f"WITH {T.EVENTS} SELECT count(*) AS matched FROM items WHERE collection = 'click' AND value > 10")
def _(spark, d):
    return plan(T.events_as_items(spark, d), {"collections": ["click"], "filter": _op(">", P("value"), 10)}).matched.agg(F.count(F.lit(1)).alias("matched"))


@_define("count_by_collection", "SELECT event_type AS collection, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type")
def _(spark, d):
    return T.events_as_items(spark, d).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_at"), F.max("datetime").alias("last_at"))


@_define("partition_stats", f"WITH {T.ORDERS} SELECT collection, dt_bucket, count(*) AS n, min(datetime) AS dt_lo, max(datetime) AS dt_hi, min(end_datetime) AS edt_lo, max(end_datetime) AS edt_hi, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM items GROUP BY ALL")
def _(spark, d):
    from geolattice.operators.catalog import partition_stats

    return partition_stats(T.orders_as_items(spark, d))


@_define("month_histogram", f"WITH {T.ORDERS} SELECT date_trunc('month', datetime)::TIMESTAMP AS month, CAST(count(*) AS DOUBLE) AS n FROM items GROUP BY 1")
def _(spark, d):
    from geolattice.operators.catalog import partition_stats

    return bands.month_histogram(partition_stats(T.orders_as_items(spark, d))).select(F.col("month").cast("timestamp_ntz").alias("month"), "n")


@_define("envelope_prune", f"WITH {T.ORDERS}, stats AS (SELECT collection, dt_bucket, count(*) AS n, min(datetime) AS dt_lo, max(end_datetime) AS edt_hi, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM items GROUP BY 1, 2) SELECT collection, dt_bucket, n FROM stats WHERE collection IN ('F', 'P') AND dt_lo <= TIMESTAMP '1997-06-30' AND edt_hi >= TIMESTAMP '1997-03-01' AND xmin <= 20 AND xmax >= -20 AND ymin <= 20 AND ymax >= -20")
def _(spark, d):
    from geolattice.operators.catalog import partition_stats

    items = T.orders_as_items(spark, d)
    env = envelope(search_tree({"collections": ["F", "P"], "datetime": "1997-03-01/1997-06-30", "bbox": [-20, -20, 20, 20]}), ["F", "O", "P"])
    return partition_stats(items).filter(partition_filter(env, lambda t: F.lit(t).cast("timestamp_ntz"))).select("collection", "dt_bucket", "n")


@_define("first_notnull", f"WITH {T.EVENTS} SELECT collection, arg_min(m, datetime) FILTER (m IS NOT NULL) AS first_m FROM (SELECT *, json_extract_string(properties, '$.m') AS m FROM items) GROUP BY collection")
def _(spark, d):
    items = T.events_as_items(spark, d).withColumn("m", F.get_json_object("properties", "$.m"))
    return items.groupBy("collection").agg(A.first_not_null(F.col("m"), F.col("datetime")).alias("first_m"))


@_define("array_unique_merge", "SELECT p_type, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ',') AS tags FROM part GROUP BY p_type")
def _(spark, d):
    items = T.parts_as_items(spark, d)
    return items.groupBy("p_type").agg(F.array_join(A.array_unique_merge(F.get_json_object("properties", "$.tags")), ",").alias("tags"))


@_define("json_min_max", f"WITH {T.EVENTS} SELECT collection, min(CAST(json_extract_string(properties, '$.k') AS DOUBLE)) AS lo, max(CAST(json_extract_string(properties, '$.k') AS DOUBLE)) AS hi FROM items GROUP BY collection")
def _(spark, d):
    k = F.get_json_object("properties", "$.k")
    return T.events_as_items(spark, d).groupBy("collection").agg(A.json_min(k).alias("lo"), A.json_max(k).alias("hi"))


@_define("common_paths", "SELECT p_type, array_to_string(list_sort(list_filter(['size', 'type'], lambda x: (x = 'type') OR (x = 'size' AND lo = hi))), ',') AS paths FROM (SELECT p_type, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_type)")
def _(spark, d):
    items = T.parts_as_items(spark, d).withColumn("doc", F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type"))))
    return A.common_paths(items, "doc", "p_type").select("p_type", F.array_join("paths", ",").alias("paths"))


@_define("field_rows", f"WITH {T.EVENTS} SELECT collection, path, count(*) AS n, bool_and(TRUE) AS is_leaf FROM (SELECT collection, unnest(json_keys(properties)) AS path FROM items) GROUP BY collection, path")
def _(spark, d):
    rows = A.field_rows(T.events_as_items(spark, d), "properties", "collection")
    return rows.groupBy("collection", "path").agg(F.count(F.lit(1)).alias("n"), F.every("is_leaf").alias("is_leaf"))


@_define("missing_queryables", "SELECT DISTINCT event_type AS collection, 'm' AS name, 'number' AS type, 'to_float' AS wrapper FROM events WHERE event_id % 3 = 0")
def _(spark, d):
    return missing_queryables(T.events_as_items(spark, d), ["k"], 100.0)


@_define("queryables_merge", "SELECT name, min(lo) AS minimum, max(hi) AS maximum FROM (SELECT 'k' AS name, min(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS lo, max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS hi FROM events GROUP BY event_type) GROUP BY name")
def _(spark, d):
    from geolattice.operators.queryables import merged
    from geolattice.plans.properties import Queryable

    k = F.get_json_object("props", "$.k").cast("double")
    found = T.table(spark, d, "events").groupBy("event_type").agg(F.min(k).alias("lo"), F.max(k).alias("hi")).collect()  # one row a collection
    schema = merged([Queryable("k", {"type": "number", "minimum": r.lo, "maximum": r.hi}, collections=[r.event_type]) for r in found], [r.event_type for r in found])
    q = schema["properties"]["k"]
    return spark.createDataFrame([("k", q.get("minimum"), q.get("maximum"))], "name string, minimum double, maximum double")


# Shapes of joins, sets


def _oc(spark, d):
    return T.table(spark, d, "orders").alias("o"), T.table(spark, d, "customer").alias("c")


@_define("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def _(spark, d):
    o, c = _oc(spark, d)
    return o.join(c.filter("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@_define("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def _(spark, d):
    o, c = _oc(spark, d)
    return c.join(o.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@_define("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, d):
    o, c = _oc(spark, d)
    return c.join(o.filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@_define("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, d):
    o, c = _oc(spark, d)
    return c.join(o.filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@_define("join_full", "SELECT a.k AS a_k, b.k AS b_k FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'MACHINERY') b ON a.k = b.k")
def _(spark, d):
    c = T.table(spark, d, "customer")
    a, b = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("a_k")), c.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("b_k"))
    return a.join(b, F.col("a_k") == F.col("b_k"), "full")


@_define("join_range", f"WITH {T.EVENTS}, spans AS (SELECT collection, date_trunc('day', datetime)::TIMESTAMP AS lo, max(datetime) AS hi FROM items GROUP BY 1, 2) SELECT i.event_id, s.lo FROM items i JOIN spans s ON i.collection = s.collection AND i.datetime >= s.lo AND i.datetime <= s.hi AND date_trunc('day', i.datetime) = s.lo")
def _(spark, d):
    """Containment of a time in partitions' ranges, as an equality of buckets first."""
    items = T.events_as_items(spark, d).withColumn("lo", F.date_trunc("day", "datetime").cast("timestamp_ntz"))
    spans = items.groupBy("collection", "lo").agg(F.max("datetime").alias("hi"))
    return items.join(spans, ["collection", "lo"]).filter("datetime >= lo and datetime <= hi").select("event_id", "lo")


@_define("join_null_safe", "SELECT a.event_id FROM events a JOIN events b ON a.event_id = b.event_id + 1 WHERE json_extract_string(a.props, '$.k') IS DISTINCT FROM json_extract_string(b.props, '$.k')")
def _(spark, d):
    e = T.table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    b = e.select((F.col("event_id") + 1).alias("event_id"), F.col("k").alias("before"))
    return e.join(b, "event_id").filter(~F.col("k").eqNullSafe(F.col("before"))).select("event_id")


@_define("union_all", "SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE value > 50")
def _(spark, d):
    e = T.table(spark, d, "events")
    return e.filter("event_type = 'click'").select("event_id").unionByName(e.filter("value > 50").select("event_id"))


@_define("intersect", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE value > 50")
def _(spark, d):
    e = T.table(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").intersect(e.filter("value > 50").select("user_id"))


@_define("distinct_on", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def _(spark, d):
    first = F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return T.table(spark, d, "events").groupBy("user_id").agg(first.alias("r")).select("user_id", "r.*")


@_define("row_numbers", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS page_no FROM events QUALIFY page_no <= 3")
def _(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return T.table(spark, d, "events").select("event_type", "event_id", F.row_number().over(w).alias("page_no")).filter("page_no <= 3")


@_define("recursive_paths", "SELECT n_name, unnest([list_slice(string_split(n_name, '_'), 1, k)[-1] || ':' || k for k in range(1, len(string_split(n_name, '_')) + 1)]) AS step FROM nation")
def _(spark, d):
    steps = C.prefixes(F.replace("n_name", F.lit("_"), F.lit(".")))
    return T.table(spark, d, "nation").select("n_name", F.explode(steps).alias("p")).select("n_name", F.concat(F.element_at("p", -1), F.lit(":"), F.size("p")).alias("step"))


@_define("array_intersection", "SELECT p_partkey, array_to_string(list_sort(list_intersect(string_split(p_name, ' '), ['red', 'small', 'ring'])), ',') AS both FROM part")
def _(spark, d):
    return T.parts_as_items(spark, d).select("p_partkey", F.array_join(F.array_sort(F.array_intersect("words", F.array(*map(F.lit, ("red", "small", "ring"))))), ",").alias("both"))


@_define("json_casts", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS as_float, CAST(floor(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 7) AS INTEGER) AS as_int, json_extract_string(props, '$.k') AS as_text FROM events")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    return T.table(spark, d, "events").select("event_id", C.to_double(k).alias("as_float"), C.to_int((C.to_double(k) / 7).cast("string")).alias("as_int"), C.json_text(F.to_json(F.struct(k.alias("v")))).alias("j")).select("event_id", "as_float", "as_int", F.get_json_object("j", "$.v").alias("as_text"))


@_define("time_text", "SELECT event_id, rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z' AS at FROM events")
def _(spark, d):
    return T.table(spark, d, "events").select("event_id", C.time_text(F.col("ts")).alias("at"))


@_define("bbox_geometry", f"WITH {T.EVENTS} SELECT event_id, xmin, ymin, xmax, ymax FROM items")
def _(spark, d):
    items = T.events_as_items(spark, d)
    boxes = items.select("event_id", F.to_json(C.bbox_array(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])).alias("bbox"))
    return boxes.select("event_id", C.bbox_struct(F.col("bbox")).alias("b")).select("event_id", "b.*")


@_define("canonical_hash", "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || ',\"user\":' || user_id || '}') AS hash FROM events")
def _(spark, d):
    @F.pandas_udf("string")
    def digest(column: pd.Series) -> pd.Series:
        return column.map(lambda t: D.digest(json.loads(t)))

    doc = F.concat(F.lit('{ "user" : '), F.col("user_id"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit(".0, \"private\": 1}"))
    return T.table(spark, d, "events").select("event_id", digest(doc).alias("hash"))


_TILE = "2 * 20037508.3427892 / pow(2.0, z)"


@_define("tile_envelope", f"SELECT n_nationkey AS n, round(x * size - 20037508.3427892, 4) AS x0, round(20037508.3427892 - (y + 1) * size, 4) AS y0 FROM (SELECT n_nationkey, n_nationkey % 8 AS x, n_regionkey % 8 AS y, {_TILE} AS size FROM nation, (SELECT 3 AS z))")
def _(spark, d):
    b = C.tile_bounds(F.lit(3), F.col("n_nationkey") % 8, F.col("n_regionkey") % 8)
    return T.table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.round(b["x0"], 4).alias("x0"), F.round(b["y0"], 4).alias("y0"))


@_define("tile_candidates", f"WITH {T.EVENTS}, tile AS (SELECT x * 45.0 - 180 AS x0, (x + 1) * 45.0 - 180 AS x1, degrees(2 * atan(exp((1 - (y + 1) / 4.0) * pi())) - pi() / 2) AS y0, degrees(2 * atan(exp((1 - y / 4.0) * pi())) - pi() / 2) AS y1 FROM (SELECT 4 AS x, 3 AS y)) SELECT event_id FROM items, tile WHERE xmin <= x1 AND xmax >= x0 AND ymin <= y1 AND ymax >= y0")
def _(spark, d):
    from geolattice.operators.tiles import tile_lonlat

    return plan(T.events_as_items(spark, d), {"bbox": list(tile_lonlat(3, 4, 3))}).matched.select("event_id")


# Exact geometry: triangles and lines against a slanted convex polygon, which SQL can judge by half-planes

_CORNERS = [(-60, -30), (40, -50), (60, 30), (-20, 45)]
_SHAPE = {"type": "Polygon", "coordinates": [[list(map(float, c)) for c in (*_CORNERS, _CORNERS[0])]]}
#: The triangle's corners, by columns of the item's box; the line goes from the first to the last.
_TRIANGLE = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax")]


def _side(k: int, x: str, y: str) -> str:
    """Above 0 where a point lies inside of the polygon's side k, 0 on it."""
    (ax, ay), (bx, by) = _CORNERS[k], _CORNERS[(k + 1) % 4]
    return f"({bx - ax} * ({y} - ({ay})) - ({by - ay}) * ({x} - ({ax})))"


_SIDES = [[_side(k, *c) for c in _TRIANGLE] for k in range(4)]
_WITHIN = " AND ".join(f"{f} >= 0" for side in _SIDES for f in side)


def _apart(strict: bool) -> str:
    """An axis parts triangle and polygon: a side of either. strict: with something between them."""
    less = "<" if strict else "<="
    sides = [f"greatest({', '.join(side)}) {less} 0" for side in _SIDES]
    xs, ys, us = [x for x, _ in _CORNERS], [y for _, y in _CORNERS], [y - x for x, y in _CORNERS]
    own = [f"{max(xs)} {less} xmin", f"xmax {less} {min(xs)}", f"{max(ys)} {less} ymin", f"ymax {less} {min(ys)}", f"greatest(ymin - xmin, ymax - xmax) {less} {min(us)}", f"{max(us)} {less} ymin - xmax"]
    return " OR ".join(sides + own)


def _geometry(kind: str, corners: list[tuple[str, str]]) -> Column:
    points = F.concat_ws(",", *[F.concat(F.lit("["), F.concat_ws(",", *c), F.lit("]")) for c in corners])
    head, tail = ("[[", "]]") if kind == "Polygon" else ("[", "]")
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":{head}'), points, F.lit(f"{tail}}}"))


def _exact(name: str, op: str, kind: str, where: str) -> None:
    corners = [*_TRIANGLE, _TRIANGLE[0]] if kind == "Polygon" else [_TRIANGLE[0], _TRIANGLE[2]]
    request = {"intersects": _SHAPE} if op == "intersects" else {"filter": _op(op, P("geometry"), _SHAPE)}
    QUERIES[name] = lambda spark, d: plan(T.events_as_items(spark, d).withColumn("geometry", _geometry(kind, corners)), request).matched.select("event_id")
    SQL[name] = f"WITH {T.EVENTS} SELECT event_id FROM items WHERE {where}"


_exact("spatial_exact", "intersects", "Polygon", f"NOT ({_apart(True)})")
_exact("triangle_disjoint", "s_disjoint", "Polygon", _apart(True))
_exact("triangle_within", "s_within", "Polygon", _WITHIN)
_exact("triangle_overlaps", "s_overlaps", "Polygon", f"NOT ({_apart(False)}) AND NOT ({_WITHIN})")
_exact("triangle_touches", "s_touches", "Polygon", f"NOT ({_apart(True)}) AND ({_apart(False)})")
_FROM, _TO = [s[0] for s in _SIDES], [s[2] for s in _SIDES]
_IN = [f"CASE WHEN {b} > {a} THEN -{a} / ({b} - {a}) ELSE 0 END" for a, b in zip(_FROM, _TO)]
_OUT = [f"CASE WHEN {b} < {a} THEN {a} / ({a} - {b}) ELSE 1 END" for a, b in zip(_FROM, _TO)]
_INSIDE = f"greatest(0, {', '.join(_IN)}) < least(1, {', '.join(_OUT)}) AND " + " AND ".join(f"NOT ({a} = {b} AND {a} <= 0)" for a, b in zip(_FROM, _TO))
_CLOSED = " AND ".join(f"{f} >= 0" for f in (*_FROM, *_TO))
_exact("s_crosses", "s_crosses", "LineString", f"{_INSIDE} AND NOT ({_CLOSED})")
_exact("line_within", "s_within", "LineString", f"{_CLOSED} AND {_INSIDE}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a search by collection, time and property, in order, one page."""
    request = {"collections": ["click"], "datetime": "2024-01-05/2024-01-10", "filter": _op(">", P("value"), 50), "sortby": [{"field": "datetime", "direction": "desc"}], "limit": 10}
    return search_df(T.events_as_items(spark, sf_dir), request).select("id", "collection", "datetime", "end_datetime", "value", "properties")


QUERIES["search_flagship"] = entry
SQL["search_flagship"] = f"WITH {T.EVENTS} SELECT id, collection, datetime, end_datetime, value, properties FROM items WHERE collection = 'click' AND datetime <= TIMESTAMP '2024-01-10' AND end_datetime >= TIMESTAMP '2024-01-05' AND value > 50 ORDER BY datetime DESC, id DESC LIMIT 10"

QUERIES |= suite_catalog.QUERIES
SQL |= suite_catalog.SQL
