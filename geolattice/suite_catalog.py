"""Queries that go through a stored catalog: the driver's tables are loaded as documents and the library's own calls answer.

A catalog that is only read is loaded once a session; each query that changes one loads its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.operators import items as I
from geolattice.operators.catalog import Catalog, Mode
from geolattice.operators.queryables import missing
from geolattice.operators.search import Search, page_token
from geolattice.operators.tiles import geometry_search, tile_lonlat, xyz_search
from geolattice.plans.normalize import prop as P
from geolattice.plans.properties import Queryable
from geolattice.sources.adapters import table
from geolattice.sources.readers import read_json
from geolattice.sources.workspace import folder
from geolattice.streaming.ingest import ingest_stream, read_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_LOADED: dict[tuple[str, str, str], Catalog] = {}


def _define(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _op(op: str, *args) -> dict:
    return {"op": op, "args": list(args)}


def _box(x: Column, y: Column, size: int) -> Column:
    corners = [F.array(x + a * size, y + b * size) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*corners)).alias("coordinates"))


# Customers as items: a collection for each market segment, a day of two years, a box of five degrees


def customers(spark: SparkSession, d: str, key: Column | None = None, balance: Column | None = None) -> DataFrame:
    k = F.col("c_custkey")
    x, y = k * 7 % 340 - 170, k * 13 % 160 - 80
    at = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 730).cast("int")), "yyyy-MM-dd'T00:00:00Z'")
    doc = F.struct(
        (k if key is None else key).cast("string").alias("id"), F.lit("Feature").alias("type"), F.col("c_mktsegment").alias("collection"), _box(x, y, 5).alias("geometry"), F.array(x, y, x + 5, y + 5).alias("bbox"),
        F.struct(at.alias("datetime"), (F.col("c_acctbal").cast("double") if balance is None else balance).alias("balance"), F.col("c_nationkey").alias("nation")).alias("properties"),
    )
    return table(spark, d, "customer").select("c_custkey", F.to_json(doc).alias("doc"))


CUSTOMERS = """items AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS collection, TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 730 AS INTEGER)) AS datetime,
         CAST(c_acctbal AS DOUBLE) AS balance, c_nationkey AS nation, c_custkey * 7 % 340 - 170 AS x, c_custkey * 13 % 160 - 80 AS y FROM customer)"""


def _new(spark: SparkSession, d: str, docs: DataFrame | None, trunc: str | None = "year") -> Catalog:
    catalog = Catalog(spark, folder(spark, "catalog"))
    catalog.load_collections([{"id": r[0]} for r in table(spark, d, "customer").select("c_mktsegment").distinct().collect()], partition_trunc=trunc)  # the few market segments
    if docs is not None:
        catalog.load_items(docs.select("doc"))
    return catalog


def _read_only(spark: SparkSession, d: str, what: str, make: Callable[[], Catalog]) -> Catalog:
    """Loaded once a session; the tables don't change."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def stored_customers(spark: SparkSession, d: str) -> Catalog:
    return _read_only(spark, d, "customers", lambda: _new(spark, d, customers(spark, d)))


def _balances(catalog: Catalog) -> DataFrame:
    return catalog.items().select("id", "collection", F.get_json_object("properties", "$.balance").cast("double").alias("balance"))


_BATCH = "(SELECT k + CASE WHEN k % 2 = 0 THEN 0 ELSE 100000000 END AS k, collection, balance + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS balance FROM items)"


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Of the items that are there a quarter unchanged and a quarter changed, and as many new ones as the other half."""
    k = F.col("c_custkey")
    return customers(spark, d, k + F.when(k % 2 == 0, 0).otherwise(100_000_000), F.col("c_acctbal").cast("double") + F.when(k % 4 == 0, 1.0).otherwise(0.0))


@_define("ingest_insert", f"WITH {CUSTOMERS} SELECT id, collection, balance FROM items")
def _(spark, d):
    catalog = _new(spark, d, customers(spark, d).filter("c_custkey % 3 <> 0"))
    catalog.load_items(customers(spark, d).filter("c_custkey % 3 = 0").select("doc"), Mode.insert)
    return _balances(catalog)


@_define("ingest_ndjson", f"WITH {CUSTOMERS} SELECT id, collection, balance FROM items")
def _(spark, d):
    """By way of NDJSON files, whose kind is recognised."""
    path = folder(spark, "ndjson")
    customers(spark, d).select("doc").write.text(path)
    return _balances(_new(spark, d, read_json(spark, path)))


@_define("ingest_stream", f"WITH {CUSTOMERS} SELECT id, collection, balance FROM items")
def _(spark, d):
    path = folder(spark, "stream")
    customers(spark, d).select("doc").repartition(3).write.text(path)
    catalog = _new(spark, d, None)
    ingest_stream(catalog, read_stream(spark, path, 2), folder(spark, "progress")).awaitTermination()
    return _balances(catalog)


@_define("ingest_ignore", f"WITH {CUSTOMERS} SELECT id, collection, balance + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS balance FROM items")
def _(spark, d):
    catalog = _new(spark, d, customers(spark, d).filter("c_custkey % 3 <> 0"))
    catalog.load_items(customers(spark, d, balance=F.col("c_acctbal").cast("double") + 1.0).select("doc"), Mode.ignore)
    return _balances(catalog)


def _upserted(spark: SparkSession, d: str, mode: Mode) -> Catalog:
    catalog = _new(spark, d, customers(spark, d))
    catalog.load_items(_batch(spark, d).select("doc"), mode)
    return catalog


_AFTER = f"SELECT CAST(k AS VARCHAR) AS id, collection, balance FROM {_BATCH} UNION ALL SELECT id, collection, balance FROM items WHERE k % 2 <> 0"


@_define("ingest_upsert", f"WITH {CUSTOMERS} {_AFTER}")
def _(spark, d):
    return _balances(_upserted(spark, d, Mode.upsert))


@_define("ingest_delsert", f"WITH {CUSTOMERS} {_AFTER}")
def _(spark, d):
    return _balances(_upserted(spark, d, Mode.delsert))


_TOMBSTONES = "SELECT id AS item_id, collection, strftime(datetime, '%Y') AS dt_bucket, datetime FROM items WHERE k %"


@_define("upsert_tombstones", f"WITH {CUSTOMERS} {_TOMBSTONES} 4 = 0")
def _(spark, d):
    return _upserted(spark, d, Mode.upsert).table("deleted").select("item_id", "collection", "dt_bucket", F.col("datetime").cast("timestamp_ntz").alias("datetime"))


@_define("delsert_tombstones", f"WITH {CUSTOMERS} {_TOMBSTONES} 2 = 0")
def _(spark, d):
    return _upserted(spark, d, Mode.delsert).table("deleted").select("item_id", "collection", "dt_bucket", F.col("datetime").cast("timestamp_ntz").alias("datetime"))


@_define("item_changes", f"WITH {CUSTOMERS} SELECT id, collection, CASE WHEN k = 2 THEN -1 ELSE balance END AS balance FROM items WHERE k <> 1 UNION ALL SELECT 'new', collection, 7 FROM items WHERE k = 3")
def _(spark, d):
    """Items deleted, updated and created one by one."""
    catalog = _new(spark, d, customers(spark, d))
    catalog.delete_item("1")
    for key, id, balance in (("2", "2", -1), ("3", "new", 7)):
        doc = catalog.get_item(key)
        doc = json.loads(json.dumps(doc)) | {"id": id}
        doc["properties"]["balance"] = balance
        (catalog.update_item if id == key else catalog.create_item)(doc)
    return _balances(catalog)


@_define("repartitioned", f"WITH {CUSTOMERS} SELECT collection, CASE WHEN collection = 'BUILDING' THEN strftime(datetime, '%Y%m') ELSE strftime(datetime, '%Y') END AS dt_bucket, count(*) AS n, min(datetime) AS dt_lo, max(datetime) AS dt_hi, CAST(min(x) AS DOUBLE) AS xmin, CAST(max(y) + 5 AS DOUBLE) AS ymax FROM items GROUP BY ALL")
def _(spark, d):
    catalog = _new(spark, d, customers(spark, d))
    catalog.repartition("BUILDING", "month")
    return catalog.stats().select("collection", "dt_bucket", "n", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("dt_lo", "dt_hi")], "xmin", "ymax")


@_define("collection_extents", f"WITH {CUSTOMERS} SELECT collection, CAST(min(x) AS DOUBLE) AS xmin, CAST(min(y) AS DOUBLE) AS ymin, CAST(max(x) + 5 AS DOUBLE) AS xmax, CAST(max(y) + 5 AS DOUBLE) AS ymax, strftime(min(datetime), '%Y-%m-%dT%H:%M:%SZ') AS lo, strftime(max(datetime), '%Y-%m-%dT%H:%M:%SZ') AS hi FROM items GROUP BY collection")
def _(spark, d):
    """As the collections' documents say after their update."""
    catalog = _new(spark, d, customers(spark, d))
    catalog.update_collection_extents()
    rows = [(c["id"], *map(float, c["extent"]["spatial"]["bbox"][0]), *c["extent"]["temporal"]["interval"][0]) for c in catalog.all_collections()]
    return spark.createDataFrame(rows, "collection string, xmin double, ymin double, xmax double, ymax double, lo string, hi string")


# Searches


def _found(spark: SparkSession, features: list[dict]) -> DataFrame:
    rows = [(k, f["id"], f["collection"], f["properties"]["datetime"], float(f["properties"]["balance"])) for k, f in enumerate(features)]  # a page
    return spark.createDataFrame(rows, "place int, id string, collection string, day string, balance double")


_FOUND = "CAST(row_number() OVER (ORDER BY @order) - 1 AS INTEGER) AS place, id, collection, strftime(datetime, '%Y-%m-%dT%H:%M:%SZ') AS day, balance"
_REQUEST = {"collections": ["BUILDING", "MACHINERY"], "datetime": "2020-03-01/2021-03-01", "filter": _op(">", P("balance"), 100), "sortby": [{"field": "datetime", "direction": "asc"}]}
_MATCH = "collection IN ('BUILDING', 'MACHINERY') AND datetime BETWEEN TIMESTAMP '2020-03-01' AND TIMESTAMP '2021-03-01' AND balance > 100"


def _by(order: str) -> str:
    return _FOUND.replace("@order", order)


@_define("search_documents", f"WITH {CUSTOMERS} SELECT {_by('datetime, id, collection')} FROM items WHERE {_MATCH} ORDER BY place LIMIT 50")
def _(spark, d):
    return _found(spark, Search(stored_customers(spark, d)).search(_REQUEST | {"limit": 50})["features"])


@_define("search_newest", f"WITH {CUSTOMERS} SELECT {_by('datetime DESC, id DESC, collection DESC')} FROM items WHERE x <= 20 AND x + 5 >= -20 AND y <= 20 AND y + 5 >= -20 ORDER BY place LIMIT 10")
def _(spark, d):
    """The default order and number, from the newest partitions."""
    return _found(spark, Search(stored_customers(spark, d)).search({"bbox": [-20, -20, 20, 20]})["features"])


@_define("search_third_page", f"WITH {CUSTOMERS}, placed AS (SELECT {_by('datetime, id, collection')} FROM items WHERE {_MATCH}) SELECT place - 14 AS place, id, collection, day, balance FROM placed WHERE place BETWEEN 14 AND 20")
def _(spark, d):
    """By the links from page to page."""
    search, page = Search(stored_customers(spark, d)), None
    for _ in range(3):
        page = search.search(_REQUEST | {"limit": 7, "token": page and page_token(page)})
    return _found(spark, page["features"])


@_define("search_back", f"WITH {CUSTOMERS}, placed AS (SELECT {_by('datetime, id, collection')} FROM items WHERE {_MATCH}) SELECT place, id, collection, day, balance FROM placed WHERE place BETWEEN 0 AND 6")
def _(spark, d):
    search = Search(stored_customers(spark, d))
    first = search.search(_REQUEST | {"limit": 7})
    second = search.search(_REQUEST | {"limit": 7, "token": page_token(first)})
    return _found(spark, search.search(_REQUEST | {"limit": 7, "token": page_token(second, "prev")})["features"])


@_define("search_matched", f"WITH {CUSTOMERS} SELECT (SELECT count(*) FROM items WHERE {_MATCH}) AS matched, least(50, (SELECT count(*) FROM items WHERE {_MATCH})) AS returned, (SELECT count(*) FROM items) AS estimate")
def _(spark, d):
    """Counted exactly, and of all items the estimate by the statistics."""
    search = Search(stored_customers(spark, d))
    got = search.search(_REQUEST | {"limit": 50, "conf": {"context": "on", "context_stats_ttl": 0}})
    every = search.search({"limit": 1, "conf": {"context": "auto", "context_estimated_count": 0, "context_stats_ttl": 0}})
    return spark.createDataFrame([(got["numberMatched"], got["numberReturned"], every["numberMatched"])], "matched long, returned long, estimate long")


@_define("search_by_hash", f"WITH {CUSTOMERS} SELECT id FROM items WHERE {_MATCH}")
def _(spark, d):
    """Registered by one, found and run by another who only knows the hash."""
    catalog = stored_customers(spark, d)
    key = Search(catalog).register(_REQUEST).hash
    other = Search(Catalog(spark, catalog.root))
    return other.plan(other.from_hash(key).search).matched.select("id")


@_define("search_histogram", f"WITH {CUSTOMERS} SELECT count(*) AS rows, CAST(min(datetime) AS VARCHAR) AS first_at, CAST(max(datetime) AS VARCHAR) AS last_at FROM items WHERE collection = 'BUILDING'")
def _(spark, d):
    """What search_plan says of where a search's rows lie, without running it."""
    got = Search(stored_customers(spark, d)).search_plan({"collections": ["BUILDING"]})
    return spark.createDataFrame([(round(got["histogram"].agg(F.sum("n")).first()[0]), got["first"], got["last"])], "rows long, first_at string, last_at string")


@_define("search_everything", f"WITH {CUSTOMERS} SELECT id, collection, balance FROM items WHERE nation = 7")
def _(spark, d):
    """All pages, one after the other."""
    got = Search(stored_customers(spark, d)).search_all({"filter": _op("=", P("nation"), 7), "limit": 40})  # streamed in; only the columns asked for are held
    return spark.createDataFrame([(f["id"], f["collection"], float(f["properties"]["balance"])) for f in got], "id string, collection string, balance double")


@_define("item_by_id", f"WITH {CUSTOMERS} SELECT id, collection, x, y, balance FROM items WHERE k IN (5, 77)")
def _(spark, d):
    catalog = stored_customers(spark, d)
    docs = [catalog.get_item("5"), catalog.get_item("77"), catalog.get_item("none")]
    return spark.createDataFrame([(f["id"], f["collection"], *f["bbox"][:2], float(f["properties"]["balance"])) for f in docs if f], "id string, collection string, x long, y long, balance double")


@_define("tile_search", f"WITH {CUSTOMERS}, tile AS (SELECT 4 * 45.0 - 180 AS x0, 5 * 45.0 - 180 AS x1, degrees(2 * atan(exp((1 - 4 / 4.0) * pi())) - pi() / 2) AS y0, degrees(2 * atan(exp((1 - 3 / 4.0) * pi())) - pi() / 2) AS y1) SELECT id FROM items, tile WHERE x <= x1 AND x + 5 >= x0 AND y <= y1 AND y + 5 >= y0 AND collection = 'BUILDING'")
def _(spark, d):
    """All items in a tile, by a registered search's key; covered ones too."""
    search = Search(stored_customers(spark, d))
    key = search.register({"collections": ["BUILDING"]}).hash
    got = xyz_search(search, 4, 3, 3, key, fields={"include": ["id"]}, scanlimit=None, limit=10**9, timelimit=3600, exitwhenfull=False, skipcovered=False)
    return spark.createDataFrame([(f["id"],) for f in got["features"]], "id string")


@_define("geometry_search", f"WITH {CUSTOMERS} SELECT id FROM items WHERE x <= 40 AND x + 5 >= 0 AND y <= 30 AND y + 5 >= 10 AND collection = 'BUILDING' ORDER BY datetime DESC, id DESC LIMIT 5")
def _(spark, d):
    """The newest few that meet a shape."""
    search = Search(stored_customers(spark, d))
    key = search.register({"collections": ["BUILDING"]}).hash
    shape = {"type": "Polygon", "coordinates": [[[0, 10], [40, 10], [40, 30], [0, 30], [0, 10]]]}
    got = geometry_search(search, shape, key, {"include": ["id"]}, limit=5, timelimit=3600, exitwhenfull=False, skipcovered=False)
    return spark.createDataFrame([(f["id"],) for f in got["features"]], "id string")


# Parts as items that share fragments of their type and brand


def parts(spark: SparkSession, d: str, title: Column | None = None) -> DataFrame:
    k = F.col("p_partkey")
    x, y = k * 3 % 300 - 150, k * 11 % 140 - 70
    doc = F.struct(
        k.cast("string").alias("id"), F.lit("Feature").alias("type"), F.lit("parts").alias("collection"), _box(x, y, 2).alias("geometry"), F.array(x, y, x + 2, y + 2).alias("bbox"),
        F.struct(F.lit("2021-06-01T00:00:00Z").alias("datetime"), F.col("p_size").alias("size"), F.col("p_type").alias("kind")).alias("properties"),
        F.struct(F.struct(F.concat(F.lit("h/"), k).alias("href"), (F.col("p_brand") if title is None else title).alias("title"), F.lit("image/png").alias("type")).alias("data")).alias("assets"),
        F.array(F.struct(F.lit("self").alias("rel"), F.concat(F.lit("u/"), k).alias("href"))).alias("links"),
    )
    return table(spark, d, "part").select("p_partkey", F.to_json(doc).alias("doc"))


_FRAGMENT = """'{"assets":{"data":{"title":"' || p_brand || '","type":"image/png"}},"properties":{"kind":"' || p_type || '"}}'"""


def _new_parts(spark: SparkSession, d: str) -> Catalog:
    catalog = Catalog(spark, folder(spark, "catalog"))
    catalog.create_collection({"id": "parts"}, fragment_config=["assets.data.title", "assets.data.type", "properties.kind"])
    catalog.load_items(parts(spark, d).select("doc"))
    return catalog


def stored_parts(spark: SparkSession, d: str) -> Catalog:
    return _read_only(spark, d, "parts", lambda: _new_parts(spark, d))


@_define("fragments_shared", f"SELECT {_FRAGMENT} AS content, count(*) AS n_items FROM part GROUP BY 1")
def _(spark, d):
    catalog = stored_parts(spark, d)
    used = catalog.items().groupBy(F.col("fragment_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n_items"))
    return catalog.table("fragments").join(used, "hash").select("content", "n_items")


@_define("items_dehydrated", "SELECT CAST(p_partkey AS VARCHAR) AS id, '{\"data\":{\"href\":\"h/' || p_partkey || '\"}}' AS assets, '{\"size\":' || p_size || '}' AS properties, 'u/' || p_partkey AS link FROM part")
def _(spark, d):
    """What is left in an item's own columns."""
    return stored_parts(spark, d).items().select("id", "assets", "properties", F.col("link_hrefs")[0].alias("link"))


_DOC = """'{"assets":{"data":{"href":"h/' || p_partkey || '","title":"' || p_brand || '","type":"image/png"}},"bbox":[' || x || ',' || y || ',' || x + 2 || ',' || y + 2 || '],"collection":"parts","geometry":{"coordinates":[[[' || x || ',' || y || '],[' || x + 2 || ',' || y || '],[' || x + 2 || ',' || y + 2 || '],[' || x || ',' || y + 2 || '],[' || x || ',' || y || ']]],"type":"Polygon"},"id":"' || p_partkey || '","links":[{"href":"u/' || p_partkey || '","rel":"self"}],"properties":{"datetime":"2021-06-01T00:00:00Z","kind":"' || p_type || '","size":' || p_size || '},"type":"Feature"}'"""


@_define("hydrate_documents", f"SELECT p_partkey AS k, {_DOC} AS doc FROM (SELECT *, p_partkey * 3 % 300 - 150 AS x, p_partkey * 11 % 140 - 70 AS y FROM part)")
def _(spark, d):
    """Whole documents, from their columns and fragments."""
    catalog = stored_parts(spark, d)
    return I.hydrate(catalog.items(), catalog.table("fragments"), None, "id").select(F.col("id").cast("long").alias("k"), "doc")


@_define("hydrate_fields", "SELECT p_partkey AS k, '{\"assets\":{\"data\":{\"title\":\"' || p_brand || '\"}},\"collection\":\"parts\",\"id\":\"' || p_partkey || '\",\"properties\":{\"size\":' || p_size || '}}' AS doc FROM part")
def _(spark, d):
    catalog = stored_parts(spark, d)
    return I.hydrate(catalog.items(), catalog.table("fragments"), {"include": ["id", "collection", "assets.data.title", "properties.size"]}, "id").select(F.col("id").cast("long").alias("k"), "doc")


@_define("gc_fragments", "SELECT 'parts' AS collection, count(*) AS removed, (SELECT count(*) FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 OR p_type = 'PROMO' THEN 'new' ELSE p_brand END, p_type FROM part)) AS remaining FROM (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING bool_and(p_size % 2 = 0 OR p_type = 'PROMO'))")
def _(spark, d):
    """Parts of even size, and all of one type, get another title; the fragments that nobody uses any more go."""
    catalog = _new_parts(spark, d)
    moved = table(spark, d, "part").filter("p_size % 2 = 0 or p_type = 'PROMO'").select("p_partkey")
    catalog.load_items(parts(spark, d, F.lit("new")).join(moved, "p_partkey").select("doc"), Mode.upsert)
    counts = catalog.gc_fragments(retention_days=0)
    return spark.createDataFrame([("parts", counts.get("parts", 0), catalog.table("fragments").count())], "collection string, removed long, remaining long")


@_define("fields_missing", "SELECT 'parts' AS collection, 'size' AS name, 'number' AS type FROM part LIMIT 1")
def _(spark, d):
    """Properties that no queryable speaks of."""
    return missing(stored_parts(spark, d).items(), ["kind"], 100.0).select("collection", "name", "type")


# Nations as collections


@_define("collection_search", "SELECT n_name AS id, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey * 10 - 150 <= 60 ORDER BY n_name LIMIT 10")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")

    def make() -> Catalog:
        catalog = Catalog(spark, folder(spark, "catalog"))
        rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n_nationkey").collect()  # a collection each
        catalog.load_collections([{"id": a, "title": b, "extent": {"spatial": {"bbox": [[k * 10 - 150, 0, k * 10 - 145, 5]]}, "temporal": {"interval": [["2020-01-01T00:00:00Z", None]]}}} for a, b, k in rows])
        return catalog

    got = Search(_read_only(spark, d, "nations", make)).collection_search({"filter": _op("in", P("title"), ["ASIA", "EUROPE"]), "bbox": [-180, -10, 60, 10], "datetime": "2021-01-01/.."})
    return spark.createDataFrame([(c["id"], c["title"]) for c in got["collections"]], "id string, title string")


@_define("queryables_of_collections", "SELECT 'balance' AS name, CAST(min(c_acctbal) AS DOUBLE) AS minimum, CAST(max(c_acctbal) AS DOUBLE) AS maximum FROM customer")
def _(spark, d):
    """Registered for each collection by itself, and merged into one schema."""
    from geolattice.operators.queryables import merged

    catalog = _new(spark, d, customers(spark, d))
    found = _balances(catalog).groupBy("collection").agg(F.min("balance").alias("lo"), F.max("balance").alias("hi")).collect()  # one row a collection
    registered = [Queryable("balance", {"type": "number", "minimum": r.lo, "maximum": r.hi}, collections=[r.collection]) for r in found]
    catalog.add_queryables(registered[:1])
    assert set(Catalog(spark, catalog.root).queryables()) == {"balance"}
    q = merged(registered, [r.collection for r in found])["properties"]["balance"]
    return spark.createDataFrame([("balance", float(q["minimum"]), float(q["maximum"]))], "name string, minimum double, maximum double")


@_define("tile_bounds", "SELECT round(4 * 45.0 - 180, 6) AS x0, round(5 * 45.0 - 180, 6) AS x1")
def _(spark, d):
    x0, _, x1, _ = tile_lonlat(3, 4, 3)
    return spark.createDataFrame([(round(float(x0), 6), round(float(x1), 6))], "x0 double, x1 double")


# What a document's columns are made of


def _rows(docs: DataFrame) -> DataFrame:
    """Columns of documents, as loading makes them."""
    return I.item_rows(I.dehydrate(docs.select("doc")))


_AT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


@_define("item_times", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 2 DAY ELSE o_orderdate END AS lo, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 DAY ELSE o_orderdate END AS hi, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS ranged FROM orders")
def _(spark, d):
    """A range if both ends are given, whatever datetime says; else datetime."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    text = lambda days: F.date_format(at + F.make_dt_interval(days=F.lit(days)), _AT)
    props = F.struct(F.when((k % 3 == 0) & (k % 2 == 0), None).otherwise(text(0)).alias("datetime"), F.when(k % 3 == 0, text(-2)).alias("start_datetime"), F.when(k % 3 == 0, text(5)).alias("end_datetime"))
    doc = F.struct(k.cast("string").alias("id"), F.lit("c").alias("collection"), F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("bbox"), props.alias("properties"))
    rows = _rows(table(spark, d, "orders").select(F.to_json(doc).alias("doc")))
    return rows.select(F.col("id").cast("long").alias("k"), F.col("datetime").cast("timestamp_ntz").alias("lo"), F.col("end_datetime").cast("timestamp_ntz").alias("hi"), F.col("datetime_is_range").alias("ranged"))


@_define("item_geometry", "SELECT s_suppkey AS k, CAST(s_suppkey % 90 AS DOUBLE) AS xmin, CAST(s_suppkey % 45 AS DOUBLE) AS ymin, CAST(s_suppkey % 90 + CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 1 END AS DOUBLE) AS xmax, CAST(s_suppkey % 45 + CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 1 END AS DOUBLE) AS ymax, CASE WHEN s_suppkey % 2 = 0 THEN 'Polygon' ELSE 'LineString' END AS kind FROM supplier")
def _(spark, d):
    """The geometry's own box; without a geometry, the bbox."""
    k = F.col("s_suppkey")
    x, y = k % 90, k % 45
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(x, y), F.array(x + 1, y + 1)).alias("coordinates"))
    doc = F.struct(k.cast("string").alias("id"), F.lit("c").alias("collection"), F.when(k % 2 != 0, line).alias("geometry"), F.when(k % 2 == 0, F.array(x, y, F.lit(-9), x + 3, y + 3, F.lit(9))).otherwise(F.array(x, y, x, y)).alias("bbox"), F.struct(F.lit("2020-01-01T00:00:00Z").alias("datetime")).alias("properties"))
    rows = _rows(table(spark, d, "supplier").select(F.to_json(doc).alias("doc")))
    return rows.select(F.col("id").cast("long").alias("k"), "xmin", "ymin", "xmax", "ymax", F.get_json_object("geometry", "$.type").alias("kind"))


@_define("item_promoted", "SELECT p_partkey AS k, CAST(p_retailprice AS DOUBLE) AS cloud, p_brand AS platform, string_split(p_name, ' ') AS instruments, p_size AS orbit, '{\"size\":' || p_size || '}' AS rest FROM part")
def _(spark, d):
    """Properties of their own columns, and what stays in the document."""
    k = F.col("p_partkey")
    names = {"datetime": F.lit("2020-01-01T00:00:00Z"), "eo:cloud_cover": F.col("p_retailprice").cast("double"), "platform": F.col("p_brand"), "instruments": F.split("p_name", " "), "sat:relative_orbit": F.col("p_size"), "size": F.col("p_size")}
    doc = F.struct(k.cast("string").alias("id"), F.lit("c").alias("collection"), F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("bbox"), F.struct(*[c.alias(n) for n, c in names.items()]).alias("properties"))
    rows = _rows(table(spark, d, "part").select(F.to_json(doc).alias("doc")))
    return rows.select(F.col("id").cast("long").alias("k"), F.col("eo_cloud_cover").alias("cloud"), "platform", "instruments", F.col("sat_relative_orbit").alias("orbit"), F.col("properties").alias("rest"))


@_define("collections_as_items", "SELECT n_name AS id, CAST(n_nationkey AS DOUBLE) AS xmin, CAST(n_nationkey + 9 AS DOUBLE) AS xmax, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2001-02-03' END AS lo, n_nationkey % 2 <> 0 AS always FROM nation")
def _(spark, d):
    """What a collection's extent says; without a start or an end it is there since, or for, all times."""
    from geolattice.operators.search import collections_as_items

    catalog = Catalog(spark, folder(spark, "catalog"))
    rows = table(spark, d, "nation").select("n_name", "n_nationkey").collect()  # a collection each
    catalog.load_collections([{"id": a, "extent": {"spatial": {"bbox": [[k, -1, k + 9, 1]]}, "temporal": {"interval": [["2001-02-03T00:00:00Z" if k % 2 == 0 else None, None]]}}} for a, k in rows])
    ever = F.year("datetime") < -100_000
    return collections_as_items(catalog.table("collections")).select("id", "xmin", "xmax", F.when(~ever, F.col("datetime").cast("timestamp_ntz")).alias("lo"), (ever & (F.year("end_datetime") > 100_000)).alias("always"))


@_define("partition_names", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y') AS by_year, strftime(o_orderdate, '%Y%m') AS by_month, '' AS by_none FROM orders")
def _(spark, d):
    from geolattice.operators.catalog import bucket

    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), *[bucket(F.col("o_orderdate"), F.lit(t)).alias(f"by_{n}") for n, t in (("year", "year"), ("month", "month"), ("none", ""))])


# JSON documents


def _json_udf(f: Callable) -> Callable:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(json.loads(x), json.loads(y)) for x, y in zip(a, b)], dtype=object)

    return run


def _two(spark: SparkSession, d: str) -> DataFrame:
    """A document of each part and one of the same size, type and name of another brand."""
    p = table(spark, d, "part")
    a = F.to_json(F.struct(F.struct("p_size", "p_brand").alias("in"), F.col("p_type").alias("kind"), F.split("p_name", " ").alias("tags")))
    b = F.to_json(F.struct(F.struct("p_size", F.lit("other").alias("p_brand")).alias("in"), F.lit("PROMO").alias("kind"), F.array(F.lit("x")).alias("tags")))
    return p.select("p_partkey", a.alias("a"), b.alias("b"))


@_define("json_common", """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '{"in":{"p_size":' || p_size || '},"kind":"PROMO"}' ELSE '{"in":{"p_size":' || p_size || '}}' END AS doc FROM part""")
def _(spark, d):
    """What two documents agree on."""
    from geolattice.functions import documents as D

    return _two(spark, d).select("p_partkey", _json_udf(lambda a, b: D.canonical(D.common(a, b)))("a", "b").alias("doc"))


@_define("json_merge", """SELECT p_partkey, '{"in":{"p_brand":"other","p_size":' || p_size || '},"kind":"PROMO","tags":["x"]}' AS doc FROM part""")
def _(spark, d):
    from geolattice.functions import documents as D

    return _two(spark, d).select("p_partkey", _json_udf(lambda a, b: D.canonical(D.merge(a, b)))("a", "b").alias("doc"))


@_define("json_set", """SELECT p_partkey, '{"in":{"new":{"deep":"' || p_brand || '"},"p_brand":"' || p_brand || '","p_size":' || p_size || '}}' AS doc FROM part""")
def _(spark, d):
    """A value set at a path whose parents aren't there."""
    from geolattice.functions import documents as D

    return _two(spark, d).select("p_partkey", _json_udf(lambda a, _: D.canonical(D.set_path({"in": a["in"]}, ["in", "new", "deep"], a["in"]["p_brand"])))("a", "b").alias("doc"))


_WHOLE = """'{"in":{"p_brand":"' || p_brand || '","p_size":' || p_size || '},"kind":"' || p_type || '","tags":["' || array_to_string(string_split(p_name, ' '), '","') || '"]}'"""


@_define("json_dehydrate_and_back", f"SELECT p_partkey, {_WHOLE} AS doc FROM part")
def _(spark, d):
    """What differs from another document, and the whole again from both."""
    from geolattice.functions import documents as D

    return _two(spark, d).select("p_partkey", _json_udf(lambda a, b: D.canonical(D.rehydrate(b, D.dehydrate(b, a))))("a", "b").alias("doc"))


@_define("json_leaves", "SELECT p_partkey, path, value FROM (SELECT p_partkey, unnest(['in.p_brand', 'in.p_size', 'kind', 'tags']) AS path, unnest(['\"' || p_brand || '\"', CAST(p_size AS VARCHAR), '\"' || p_type || '\"', '[\"' || array_to_string(string_split(p_name, ' '), '\",\"') || '\"]']) AS value FROM part)")
def _(spark, d):
    from geolattice.functions.aggregates import leaf_rows

    return leaf_rows(_two(spark, d), "a", "p_partkey").select("p_partkey", "path", "value")


@_define("json_scalars", "SELECT o_orderkey AS k, o_orderdate AS at, [o_orderpriority] AS one, ['a', o_orderstatus] AS many, o_orderkey % 3 <> 0 AS filled, o_orderkey % 2 = 0 AS hollow, abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01')) / 1000 AS ms FROM orders")
def _(spark, d):
    """Times, lists and emptiness of JSON values."""
    from geolattice.functions import columns as C

    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    filled = C.non_empty(F.when(k % 3 == 0, F.element_at(F.array(F.lit("null"), F.lit("{}"), F.lit("[]")), (k % 2 + 1).cast("int"))).otherwise(F.lit("7"))).isNotNull()
    hollow = C.empty_array(F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 != 2, F.array(F.lit("x"))))
    return table(spark, d, "orders").select(
        k.alias("k"), C.to_time(F.to_json(F.struct(F.date_format(at, _AT).alias("v"))).substr(6, 22), True).alias("at"), C.text_array(F.col("o_orderpriority")).alias("one"),
        C.text_array(F.to_json(F.array(F.lit("a"), F.col("o_orderstatus")))).alias("many"), filled.alias("filled"), hollow.alias("hollow"), C.age_ms(at.cast("timestamp"), F.lit("1995-01-01").cast("timestamp")).alias("ms"),
    )
