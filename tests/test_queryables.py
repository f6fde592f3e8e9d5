import pytest
from pyspark.sql import functions as F

from geolattice.functions import aggregates as A
from geolattice.operators import queryables as Q
from geolattice.operators.catalog import Catalog, Duplicate, Missing
from geolattice.plans.properties import Queryable

from .conftest import group


@pytest.fixture()
def items(spark):
    rows = [("c", '{"a":1,"o":{"x":1,"y":"t"},"l":[1],"gsd":3}'), ("c", '{"a":2,"o":{"x":1,"y":"u"},"n":null}'), ("d", '{"a":"s","b":true}')]
    return spark.createDataFrame(rows, "collection string, properties string")


def test_missing(items):
    got = {(r["collection"], r["name"]): (r["type"], r["wrapper"]) for r in Q.missing(items, ["b"], 100).collect()}
    assert got == {("c", "a"): ("number", "to_float"), ("c", "o"): ("object", "to_text"), ("c", "l"): ("array", "to_text_array"), ("c", "n"): ("string", "to_text"), ("d", "a"): ("string", "to_text")}


def test_registry(items):
    first = Q.field_registry(items)
    got = {(r["collection"], r["path"]): (r["is_leaf"], r["kinds"]) for r in first.collect()}
    assert got[("c", "o")] == (False, ["object"]) and got[("c", "o.x")] == (True, ["number"]) and got[("c", "n")] == (True, ["null"])
    more = items.sparkSession.createDataFrame([("c", '{"a":"text"}')], "collection string, properties string")
    again = Q.field_registry(more, first)
    assert {r["path"]: r["kinds"] for r in again.filter("collection = 'c'").collect()}["a"] == ["number", "string"]
    kept, counts = Q.refresh_registry(again.withColumn("last_seen", F.when(F.col("collection") == "d", F.lit("2000-01-01").cast("timestamp")).otherwise(F.col("last_seen"))))
    assert {r["collection"] for r in kept.collect()} == {"c"} and counts.first()["n_fields"] == 7


def test_merged():
    qs = [Queryable("p", {"type": "number", "minimum": 1, "maximum": 5, "enum": [1, 2]}, collections=["c"]), Queryable("p", {"type": "number", "minimum": 0, "maximum": 9, "enum": [2, 3]}, collections=["d"])]
    both = Q.merged(qs, ["c", "d"])["properties"]["p"]
    assert both == {"type": "number", "minimum": 0, "maximum": 9, "enum": [1, 2, 3]}
    assert Q.merged(qs, ["c", "d"], ["c"])["properties"]["p"]["maximum"] == 5 and Q.merged(qs, ["c", "d"], ["zz"]) is None
    assert {"id", "datetime", "geometry", "eo:cloud_cover"} <= set(Q.merged([], [])["properties"])


def test_from_schema():
    schema = {"properties": {"id": {"type": "string"}, "s": {"type": "string"}, "n": {"type": "number"}, "i": {"type": "integer"}, "d": {"type": "string", "format": "date-time"}, "l": {"type": "array"}}}
    got = {q.name: q for q in Q.from_schema(schema, ["c"], ["n"])}
    assert {k: q.wrapper for k, q in got.items()} == {"s": "to_text", "n": "to_float", "i": "to_int", "d": "to_tstz", "l": "to_text_array"} and got["n"].index and not got["s"].index


def test_registering(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "q"))
    c.create_collection(group("c"))
    c.add_queryables([Queryable("a", {"type": "number"}), Queryable("b", {}, collections=["c"])])
    with pytest.raises(Missing):
        c.add_queryables([Queryable("x", {}, collections=["zz"])])
    with pytest.raises(Duplicate):
        c.add_queryables([Queryable("x", {}), Queryable("x", {}, collections=["c"])])
    c.add_queryables([Queryable("a", {"type": "string"})])
    assert set(c.queryables()) == {"a", "b"} and c.queryables()["a"].definition == {"type": "string"}
    c.add_queryables([Queryable("z", {})], delete_missing=True)
    assert set(c.queryables()) == {"z"}


def test_extensions(spark):
    docs = spark.createDataFrame([('{"stac_extensions":["https://x/a.json#","https://x/b.json"]}',), ('{"stac_extensions":["https://x/a.json"]}',), ("{}",)], "content string")
    assert {r["url"] for r in Q.extension_urls(docs).collect()} == {"https://x/a.json", "https://x/b.json"}
    ext = spark.createDataFrame([("https://x/a.json", '{"definitions":{"fields":{"properties":{"x:a":{"$ref":"#/definitions/d"}}}}}')], "url string, content string")
    assert Q.extension_queryables(ext).collect() == [("x:a", '{"$ref": "https://x/a.json#/definitions/d"}')]
    assert Q.signature("a", ["d", "c"]) == "a:c,d"


def test_aggregates(spark):
    docs = spark.createDataFrame([(1, '{"a":1,"b":{"c":"x","d":2}}'), (1, '{"a":1.0,"b":{"c":"y","d":2}}'), (2, '{"a":3}')], "g int, doc string")
    assert {r["g"]: r["paths"] for r in A.common_paths(docs, "doc", "g").collect()} == {1: ["a", "b.d"], 2: ["a"]}
    assert A.common_paths(docs, "doc").collect() == [] or A.common_paths(docs, "doc").first()["paths"] == []
    vals = spark.createDataFrame([(1, "[1,2]", None), (2, "[2,3]", "5"), (3, "[]", "null"), (4, None, "4.5")], "k int, l string, v string")
    r = vals.agg(A.array_unique_merge(F.col("l")).alias("l"), A.json_min(F.col("v")).alias("lo"), A.json_max(F.col("v")).alias("hi"), A.first_not_null(F.col("v"), F.col("k")).alias("f")).first()
    assert (r["l"], r["lo"], r["hi"], r["f"]) == (["1", "2", "3"], 4.5, 5.0, "5")
    assert {r["path"] for r in A.leaf_rows(docs, "doc", "g").collect()} == {"a", "b.c", "b.d"}
