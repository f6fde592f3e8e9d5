import json

import pytest
from pyspark.sql import functions as F

from geolattice.functions import documents as D
from geolattice.model import ITEM_SCHEMA, PROMOTED
from geolattice.operators import items as I
from geolattice.operators import catalog as C
from geolattice.operators.catalog import Catalog, Conflict, Duplicate, Missing, Mode, ReadOnly
from geolattice.operators.search import Search
from geolattice.plans.normalize import BadRequest

from .conftest import feature, group


@pytest.fixture()
def catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    c.create_collection(group("c"), "month")
    return c


def whole(catalog):
    return {(r["collection"], r["id"]): json.loads(r["doc"]) for r in I.hydrate(catalog.items(), catalog.table("fragments"), None, "collection", "id").collect()}


# Documents and rows

FULL = feature(
    "full", at=("2020-01-01T00:00:00.5Z", "2020-02-01T00:00:00Z"),
    **{"eo:cloud_cover": 59.0, "gsd": 0.25, "platform": "p", "instruments": ["a", "b"], "created": "2021-01-01T00:00:00Z", "proj:bbox": [1.5, 2, 3, 4], "sat:relative_orbit": 7, "file:size": 10**12, "custom": {"a": [1, {"b": None}]}, "bands": [{"n": 1}]},
) | {"assets": {"t": {"href": "h/1", "type": "png", "roles": ["x"]}}, "links": [{"rel": "self", "href": "u/1", "type": "json"}, {"rel": "root", "href": "r"}], "stac_extensions": ["e1"], "extra_member": {"z": 1}}


@pytest.mark.parametrize("config", [None, ["assets.t.type"], ["assets.t.type", "assets.t.roles", "properties.custom.a", "stac_version", "stac_extensions"], ["assets"]])
def test_row_and_back(spark, config):
    configs = spark.createDataFrame([("c", config)], "id string, fragment_config array<string>")
    docs = spark.createDataFrame([(D.canonical(FULL),), (D.canonical(feature("plain")),), (None,)], "doc string")
    split = I.dehydrate(docs, configs)
    got = {json.loads(r["doc"])["id"]: json.loads(r["doc"]) for r in I.hydrate(I.item_rows(split), I.fragments_of(split)).collect()}
    assert D.canonical(got["full"]) == D.canonical(FULL)
    assert D.canonical(got["plain"]) == D.canonical(feature("plain") | {"links": []})


def test_promoted_columns(spark):
    row = I.item_rows(I.dehydrate(spark.createDataFrame([(D.canonical(FULL),)], "doc string"))).first()
    assert row["eo_cloud_cover"] == 59 and row["instruments"] == ["a", "b"] and row["file_size"] == 10**12 and json.loads(row["proj_bbox"]) == [1.5, 2, 3, 4]
    assert json.loads(row["properties"]) == {"custom": {"a": [1, {"b": None}]}} and row["datetime_is_range"] and row["item_hash"] == D.digest(FULL)
    assert len(PROMOTED) == 37 and {p.column for p in PROMOTED} <= {f.name for f in ITEM_SCHEMA.fields}


@pytest.mark.parametrize("bad", [{"id": "x"}, feature("x") | {"geometry": None, "bbox": None}, feature("x", at=("2020-02-01", "2020-01-01")), feature(None)])
def test_bad_items(bad):
    with pytest.raises(ValueError):
        I.row_of(bad)


def test_far_years_and_long_fractions(catalog):
    catalog.create_items([feature("far", at="10000-01-01T00:00:00Z"), feature("wide", at=("2020-01-01T00:00:00Z", "99999-12-31T00:00:00Z")), feature("fine", at="2020-01-01T00:00:00.12345678901234567890123Z")])
    assert whole(catalog)[("c", "fine")]["properties"]["datetime"] == "2020-01-01T00:00:00.123457Z"
    assert catalog.items().filter("datetime > timestamp '9999-12-31'").count() == 1


def test_projection_leaves_the_fragments_alone(spark, catalog):
    assert not I.needs_fragment({"include": ["id", "properties.datetime", "properties.eo:cloud_cover"]})
    assert I.needs_fragment({"include": ["properties.other"]}) and I.needs_fragment(None) and I.needs_fragment({"include": ["assets"]})
    assert not I.needs_fragment({"exclude": ["assets", "properties", "links", "stac_version", "stac_extensions"]})
    plan = I.hydrate(catalog.items(), catalog.table("fragments"), {"include": ["id"]})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


# Loading


def test_modes(catalog):
    a, b, c = feature("a"), feature("b"), feature("d")
    assert catalog.create_items([a, b]) == 2
    with pytest.raises(Duplicate):
        catalog.create_items([feature("b", x=1), c])
    with pytest.raises(Duplicate):
        catalog.create_items([c, c])
    assert len(whole(catalog)) == 2
    assert catalog.load_items(catalog.docs(feature("b", x=1), c), Mode.ignore) == 1
    assert "x" not in whole(catalog)[("c", "b")]["properties"] and ("c", "d") in whole(catalog)
    assert catalog.upsert_items([a, feature("b", x=2), feature("e")]) == 2  # the one that is the same isn't written
    assert whole(catalog)[("c", "b")]["properties"]["x"] == 2
    assert [r["item_id"] for r in catalog.table("deleted").collect()] == ["b"]
    assert catalog.load_items(catalog.docs(a, feature("f")), Mode.delsert) == 2
    assert set(whole(catalog)) == {("c", x) for x in "abdef"} and catalog.table("deleted").count() == 2
    with pytest.raises(Missing):
        catalog.create_item(feature("z", collection="nowhere"))


def test_moving_to_another_partition(catalog):
    catalog.create_items([feature("a", at="2020-01-05T00:00:00Z"), feature("b", at="2020-01-06T00:00:00Z")])
    catalog.upsert_item(feature("a", at="2020-03-05T00:00:00Z"))
    assert sorted((r["dt_bucket"], r["id"]) for r in catalog.items().collect()) == [("202001", "b"), ("202003", "a")]
    assert {(r["dt_bucket"], r["n"]) for r in catalog.stats().collect()} == {("202001", 1), ("202003", 1)}


def test_items_one_by_one(catalog):
    catalog.create_collection(group("o"))
    catalog.create_items([feature("a"), feature("a", collection="o"), feature("b")])
    assert catalog.get_item("a", "o")["collection"] == "o" and catalog.item_by_id("a").count() == 2 and catalog.get_item("zz") is None
    with pytest.raises(Duplicate):
        catalog.delete_item("a")
    catalog.delete_item("a", "o")
    with pytest.raises(Missing):
        catalog.delete_item("a", "o")
    catalog.update_item(feature("b", v=9))
    assert catalog.get_item("b")["properties"]["v"] == 9
    with pytest.raises(Missing):
        catalog.update_item(feature("none"))


def test_fragments_are_kept_once_and_collected(catalog):
    shared = {"t": {"title": "T", "type": "png", "roles": ["r"]}}
    catalog.create_collection(group("f", item_assets=shared))
    doc = lambda k: feature(k, collection="f") | {"assets": {"t": {**shared["t"], "href": f"h/{k}"}}, "links": [{"rel": "self", "href": f"u/{k}"}]}
    catalog.create_items([doc("1"), doc("2")])
    catalog.create_item(doc("3"))
    assert catalog.table("fragments").count() == 1
    assert all(r["assets"] == '{"t":{"href":"h/%s"}}' % r["id"] for r in catalog.items().collect())
    assert catalog.get_item("2", "f") == doc("2")
    for k in "123":
        catalog.delete_item(k, "f")
    assert catalog.gc_fragments() == {} and catalog.gc_fragments(retention_days=0) == {"f": 1} and catalog.table("fragments").count() == 0
    assert catalog.gc_deleted() == 0 and catalog.gc_deleted(0) == 3


# Collections


def test_collections(catalog):
    with pytest.raises(Duplicate):
        catalog.create_collection(group("c"))
    with pytest.raises(Missing):
        catalog.update_collection(group("q"))
    with pytest.raises(BadRequest):
        catalog.create_collection(group("q"), "week")
    catalog.upsert_collection(group("c", title="new"))
    assert catalog.get_collection("c")["title"] == "new" and catalog.table("collections").first()["partition_trunc"] == "month"
    catalog.load_collections([group("c", title="old"), group("d")], Mode.ignore)
    assert [x["id"] for x in catalog.all_collections()] == ["c", "d"] and catalog.get_collection("c")["title"] == "new"
    catalog.create_item(feature("a"))
    catalog.delete_collection("c")
    assert catalog.items().count() == 0 and catalog.get_collection("c") is None
    with pytest.raises(Missing):
        catalog.delete_collection("c")


def test_odd_extents(catalog):
    catalog.create_collection({"id": "x", "extent": {"spatial": [[1, 2, 3, 4]], "temporal": [["2000-01-01T00:00:00Z", None]]}})
    r = catalog.table("collections").filter("id = 'x'").first()
    assert (r["xmin"], r["ymax"]) == (1, 4) and r["datetime"].year == 2000 and r["end_datetime"] is None
    catalog.create_collection({"id": "y"})
    assert catalog.table("collections").filter("id = 'y'").first()["geometry"] is None


@pytest.mark.parametrize("trunc, parts", [(None, 1), ("year", 3), ("month", 25)])
def test_repartition(catalog, trunc, parts):
    from datetime import date, timedelta

    days = [date(2020, 1, 1) + timedelta(weeks=k) for k in range(106)]
    catalog.create_items([feature(str(d), at=f"{d}T00:00:00Z") for d in days])
    catalog.repartition("c", trunc)
    assert catalog.stats().count() == parts and catalog.items().count() == 106 and catalog.stats().agg(F.sum("n")).first()[0] == 106


def test_extents(catalog):
    assert catalog.collection_extent("c") is None
    catalog.create_items([feature("a", at="2020-01-01T00:00:00Z", box=(0, 0, 1, 1)), feature("b", at=("2020-02-01T00:00:00Z", "2020-06-01T00:00:00Z"), box=(5, -5, 6, 6))])
    assert catalog.collection_bbox("c") == [0, -5, 6, 6]
    assert catalog.collection_temporal_extent("c") == ["2020-01-01T00:00:00Z", "2020-02-01T00:00:00Z"]
    catalog.update_collection_extents()
    assert catalog.get_collection("c")["extent"] == {"spatial": {"bbox": [[0, -5, 6, 6]]}, "temporal": {"interval": [["2020-01-01T00:00:00Z", "2020-06-01T00:00:00Z"]]}}


def test_queue_and_read_only(catalog):
    done = []
    catalog.settings.set("use_queue", True)
    catalog.run_or_queue("a", lambda: done.append(1))
    catalog.run_or_queue("a", lambda: done.append(2))
    catalog.run_or_queue("b", lambda: 1 / 0)
    assert done == [] and catalog.run_queued() == 2 and done == [1] and [h["error"] is None for h in catalog.queue_history] == [True, False]
    catalog.settings.set("readonly", True)
    with pytest.raises(ReadOnly):
        catalog.create_item(feature("a"))


def test_reopened(spark, catalog):
    catalog.create_item(feature("a"))
    again = Catalog(spark, catalog.root)
    assert again.get_item("a") == feature("a") | {"links": []}


# Storage


def everything(catalog):
    return sorted(r["id"] for r in catalog.items().collect()), catalog.table("deleted").count(), catalog.table("fragments").count(), catalog.manifest


@pytest.mark.parametrize("step", ["_store", "_append", "_measure", "_commit", "_publish"])
def test_a_load_that_dies_leaves_the_catalog_as_it_was(spark, catalog, monkeypatch, step):
    catalog.create_collection(group("f", item_assets={"t": {"type": "png"}}))
    doc = lambda k, **p: feature(k, collection="f", **p) | {"assets": {"t": {"type": "png", "href": k}}}
    catalog.create_items([doc("a"), doc("b")])
    before = everything(catalog)

    def die(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Catalog, step, die)
        for load in (lambda: catalog.upsert_items([doc("a", x=1), doc("c") | {"links": [{"rel": "x", "href": "y"}]}]), lambda: catalog.delete_item("a"), lambda: catalog.update_item(doc("b", x=2))):
            with pytest.raises(OSError):
                load()
    assert everything(Catalog(spark, catalog.root)) == before
    assert catalog._names("staging") == []
    catalog.upsert_items([doc("a", x=1), doc("c")])
    assert everything(catalog)[:2] == (["a", "b", "c"], 1)


def test_of_two_writers_one_is_told(spark, catalog):
    other = Catalog(spark, catalog.root)
    with pytest.raises(Conflict):
        with catalog._change() as manifest:
            other.create_item(feature("b"))
            catalog._commit(manifest, {}, {})
    assert [r["id"] for r in catalog.items().collect()] == ["b"]


def test_update_is_one_step(catalog):
    catalog.create_items([feature("a"), feature("b")])
    n = catalog._versions()[-1]
    catalog.update_item(feature("a", v=1, at="2021-05-05T00:00:00Z"))
    assert catalog._versions()[-1] == n + 1 and catalog.get_item("a")["properties"]["v"] == 1
    assert [(r["item_id"], r["dt_bucket"]) for r in catalog.table("deleted").collect()] == [("a", "202001")]


def test_a_large_partition_is_written_by_several_tasks(spark, catalog, monkeypatch):
    monkeypatch.setattr(C, "FILE_ROWS", 100)
    catalog.create_collection(group("big"))
    docs = [feature(str(k), collection="big", at=f"2020-01-{1 + k % 28:02d}T00:00:00Z") for k in range(950)]
    catalog.create_items(docs)
    (part,) = catalog.manifest["items"]
    files = [x for x in catalog._fs.listStatus(catalog._path(f"{catalog.root}/{part['paths'][0]}")) if x.getPath().getName().endswith(".parquet")]
    assert part["stats"][0] == 950 and 5 <= len(files) <= 10
    spans = sorted(tuple(spark.read.parquet(str(f.getPath())).agg(F.min("datetime"), F.max("datetime")).first()) for f in files)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # each file a range of time
    catalog.upsert_items([d | {"properties": d["properties"] | {"x": 1}} for d in docs[:3]])
    (part,) = catalog.manifest["items"]
    assert part["stats"][0] == 950 and catalog.items().count() == 950


def test_small_tables_grow_by_folders(catalog, monkeypatch):
    monkeypatch.setattr(C, "MOST_FOLDERS", 4)
    catalog.create_items([feature(str(k)) for k in range(6)])
    for k in range(6):
        catalog.delete_item(str(k))
        assert catalog.table("deleted").count() == k + 1 and len(catalog.manifest["tables"]["deleted"]) < 4


def test_vacuum(catalog):
    catalog.create_items([feature("a"), feature("b")])
    catalog.upsert_items([feature("a", x=1)])
    catalog.upsert_collection(group("c", title="t"))
    before = everything(catalog)
    assert catalog.vacuum() == 0 and catalog.vacuum(-1) >= 2
    assert everything(catalog) == before and len(catalog._names("items")) == 2
    assert catalog.vacuum(-1) == 0


def test_what_another_process_sees(spark, catalog):
    """Settings, registered searches, the queue and its history are stored."""
    catalog.settings.set("use_queue", True)
    catalog.create_items([feature("a"), feature("b", box=(5, 5, 6, 6))])
    key = Search(catalog).register({"collections": ["c"], "bbox": [0, 0, 2, 2]}).hash
    catalog.run_or_queue("extents")
    catalog.run_or_queue("nonsense")
    other = Catalog(spark, catalog.root)
    found = Search(other)
    assert found.from_hash(key).search == {"collections": ["c"], "bbox": [0, 0, 2, 2]} and found.register({"collections": ["c"], "bbox": [0, 0, 2, 2]}).usecount == 2
    assert found.page(found.from_hash(key).search).features[0]["id"] == "a"
    assert other.settings.flag("use_queue") and other.queue == ["extents", "nonsense"] and other.run_queued() == 2
    assert other.get_collection("c")["extent"]["spatial"] == {"bbox": [[0, 0, 6, 6]]}
    assert [(h["query"], h["error"] is None) for h in catalog.queue_history] == [("extents", True), ("nonsense", False)] and catalog.queue == []
    assert found.gc_searches() == 0 and found.gc_searches(-1) == 1
    with pytest.raises(BadRequest):
        Search(catalog).from_hash(key)


def test_counts_and_estimates(spark, catalog):
    catalog.create_items([feature(str(k), at=f"2020-01-{k + 1:02d}T00:00:00Z", box=(k, 0, k + 1, 1)) for k in range(21)])
    search = Search(catalog)
    tree = lambda r: search.plan(r).tree
    assert search.estimate(None) == 21 and search.estimate(tree({"collections": ["other"]})) == 0
    assert 9 <= search.estimate(tree({"datetime": "../2020-01-11T00:00:00Z"})) <= 11 and 4 <= search.estimate(tree({"bbox": [0, -5, 5, 5]})) <= 6
    half = {"datetime": "2020-01-01T00:00:00Z/2020-01-11T00:00:00Z", "conf": {"context": "auto", "context_estimated_count": 5}}
    assert search.page(half).matched == search.estimate(tree(half)) == 10
    few = half | {"bbox": [0, 0, 0.5, 0.5]}
    assert search.page(few).matched == 1  # few by the estimate, so counted
    assert Search(Catalog(spark, catalog.root)).from_hash(search.register(few).hash).count == 1


def test_analyze_and_violations(catalog):
    catalog.create_items([feature("a"), feature("b", at="2020-02-01T00:00:00Z")])
    assert catalog.violations().count() == 0 and catalog.analyze() == 0
    with catalog._change() as manifest:
        manifest["items"][0]["stats"][7] = 0.5
        manifest["items"][1]["bucket"] = "202003"
    assert {(r["id"], r["reason"]) for r in catalog.violations().collect()} == {("a", "outside its partition's statistics"), ("b", "outside its partition's statistics")}
    with catalog._change() as manifest:
        manifest["items"][1]["bucket"] = "202002"
    assert catalog.analyze("c") == 1 and catalog.violations().count() == 0
    with catalog._change() as manifest:
        manifest["items"][0]["paths"] *= 2
    assert ("a", "twice in its collection") in {(r["id"], r["reason"]) for r in catalog.violations().collect()}


def test_one_file_is_the_work_of_several_tasks(spark, tmp_path):
    """Documents of one split are dealt out before they are read."""
    path = str(tmp_path / "docs")
    rows = spark.range(0, 20_000, 1, 1).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("c").alias("collection"), F.array(*[F.lit(x) for x in (0, 0, 1, 1)]).alias("bbox"), F.struct(F.lit("2020-01-01T00:00:00Z").alias("datetime"), F.sha2(F.col("id").cast("string"), 512).alias("n")).alias("properties"))).alias("doc"))
    rows.write.parquet(path)
    read = spark.read.parquet(path)
    assert read.rdd.getNumPartitions() == 1
    split = I.dehydrate(read)
    assert split.select(F.spark_partition_id()).distinct().count() > 1 and split.select("id").distinct().count() == 20_000
