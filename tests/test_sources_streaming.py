import json
import struct

from geolattice.functions import documents as D
from geolattice.operators.catalog import Catalog
from geolattice.sources.readers import read_dehydrated, read_json, read_ndjson
from geolattice.streaming.ingest import counts_by_window, distinct_within, ingest_stream, read_stream

from .conftest import feature, group


def ids(df):
    return sorted(json.loads(r["doc"])["id"] for r in df.collect())


def test_json_files(spark, tmp_path):
    docs = [feature("a"), feature("b")]
    (tmp_path / "n.ndjson").write_text("\n".join(map(json.dumps, docs)) + "\n\n")
    (tmp_path / "array.json").write_text(json.dumps(docs, indent=1))
    (tmp_path / "fc.json").write_text(json.dumps({"type": "FeatureCollection", "features": docs}, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(docs[0], indent=1))
    assert ids(read_ndjson(spark, str(tmp_path / "n.ndjson"))) == ["a", "b"]
    for name, want in (("n.ndjson", ["a", "b"]), ("array.json", ["a", "b"]), ("fc.json", ["a", "b"]), ("one.json", ["a"])):
        assert ids(read_json(spark, str(tmp_path / name))) == want, name
    assert ids(read_json(spark, [docs[0], json.dumps(docs[1]), json.dumps(feature("c")).encode()])) == ["a", "b", "c"]


def test_dehydrated_dump(spark, tmp_path):
    wkb = struct.pack("<BIIdd", 1, 0x20000001, 4326, 1.0, 2.0).hex()
    base = {"assets": {"t": {"type": "png", "title": "T"}}, "stac_version": "1.0.0", "gone": 1}
    content = {"assets": {"t": {"href": "h"}}, "properties": {"note": "tab\there"}, "gone": D.MARKER}
    (tmp_path / "d.tsv").write_text(f"i1\t{wkb}\tc\t2020-01-01T00:00:00Z\t2020-01-01T00:00:00Z\t{json.dumps(content, ensure_ascii=False)}\ni2\t{wkb}\td\t2020-01-01T00:00:00Z\t2020-02-01T00:00:00Z\t{{\"a\":\t1}}\n")
    got = {(d := json.loads(r["doc"]))["id"]: d for r in read_dehydrated(spark, str(tmp_path / "d.tsv"), {"c": base}).collect()}
    assert got["i1"]["assets"] == {"t": {"type": "png", "title": "T", "href": "h"}} and "gone" not in got["i1"] and got["i1"]["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}
    assert got["i1"]["properties"] == {"note": "tab\there", "datetime": "2020-01-01T00:00:00Z"} and got["i2"]["a"] == 1 and got["i2"]["properties"]["end_datetime"] == "2020-02-01T00:00:00Z"


def test_stream_of_files(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    c.create_collection(group("c"))
    folder = tmp_path / "in"
    folder.mkdir()
    for k, docs in enumerate([[feature("a"), feature("b")], [feature("b", x=1), feature("c")]]):
        (folder / f"{k}.ndjson").write_text("\n".join(map(json.dumps, docs)))
        ingest_stream(c, read_stream(spark, str(folder)), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["id"] for r in c.items().collect()) == ["a", "b", "c"] and c.get_item("b")["properties"]["x"] == 1


def test_windows_and_repeats(spark, tmp_path):
    schema = "k string, at timestamp"
    rows = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 00:10:00"), ("b", "2020-01-02 00:00:00"), ("b", "2020-01-02 05:00:00")], "k string, at string").selectExpr("k", "cast(at as timestamp) at")
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    for name, make, mode in (("counts", lambda s: counts_by_window(s, "at", "k"), "complete"), ("distinct", lambda s: distinct_within(s, ["k"], "at", "1 hour"), "append")):
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "rows")))
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {(r["k"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 2)}
    assert sorted(r["k"] for r in spark.table("distinct").collect()) == ["a", "b"]
