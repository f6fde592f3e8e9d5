import json

import pytest

from geolattice import cli

from .conftest import feature, group


@pytest.fixture()
def say(spark, tmp_path, capsys):
    """Runs a command on one catalog; what it says, and whether it went well."""

    def call(command, *arguments):
        code = cli.main([str(tmp_path / "catalog"), command, *map(str, arguments)])
        said = capsys.readouterr()
        return [json.loads(x) for x in said.out.splitlines()] if code == 0 else said.err

    return call


def lines(tmp_path, name, docs):
    path = tmp_path / name
    path.write_text("\n".join(map(json.dumps, docs)))
    return path


def test_from_loading_to_searching(say, tmp_path):
    collections = lines(tmp_path, "c.ndjson", [group("a", stac_extensions=["https://x/s.json#y"]), group("b")])
    items = lines(tmp_path, "i.ndjson", [feature(str(k), "ab"[k % 2], f"2020-0{1 + k % 6}-01T00:00:00Z", (k, 0, k + 1, 1), n=k) for k in range(12)])
    assert say("load-collections", collections, "--partition", "month") == [{"collections": 2}]
    assert [c["id"] for c in say("collections")] == ["a", "b"]
    assert say("load", items) == [{"items": 12}] and say("load", items, "--mode", "upsert") == [{"items": 0}]
    assert "Duplicate" in say("load", items)
    assert say("get", "3")[0]["properties"]["n"] == 3 and say("get", "99") == []
    page = say("search", json.dumps({"collections": ["a"], "limit": 2, "conf": {"context": "on"}}))[0]
    assert page["numberMatched"] == 6 and len(page["features"]) == 2
    assert {f["id"] for f in say("search-all", '{"collections": ["a"], "limit": 2}', "--most", 5)} <= {"0", "2", "4", "6", "8", "10"}
    assert [c["id"] for c in say("collection-search", '{"ids": ["b"]}')[0]["collections"]] == ["b"]
    key = say("register", '{"collections": ["b"]}')[0]["hash"]
    shape = json.dumps({"type": "Polygon", "coordinates": [[[2.5, 0.2], [3.5, 0.2], [3.5, 0.5], [2.5, 0.5], [2.5, 0.2]]]})
    assert [f["id"] for f in say("shape", key, shape)[0]["features"]] == ["3"]
    assert len(say("tile", key, 0, 0, 0)[0]["features"]) > 0
    assert "BadRequest" in say("shape", "unknown", shape)


def test_upkeep(say, tmp_path):
    say("load-collections", lines(tmp_path, "c.ndjson", [group("a", stac_extensions=["https://x/s.json#y"])]))
    say("load", lines(tmp_path, "i.ndjson", [feature(str(k), "a", f"2020-0{1 + k % 3}-01T00:00:00Z", (k, 0, k + 1, 1), n=k, t="x") for k in range(12)]))
    assert {(m["name"], m["type"]) for m in say("missing-queryables", "--percent", 100)} == {("n", "number"), ("t", "string")}
    schema = tmp_path / "q.json"
    schema.write_text(json.dumps({"properties": {"n": {"type": "integer"}, "id": {"type": "string"}}}))
    say("load-queryables", schema)
    assert say("queryables", "--collection", "a")[0]["properties"]["n"] == {"type": "integer"} and say("queryables", "--collection", "zz") == []
    assert say("extensions") == [{"url": "https://x/s.json"}]
    assert len(say("stats")) == 1 and say("repartition", "a", "--partition", "month") == [] and len(say("stats")) == 3
    assert say("violations") == [] and say("analyze") == [{"changed": 0}]
    say("set", "use_queue", "true")
    assert say("extents") == [] and say("history") == [] and say("run-queue") == [{"ran": 1}] and say("history")[0]["error"] is None
    assert say("collections")[0]["extent"]["spatial"]["bbox"] == [[0, 0, 12, 1]]
    assert say("delete", "5") == [] and "Missing" in say("delete", "5")
    assert say("gc", "--days", 0)[0]["deleted"] == 1 and say("vacuum", "--hours", -1)[0]["folders"] > 0
    assert len(say("search-all", "{}")) == 11
    assert say("delete-collection", "a") == [] and say("collections") == [] and say("search-all", "{}") == []
