import random

import pytest

from geolattice.operators.catalog import Catalog
from geolattice.operators.search import Search, page_token
from geolattice.operators.tiles import geojson_search, geometry_search, xyz_search
from geolattice.plans.normalize import BadRequest

from .conftest import feature, group

DAY = [f"2020-{m:02d}-{d:02d}T00:00:00Z" for m in range(1, 7) for d in (1, 9, 17)]


def docs():
    rng = random.Random(3)
    out = []
    for k in range(90):
        x, y = rng.randrange(-20, 20), rng.randrange(-20, 20)
        out.append(feature(f"{k:03d}", rng.choice(["c", "d"]), DAY[k % 18], (x, y, x + 4, y + 4), **{"eo:cloud_cover": rng.randrange(5) if k % 7 else None, "n": k % 10, "title": rng.choice(["Old bridges", "New towers"])}))
    return out


DOCS = docs()


@pytest.fixture(scope="module")
def search(spark, tmp_path_factory):
    c = Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    c.create_collection(group("c", title="Towers", keywords=["tall", "stone"]), "month")
    c.create_collection(group("d", title="Bridges"), "year")
    c.create_items(DOCS)
    return Search(c)


def ids(page):
    return [f["id"] for f in page["features"]]


def by_time(rows):
    return [d["id"] for d in sorted(rows, key=lambda d: (d["properties"]["datetime"], d["id"], d["collection"]), reverse=True)]


def test_feature_collection(search):
    got = search.search()
    assert got["type"] == "FeatureCollection" and got["numberReturned"] == 10 and "numberMatched" not in got
    assert ids(got) == by_time(DOCS)[:10] and got["features"][0] == next(d for d in DOCS if d["id"] == ids(got)[0]) | {"links": []} or got["features"][0]["properties"].get("eo:cloud_cover") is None
    assert [x["rel"] for x in got["links"]] == ["root", "self", "next"] and all(x["href"].startswith(".") for x in got["links"])


@pytest.mark.parametrize("request_", [{}, {"sortby": [{"field": "datetime", "direction": "asc"}]}, {"sortby": ["+eo:cloud_cover", "-datetime"]}, {"collections": ["d"], "datetime": "2020-02-01/2020-05-01"}])
def test_pages_forth_and_back(search, request_):
    whole = ids(search.search(request_ | {"limit": 1000}))
    pages, token = [], None
    while True:
        got = search.search(request_ | {"limit": 17, "token": token})
        pages.append(got)
        if (token := page_token(got)) is None:
            break
    assert [i for p in pages for i in ids(p)] == whole
    for before, page in reversed(list(zip(pages, pages[1:]))):
        assert ids(search.search(request_ | {"limit": 17, "token": page_token(page, "prev")})) == ids(before)
    assert page_token(pages[0], "prev") is None


def test_all_pages_at_once(search):
    assert [f["id"] for f in search.search_all({"limit": 40})] == by_time(DOCS)
    assert len(list(search.search_all({"limit": 40}, 50))) == 50


def test_first_page_reads_the_nearest_partitions_only(search):
    p = search.plan({})
    first = next(search._bands(p, 5))
    read = lambda x: len(x.rows.inputFiles())
    assert 0 < read(first) < read(p)
    plans = list(search._bands(p, 5))
    assert read(plans[-1]) == read(p)
    assert [r["id"] for r in first.page(5).collect()] == by_time(DOCS)[:5]


def test_partitions_are_pruned(search):
    files = lambda r: len(search.plan(r).rows.inputFiles())
    assert files({"collections": ["c"], "datetime": "2020-03-01/2020-03-20"}) == 1 < files({"collections": ["c"]}) < files({})
    assert files({"collections": ["zz"]}) == 0 and search.search({"collections": ["zz"]})["features"] == []


def test_fields(search):
    got = search.search({"ids": ["001"], "fields": {"include": ["properties.n"]}})["features"][0]
    assert got == {"id": "001", "collection": got["collection"], "properties": {"n": 1}}
    assert "assets" not in got and "geometry" not in search.search({"ids": ["001"], "fields": {"exclude": ["geometry"]}})["features"][0]


def test_filters(search):
    want = {d["id"] for d in DOCS if d["properties"]["n"] > 5 and d["collection"] == "c"}
    tree = {"op": "and", "args": [{"op": ">", "args": [{"property": "n"}, 5]}, {"op": "=", "args": [{"property": "collection"}, "c"]}]}
    assert set(ids(search.search({"filter": tree, "limit": 100}))) == want == set(ids(search.search({"query": {"n": {"gt": 5}, "collection": {"eq": "c"}}, "limit": 100})))
    inside = {d["id"] for d in DOCS if d["bbox"][0] >= -10 and d["bbox"][1] >= -10 and d["bbox"][2] <= 10 and d["bbox"][3] <= 10}
    assert set(ids(search.search({"filter": {"op": "s_within", "args": [{"property": "geometry"}, [-10, -10, 10, 10]]}, "limit": 100}))) == inside
    assert len(ids(search.search({"filter": {"op": "isNull", "args": [{"property": "eo:cloud_cover"}]}, "limit": 100}))) == 13


def test_counts(search):
    assert search.search({"conf": {"context": "on"}, "collections": ["c"]})["numberMatched"] == sum(d["collection"] == "c" for d in DOCS)
    assert search.search({"conf": {"context": "auto", "context_estimated_count": 10}})["numberMatched"] == 90
    p = search.plan({"collections": ["d"]})
    assert search.count({"collections": ["d"], "conf": {"context": "on"}}, p) == sum(d["collection"] == "d" for d in DOCS)
    kept = search.register({"collections": ["d"]})
    kept.count = 7
    search._store(kept)
    assert search.count({"collections": ["d"], "conf": {"context": "on"}}, p) == 7  # within its time to live
    assert search.count({"collections": ["d"], "conf": {"context": "on", "context_stats_ttl": 0}}, p) != 7


def test_registered_searches(search):
    a = search.register({"collections": ["c"], "limit": 5})
    assert search.register({"collections": ["c"], "sortby": ["-id"], "limit": 7}).hash == a.hash and search.from_hash(a.hash).usecount >= 2
    assert search.register({"collections": ["c"]}, {"name": "x"}).hash != a.hash
    with pytest.raises(BadRequest):
        search.from_hash("none")


def test_search_plan(search):
    got = search.search_plan({"collections": ["c"], "limit": 3})
    assert got["rows"].count() == 3 and got["estimate"] == got["matched"].count() == sum(d["collection"] == "c" for d in DOCS)
    assert got["keys"] == [("datetime", "desc"), ("id", "desc"), ("collection", "desc")] and got["histogram"].count() == 6
    assert got["first"] == "2020-01-01 00:00:00" and got["last"] == "2020-06-17 00:00:00"


def test_collection_search(search):
    got = search.collection_search({})
    assert [c["id"] for c in got["collections"]] == ["c", "d"] and got["numberMatched"] == 2
    assert [c["id"] for c in search.collection_search({"q": "bridge"})["collections"]] == ["d"]
    assert [c["id"] for c in search.collection_search({"q": "stones"})["collections"]] == ["c"]
    first = search.collection_search({"limit": 1})
    second = search.collection_search({"limit": 1, "token": page_token(first)})
    assert [c["id"] for c in second["collections"]] == ["d"] and page_token(second) is None
    assert search.collection_search({"fields": {"include": ["title"]}})["collections"][0] == {"id": "c", "title": "Towers"}
    assert search.collection_search({"bbox": [0, 0, 1, 1], "datetime": "2021-01-01/.."})["numberMatched"] == 2


def test_tiles(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "t"))
    c.create_collection(group("g"))
    cells = [feature(f"{x}{y}", "g", f"2020-01-{1 + x * 4 + y:02d}T00:00:00Z", (x * 2, y * 2, x * 2 + 2, y * 2 + 2)) for x in range(4) for y in range(4)]
    c.create_items([*cells, feature("under", "g", "2019-01-01T00:00:00Z", (0, 0, 8, 8))])
    s = Search(c)
    key = s.register({"collections": ["g"]}).hash
    area = {"type": "Polygon", "coordinates": [[[0.5, 0.5], [3.5, 0.5], [3.5, 3.5], [0.5, 3.5], [0.5, 0.5]]]}
    assert ids(geometry_search(s, area, key)) == ["11", "10", "01", "00"]
    assert ids(geometry_search(s, area, key, exitwhenfull=False, skipcovered=False)) == ["11", "10", "01", "00", "under"]
    assert ids(geometry_search(s, area, key, limit=2)) == ["11", "10"] and ids(geometry_search(s, area, key, scanlimit=1)) == ["11"] and len(ids(geometry_search(s, area, key, scanlimit=None))) == 4
    assert ids(geojson_search(s, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 1]}}, key)) == ["00", "under"]
    got = xyz_search(s, 8, 7, 4, key, fields={"include": ["id"]})
    assert got["features"][0] == {"id": "33", "collection": "g"}
    assert ids(xyz_search(s, 0, 0, 4, key)) == []


def test_all_pages_are_one_pass(search, monkeypatch):
    """The pages after the first cost one plan, however many they are."""
    plans, plan = [], Search.plan
    monkeypatch.setattr(Search, "plan", lambda self, request: plans.append(request) or plan(self, request))
    for request in ({"limit": 4}, {"limit": 4, "sortby": ["+eo:cloud_cover", "-datetime"]}, {"limit": 4, "fields": {"include": ["properties.n"]}}):
        plans.clear()
        got = [f["id"] for f in search.search_all(request)]
        assert len(plans) == 2 and got == ids(search.search(request | {"limit": 1000}))
    first = search.search({"limit": 4})
    second = search.search({"limit": 4, "token": page_token(first)})
    assert [f["id"] for f in search.search_all({"limit": 4, "token": page_token(second, "prev")})] == by_time(DOCS)
    assert [f["id"] for f in search.search_all({"limit": 4, "token": page_token(second)}, 11)] == by_time(DOCS)[8:19]
    assert [len(list(search.search_all({"limit": 4}, n))) for n in (0, 3, 4, 5)] == [0, 3, 4, 5]
