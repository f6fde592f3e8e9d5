import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geolattice.operators.bands import next_band
from geolattice.operators.catalog import partition_stats
from geolattice.operators.search import plan
from geolattice.plans.compile import OPS, Compiler
from geolattice.plans.envelope import envelope, partition_filter
from geolattice.plans.keyset import decode, encode
from geolattice.plans.normalize import BadRequest, from_cql1, from_query, prop, properties_in, search_tree
from geolattice.plans.properties import Queryable
from geolattice.plans.settings import Settings


def op(name, *args):
    return {"op": name, "args": list(args)}


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        a = rng.randrange(1000)
        x, y = rng.uniform(-170, 160), rng.uniform(-80, 70)
        rows.append((str(k), rng.choice("abc"), a * 86400, (a + rng.choice([0, 0, 5, 40])) * 86400, x, y, x + 5, y + 5, f'{{"n":{rng.randrange(50)},"t":"w{rng.randrange(5)}","eo:x":{rng.choice(["1.5", chr(34) + "2" + chr(34), "null"])}}}', rng.choice([None, 1.0, 2.0])))
    df = spark.createDataFrame(rows, "id string, collection string, s long, e long, xmin double, ymin double, xmax double, ymax double, properties string, m double")
    return df.select("*", F.timestamp_seconds("s").alias("datetime"), F.timestamp_seconds("e").alias("end_datetime")).drop("s", "e").cache()


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


# Normalisation


def test_tree_of_a_request():
    tree = search_tree({"ids": ["a"], "collections": ["c"], "datetime": "2020-01-01", "bbox": [0, 0, 1, 1], "q": "x", "query": {"p": {"gt": 1, "lt": 2}, "r": 5}})
    assert [a["op"] for a in tree["args"]] == ["in", "in", "anyinteracts", "s_intersects", "q", "and"]
    assert tree["args"][-1] == op("and", op("gt", prop("p"), 1), op("lt", prop("p"), 2), op("eq", prop("r"), 5)) == from_query({"p": {"gt": 1, "lt": 2}, "r": 5})
    assert search_tree({}) is None and search_tree({"ids": []}) == op("in", prop("id"), [])
    with pytest.raises(BadRequest):
        search_tree({"query": {"a": 1}, "filter": op("=", prop("a"), 1)})


def test_geometry_precedence():
    a, b = {"type": "Point", "coordinates": [1, 1]}, {"type": "Point", "coordinates": [2, 2]}
    assert search_tree({"intersects": a, "geometry": b, "bbox": [0, 0, 1, 1]})["args"][1] == a
    assert search_tree({"geometry": b, "bbox": [0, 0, 1, 1]})["args"][1] == b


def test_old_filters():
    old = {"and": [{"eq": [prop("a"), 1]}, {"intersects": [prop("geometry"), {"type": "Point", "coordinates": [0, 0]}]}]}
    assert from_cql1(old) == op("and", op("eq", prop("a"), 1), op("intersects", prop("geometry"), {"type": "Point", "coordinates": [0, 0]}))
    assert search_tree({"filter": old}) == from_cql1(old)
    assert properties_in(from_cql1(old)) == {"a", "geometry"}


# Compiling


def test_typed_comparisons(items):
    q = {"n": Queryable("n", {"type": "integer"})}
    as_number = ids(plan(items, {"filter": op(">", prop("n"), "9")}, q).matched)
    assert as_number == ids(items.filter("get_json_object(properties, '$.n') :: double > 9"))
    as_text = ids(plan(items, {"filter": op(">", prop("n"), "9")}).matched)
    assert as_text == ids(items.filter("get_json_object(properties, '$.n') > '9'")) != as_number
    assert ids(plan(items, {"filter": op("=", prop("eo:x"), 2)}).matched) == ids(items.filter("""get_json_object(properties, "$['eo:x']") = '2'"""))


def test_text_that_is_no_number_is_no_match(items):
    assert ids(plan(items, {"filter": op("<", prop("t"), 5)}).matched) == set()


def test_errors(items):
    for bad in (op("nope", prop("id"), 1), op("s_near", prop("geometry"), [0, 0, 1, 1]), {"interval": ["2020-01-01", ".."]}, op("t_sometimes", prop("datetime"), "2020-01-01")):
        with pytest.raises(BadRequest):
            plan(items, {"filter": bad, "filter-lang": "cql2-json"})
    with pytest.raises(BadRequest):
        plan(items, {"filter": op("=", prop("zzz"), 1), "conf": {"additional_properties": False}})
    plan(items, {"filter": op("=", prop("eo:cloud_cover"), 1), "conf": {"additional_properties": False}})


def test_own_operator(items):
    OPS["mod2"] = lambda a: (a % 2) == 0
    try:
        assert ids(plan(items, {"filter": op("mod2", prop("m"))}).matched) == ids(items.filter("m = 2"))
    finally:
        del OPS["mod2"]


def test_empty_in_and_no_restriction(items):
    assert ids(plan(items, {"ids": []}).matched) == set() and plan(items, {}).matched.count() == 300


# Envelopes


def leaf(rng):
    day = lambda: f"{1970 + rng.randrange(3)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    pair = sorted([day(), day()])
    return rng.choice(
        [
            op(rng.choice("t_before t_after t_meets t_metby t_overlaps t_overlappedby t_starts t_startedby t_during t_contains t_finishes t_finishedby t_equals t_disjoint t_intersects anyinteracts".split()), prop("datetime"), {"interval": pair}),
            op(rng.choice(["<", "<=", ">", ">="]), prop(rng.choice(["datetime", "end_datetime"])), {"timestamp": day()}),
            op(rng.choice(["=", "<", ">=", "like"]), prop("collection"), rng.choice("abc")), op("in", prop("collection"), rng.sample("abcd", 2)),
            op("s_" + rng.choice("intersects within contains disjoint overlaps".split()), prop("geometry"), [-50, -40, 60, 30]),
            op("<", prop("n"), rng.randrange(50)), op("between", prop("collection"), "a", "b"),
        ]
    )


def tree(rng, depth):
    if not depth or rng.random() < 0.3:
        return leaf(rng)
    name = rng.choice(["and", "or", "not"])
    return op(name, *[tree(rng, depth - 1) for _ in range(1 if name == "not" else rng.randint(1, 3))])


@pytest.mark.parametrize("seed", range(12))
def test_envelope_never_drops_a_row(items, seed):
    """Rows that match lie in partitions that pass; partitions are (collection, year) here."""
    rng = random.Random(seed)
    rows = items.withColumn("dt_bucket", F.date_format("datetime", "yyyy"))
    t = tree(rng, 3)
    env = envelope(t, ["a", "b", "c"])
    matched = {(r[0], r[1]) for r in rows.filter(Compiler(rows).where(t)).select("collection", "dt_bucket").distinct().collect()}
    passed = {(r[0], r[1]) for r in partition_stats(rows).filter(partition_filter(env, lambda x: F.lit(x + "Z").cast("timestamp"))).select("collection", "dt_bucket").collect()}
    assert matched <= passed


def test_envelope_prunes():
    e = envelope(op("and", op("=", prop("collection"), "a"), op("anyinteracts", prop("datetime"), "1970-06-01/1970-07-01"), op("s_intersects", prop("geometry"), [0, 0, 1, 1])))
    assert e.collections == {"a"} and e.start == [(None, "1970-07-01T00:00:00.000000")] and e.end == [("1970-06-01T00:00:00.000000", None)] and e.box == (0, 0, 1, 1)
    assert envelope(op("and", op("=", prop("collection"), "a"), op("=", prop("collection"), "b"))).is_empty()
    assert envelope(op("not", op("=", prop("collection"), "a"))).collections is None
    assert envelope(op("t_meets", prop("datetime"), "1970-06-01/1970-07-01")).end == [(None, "1970-06-01T00:00:00.000000")]


# Tokens and pages


@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_characters="\x1e\x1f", codec="utf-8"), max_size=8)), min_size=1, max_size=4))
@settings(max_examples=100)
def test_tokens(values):
    assert decode(encode(values)) == values


@pytest.mark.parametrize("token", ["!!!", "a", "/w=="])
def test_bad_tokens(items, token):
    with pytest.raises(BadRequest):
        plan(items, {"token": token})


@pytest.mark.parametrize("sortby", [[{"field": "m", "direction": "asc"}], [{"field": "m", "direction": "desc"}, {"field": "datetime", "direction": "asc"}], ["-datetime"], ["+t", "-m"], None])
def test_pages_make_the_whole_and_lead_back(items, sortby):
    request = {"sortby": sortby} if sortby else {}
    whole = [r["id"] for r in plan(items, request).page(1000).select("id").collect()]
    assert len(whole) == 300
    names = None

    def page(token):
        nonlocal names
        p = plan(items, request | {"token": token})
        names = [f"k{n}" for n in range(len(p.keys))]
        text = [(F.date_format(k.column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if k.dtype.startswith("timestamp") else k.column.cast("string")).alias(n) for n, k in zip(names, p.keys)]
        return p.page(90).select("id", *text).collect()

    seen, token, starts = [], None, []
    while rows := page(token):
        starts.append(rows)
        seen += [r["id"] for r in rows]
        token = "next:" + encode([rows[-1][n] for n in names])
    assert seen == whole
    back = page("prev:" + encode([starts[2][0][n] for n in names]))[::-1]
    assert [r["id"] for r in back] == [r["id"] for r in starts[1]]


def test_bands():
    assert next_band([5, 0, 10, 1], 0, 4) == (0, 0) and next_band([1, 0, 10, 1], 0, 4) == (0, 2) and next_band([1, 1], 0, 50) == (0, 1) and next_band([0] * 40, 3, 1, 18) == (3, 20)


def test_settings(spark):
    s = Settings(spark, {"context": "on"})
    assert s.get("context") == "on" and s.get("context", {"context": "auto"}) == "auto" and s.flag("additional_properties")
    spark.conf.set("geolattice.context", "off")
    try:
        assert s.get("context") == "off"
    finally:
        spark.conf.unset("geolattice.context")
