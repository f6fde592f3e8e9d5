import os

import pytest

from geolattice import suite

from .compare import database, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_same_as_sql(spark, db, name):
    assert not difference(suite.QUERIES[name](spark, SF), db, suite.SQL[name])


def test_names():
    assert set(suite.SQL) == set(suite.QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in suite.SQL if n.startswith(("t_", "s_", "triangle", "line"))))
def test_relations_hold_for_some_rows(name):
    """No relation is compared on rows of which none has it."""
    assert database(SF.replace("0.001", "0.01")).execute(f"SELECT count(*) FROM ({suite.SQL[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", ["search_collections", "cql2_gt", "search_datetime_interval", "bbox_intersects"])
def test_filters_reach_the_scan(spark, name):
    plan = suite.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "props" not in scan.split("ReadSchema")[1].split("\n")[0]
    if name in ("search_collections", "cql2_gt"):
        assert "PushedFilters: [" in scan and ("event_type" in scan.split("PushedFilters")[1] or "value" in scan.split("PushedFilters")[1])


def test_pages_are_a_top_k(spark):
    plan = suite.QUERIES["sort_multi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange range" not in plan
