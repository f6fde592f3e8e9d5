import duckdb
import numpy as np
import pyarrow as pa
import pytest

from geolattice.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, code int, number int, h string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "y", 1, 2, "z") for i, v in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_sql(rows):
    embeddings = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})  # noqa: F841
    return sorted(duckdb.sql(E.SQL).fetchall(), key=str)


def clusters(seed, n=600, near=400, width=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    close = base[rng.integers(0, n, near)] + rng.normal(size=(near, width)) * rng.uniform(0.05, 0.3, (near, 1))
    crowd = base[:1] + rng.normal(size=(150, width)) * 0.1
    return np.vstack([base, close, crowd, base[:5]]).astype(np.float32)


@pytest.mark.parametrize("index_rows", [E.INDEX_ROWS, 200, 20, 4])
def test_same_as_sql_whatever_the_shares(spark, index_rows):
    """Classes, and all links of each vector, as brute force counts them."""
    rows = list(enumerate(clusters(0).tolist()))
    want = by_sql(rows)
    got = found(E.near_copies(table(spark, rows), index_rows=index_rows))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    a, b = sum(r[2] for r in got), sum(r[2] for r in want)
    assert all(x[2] <= y[2] for x, y in zip(got, want)) and b > 20_000 and a >= 0.999 * b


def test_recall_at_the_least_cosine(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = 0.951
    x = np.vstack([base, c * base + np.sqrt(1 - c * c) * side])
    got = found(E.near_copies(table(spark, list(enumerate(x.tolist())))))
    assert sum(r[2] == 1 for r in got) >= 0.98 * len(got) and all(r[2] <= 1 for r in got)


def test_every_width(spark):
    rows = [(k, v) for k, v in enumerate([*clusters(2, 80, 40, 3).tolist(), *clusters(3, 80, 40, 20).tolist(), *clusters(4, 40, 40, 100).tolist(), [1.0], [2.0], [-1.0], [1.0, 1.0], [1.0, 1.01]])]
    assert found(E.near_copies(table(spark, rows))) == by_sql(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0, 8.0]), (3, None), (4, [0.0] * 4), (5, [1.0, None, 1.0, 1.0]), (6, [float("nan")] * 4), (None, v), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [-1.0, -2.0, -3.0, -4.0]), (9, [-1.0, -2.0, -3.0, -4.0]), (10, []), (11, [float("inf"), 1.0]), (None, [0.0, -5.0])]
    got = found(E.near_copies(table(spark, rows)))
    assert got == by_sql(rows)
    assert (1, 1, 1) in got and (None, 1, 1) in got and (8, 7, 0) in got and got.count((9, 9, 0)) == 2 and (None, None, 0) in got
    assert found(E.near_copies(table(spark, []))) == [] and found(E.near_copies(table(spark, [(1, None)]))) == [(1, None, 0)]


def test_ids_of_any_type(spark):
    rows = list(enumerate(clusters(5, 60, 30).tolist()))
    plain = table(spark, rows)
    named = plain.withColumn("vec_id", plain.vec_id.cast("string"))
    assert sorted(r["n_links"] for r in E.near_copies(named).collect()) == sorted(r["n_links"] for r in E.near_copies(plain).collect())


def test_codes_are_balanced():
    x = np.random.default_rng(6).normal(size=(5000, 32)) * np.linspace(0.3, 3, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, project = E.learn(x, 32)
    c = E.codes(x, mean, project)
    assert all(0.45 < ((c >> np.uint64(k)) & np.uint64(1)).mean() < 0.55 for k in range(32))
