import os
import random
from itertools import combinations

import pytest

from geolattice.llm import _tokens, packing as P


def brute(lengths, counts, buckets):
    best = None
    n = len(lengths)
    for k in range(1, min(buckets, n) + 1):
        for c in combinations(range(n - 1), k - 1):
            ends = [*c, n - 1]
            start = pad = 0
            for e in ends:
                pad += sum((lengths[e] - lengths[i]) * counts[i] for i in range(start, e + 1))
                start = e + 1
            best = pad if best is None else min(best, pad)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 5)
        ends, padding = P.boundaries(lengths, counts, k)
        assert padding == brute(lengths, counts, k)
        assert len(ends) <= k and ends[-1] == lengths[-1]
        assert padding == sum((min(e for e in ends if e >= n) - n) * c for n, c in zip(lengths, counts))
    assert P.boundaries([], [], 3) == ([], 0)


def check(rows, budget):
    batches = {}
    for r in rows:
        assert r["n_tokens"] <= r["padded_to"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for batch in batches.values():
        assert len(batch) == 1 or len(batch) * batch[0]["padded_to"] <= budget
    for bucket in {b for b, _ in batches}:
        sizes = [len(batches[k]) for k in sorted(batches) if k[0] == bucket]
        assert len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]  # all full but the last
        assert [k[1] for k in sorted(batches) if k[0] == bucket] == list(range(len(sizes)))


@pytest.mark.parametrize("part_rows", [10**6, 7])
def test_batches(spark, part_rows):
    rng = random.Random(6)
    rows = [(i, rng.choice([3, 5, 5, 5, 8, 40, 41, 300])) for i in range(500)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 3, 200, part_rows=part_rows).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == rows
    check(got, 200)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_one_order_whatever_the_parts(spark, kind):
    """Every document's batch is the one that counting through (length, id) gives."""
    rng = random.Random(7)
    ids = rng.sample(range(10_000), 600) + [5, 5, 5, None, None]
    rows = [(None if i is None else i if kind == "long" else f"{i:x}", rng.choice([3, 3, 3, 8, 9])) for i in ids]
    want = []
    for n in (3, 8, 9):
        want += sorted((r for r in rows if r[1] == n), key=lambda r: (r[0] is not None, r[0]))
    want = sorted(((*r, k // 5) for k, r in enumerate(want)), key=str)
    for part_rows in (10**6, 100, 9, 1):
        got = P.pack(spark.createDataFrame(rows, f"doc_id {kind}, n_tokens long"), 1, 45, part_rows=part_rows).collect()
        # rows of one id and length are alike
        assert sorted(((r["doc_id"], r["n_tokens"], r["batch"]) for r in got), key=str) == want


def test_order_is_by_length_then_id(spark):
    rows = [(3, 5), (1, 5), (2, 5), (4, 2)]
    got = sorted((r["batch"], r["n_tokens"], r["doc_id"]) for r in P.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 1, 10).collect())
    assert got == [(0, 2, 4), (0, 5, 1), (1, 5, 2), (1, 5, 3)]


@pytest.mark.skipif(not os.path.exists(_tokens.VOCABULARY), reason="no vocabulary file")
def test_odd_rows(spark, odd, docs):
    got = P.pack(_tokens.with_lengths(odd.select("doc_id", "text"))).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"]: r["n_tokens"] for r in got}[1] == 0
    check(got, P.BUDGET)
    assert P.pack(_tokens.with_lengths(docs([]).select("doc_id", "text"))).count() == 0
