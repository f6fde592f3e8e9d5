import random

import numpy as np
import pyarrow as pa
import pytest

from geolattice.llm import simhash_dedup as S
from geolattice.llm._text import texts_of
from geolattice.llm.components import components

from .conftest import WORDS, prose


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def corpus(seed, n=150):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(n)]
    for k in range(60):
        texts.append(edited(rng, texts[rng.randrange(n)], rng.choice([0, 0.02, 0.05])))
    return texts


def pairs_within(fp, most):
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    return np.nonzero(np.triu(d <= most, 1))


def test_gray_rank_orders_the_code():
    code = np.array([k ^ (k >> 1) for k in range(1000)], np.uint64)
    assert S.gray_rank(code).tolist() == list(range(1000))


def test_tree_finds_all_and_only_near_words():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 12)).astype(np.uint64)
    words = np.unique(np.concatenate([base, *[np.bitwise_xor.reduce(flips[:, :k], axis=1) ^ base for k in range(1, 12)]]))
    tree = S.GrayTree(np.zeros(len(words), np.int64), words)
    got = set()
    every = np.arange(len(words))
    tree.known(every)
    for q, e in tree.search(every, np.zeros(len(words), np.int64), words, 9, np.full(len(words), -1), every):
        got |= set(zip(q.tolist(), e.tolist()))
    assert got == set()  # all of one label: nothing to look for
    tree.known(every)
    for q, e in tree.search(every, np.zeros(len(words), np.int64), words, 9, every.copy(), every):
        got |= set(zip(q.tolist(), e.tolist()))
    d = np.bitwise_count(words[:, None] ^ words[None])
    assert got == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(d <= 9))) if a != b}


def near(fp):
    """All pairs that are near copies by definition, one by one."""
    apart = fp[:, None] ^ fp[None]
    words = np.bitwise_count(apart)
    parts = np.bitwise_count(apart.view(np.uint16).reshape(len(fp), len(fp), 4, 4)).min(3)
    meets = ((parts <= S.FLIPS) & (words <= S.WORD_BITS)).any(2)
    return np.nonzero(np.triu(meets & (words.sum(2) <= S.MAX_BITS), 1))


def groups_of(fp):
    return S._link(np.arange(len(fp)), *near(fp))


@pytest.mark.parametrize("index_rows", [S.INDEX_ROWS, 50, 3, 1])
def test_groups_against_brute_force(spark, docs, index_rows):
    """The same, complete groups however many tasks share an index."""
    texts = corpus(3) + ["other words " * 3, "other words " * 4]
    fp, _ = S.fingerprints(texts_of(pa.array(texts, pa.large_string())))
    want = {k: r for k, r in enumerate(groups_of(fp).tolist()) if k != r}
    got = {r["id"]: r["root"] for r in S.copies(docs(list(enumerate(texts))), index_rows=index_rows).collect()}
    assert got == want and len(want) > 40


@pytest.mark.parametrize(("n", "index_rows"), [(3000, S.INDEX_ROWS), (10**6, S.INDEX_ROWS), (10**8, S.INDEX_ROWS)])
def test_links_do_not_depend_on_the_number_of_documents(spark, n, index_rows):
    """Pairs at every distance up to MAX_BITS, searched as n fingerprints would be: all that are near by definition, nine in ten of all."""
    rng = np.random.default_rng(4)
    pairs = 1500
    bits = rng.integers(0, 2, (2 * pairs, 256), np.uint8)
    for k in range(pairs):
        bits[pairs + k] = bits[k]
        bits[pairs + k, rng.choice(256, S.MAX_BITS - k % 20, replace=False)] ^= 1
    fp = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    table = spark.createDataFrame([(k, *row) for k, row in enumerate(fp.view(np.int64).tolist())], "id long, w0 long, w1 long, w2 long, w3 long").repartition(2)
    got = {(min(r), max(r)) for r in S.links(table, n, index_rows=index_rows).collect()}
    a, b = near(fp)
    assert got == set(zip(a.tolist(), b.tolist()))  # each fingerprint has one partner at most
    assert np.mean([(k, pairs + k) in got for k in range(pairs)]) >= 0.9
    assert np.mean([(k, pairs + k) in got for k in range(0, pairs, 20)]) >= 0.85


def test_no_pair_within_the_threshold_is_left_out(spark):
    """Pairs at each distance up to MAX_BITS and beyond, the bits spread evenly over all words and quarters, or at random: those within it, no other."""
    rng = np.random.default_rng(12)
    pairs = 2000
    bits = rng.integers(0, 2, (2 * pairs, 256), np.uint8)
    bits[pairs:] = bits[:pairs]
    for k in range(pairs):
        n = S.MAX_BITS + 1 - k % 20
        even = [16 * (j % 16) + j // 16 for j in range(n)]  # no quarter within one bit, few words within 12
        bits[pairs + k, even if k % 2 else rng.choice(256, n, replace=False)] ^= 1
    fp = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    table = spark.createDataFrame([(k, *row) for k, row in enumerate(fp.view(np.int64).tolist())], "id long, w0 long, w1 long, w2 long, w3 long").repartition(2)
    want = {(k, pairs + k) for k in range(pairs) if k % 20}
    for index_rows in (S.INDEX_ROWS, 300):
        assert {(min(r), max(r)) for r in S.links(table, len(fp), index_rows=index_rows).collect()} == want
    few = {(k, pairs + k) for k in range(pairs) if S.MAX_BITS + 1 - k % 20 <= 40}
    assert {(min(r), max(r)) for r in S.links(table, len(fp), max_bits=40).collect()} == few


@pytest.mark.parametrize("m", [0, 4, 5, 6, 8])
def test_any_number_of_parts_finds_the_same(spark, m, monkeypatch):
    monkeypatch.setattr(S, "PARTS", [(float("inf"), m)])
    rng = np.random.default_rng(13)
    bits = np.repeat(rng.integers(0, 2, (150, 256), np.uint8), 3, 0)
    for row in bits:
        row[rng.choice(256, rng.integers(0, 40), replace=False)] ^= 1
    fp = np.unique(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), axis=0)
    table = spark.createDataFrame([(k, *row) for k, row in enumerate(fp.view(np.int64).tolist())], "id long, w0 long, w1 long, w2 long, w3 long")
    got = {r["id"]: r["root"] for r in components(S.links(table, len(fp))).collect()}
    want = S._link(np.arange(len(fp)), *pairs_within(fp, S.MAX_BITS))
    assert [got.get(k, k) for k in range(len(fp))] == want.tolist() and (want != np.arange(len(fp))).sum() > 100


@pytest.mark.parametrize("index_rows", [S.INDEX_ROWS, 100])
def test_a_crowd_of_near_copies_that_all_differ(spark, index_rows):
    """Thousands within a few bits of one fingerprint, a chain that leads away from it, and others: the groups of brute force."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, 256, np.uint8)
    crowd = np.repeat(base[None], 4000, 0)
    for row in crowd:
        row[rng.choice(256, rng.integers(1, 12), replace=False)] ^= 1
    chain = [base.copy()]
    for _ in range(6):
        step = chain[-1].copy()
        step[rng.choice(256, 25, replace=False)] ^= 1
        chain.append(step)
    bits = np.unique(np.concatenate([crowd, chain, rng.integers(0, 2, (500, 256), np.uint8)]), axis=0)
    rng.shuffle(bits)
    fp = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    table = spark.createDataFrame([(k, *row) for k, row in enumerate(fp.view(np.int64).tolist())], "id long, w0 long, w1 long, w2 long, w3 long").repartition(3)
    found = S.links(table, len(fp), index_rows=index_rows)
    assert found.count() < 40 * 16 * len(fp)  # not all pairs
    got = {r["id"]: r["root"] for r in components(found).collect()}
    want = groups_of(fp)
    assert [got.get(k, k) for k in range(len(fp))] == want.tolist() and (want == want[list(want).index(np.bincount(want).argmax())]).sum() > 3700


def test_ids_of_any_type(spark, docs):
    from pyspark.sql import functions as F

    texts = corpus(6)
    plain = docs(list(enumerate(texts)))
    named = plain.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    want = {(f"d{r['id']:05}", f"d{r['root']:05}") for r in S.copies(plain).collect()}
    assert {tuple(r) for r in S.copies(named).collect()} == want and want
    assert S.drop_copies(named).count() == len(texts) - len(want)


def test_recall_of_edited_copies_and_rest_is_left(spark, docs):
    rng = random.Random(9)
    texts = [prose(rng, 120) for _ in range(200)]
    copies = [edited(rng, t, 0.05) for t in texts[:100]]
    got = {r["id"]: r["root"] for r in S.copies(docs(list(enumerate(texts + copies)))).collect()}
    assert sum(got.get(200 + k) == k for k in range(100)) >= 95
    assert all(k >= 200 for k in got)


def test_result_does_not_depend_on_shares(spark, docs):
    rows = docs(list(enumerate(corpus(5))))
    one = {tuple(r) for r in S.copies(rows).collect()}
    assert one == {tuple(r) for r in S.copies(rows, index_rows=8).collect()} and one


def test_thousands_of_copies_are_one_group(spark, docs):
    rng = random.Random(11)
    text = prose(rng, 100)
    rows = [(k, text if k % 2 else edited(rng, text, 0.01)) for k in range(2000)]
    got = {r["id"]: r["root"] for r in S.copies(docs(rows)).collect()}
    assert set(got) == set(range(1, 2000)) and set(got.values()) == {0}


def test_odd_rows(spark, odd, docs):
    got = sorted((r["id"], r["root"]) for r in S.copies(odd).collect())
    assert got == [(7, 4)]
    kept = S.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "4", "5", "6", "8", "None"]
    assert S.drop_copies(docs([])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = [(None, 1), (1, None), (2, 2), (3, 2), (2, 3)]
    assert {tuple(r) for r in components(spark.createDataFrame(odd, "a long, b long")).collect()} == {(3, 2), (2, 2)}
    hub = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5100)]
    assert {tuple(r) for r in components(spark.createDataFrame(hub, "a long, b long")).collect()} == {(k, 0) for k in range(3000)} | {(k, 5000) for k in range(5000, 5101)}
