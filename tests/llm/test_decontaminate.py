import random

import numpy as np
import pytest

from geolattice.llm import decontaminate as D

from .conftest import WORDS, prose

ITEMS = "item_id long, text string"


def bench(spark, items):
    return spark.createDataFrame(items, ITEMS)


def planted(seed):
    """Items, documents, and which document holds which item: whole, or with a word in ten changed."""
    rng = random.Random(seed)
    items = [(k, " ".join(prose(rng, 1) + rng.choice("bdfgkmnprst") + rng.choice("aeiou") for _ in range(rng.randint(15, 50)))) for k in range(30)]
    rows, truth = [], set()
    for d in range(300):
        words = prose(rng, rng.randint(40, 400)).split()
        if d % 3 == 0:
            k = rng.randrange(30)
            item = items[k][1].split()
            if d % 2:
                item = [rng.choice(WORDS) if rng.random() < 0.1 else w for w in item]
            at = rng.randrange(len(words))
            words[at:at] = item
            truth.add((d, k))
        rows.append((d, " ".join(words).capitalize() + "."))
    return items, rows, truth


def test_finds_planted_passages_and_no_others(spark, docs):
    items, rows, truth = planted(1)
    table = docs(rows)
    indexes = D.build(spark, table, bench(spark, items))
    got = {(r["doc_id"], r["item_id"]) for r in D.findings(table, indexes).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and got <= truth
    kept = D.drop_contaminated(table, indexes)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got}


def test_same_in_parts(spark, docs, monkeypatch):
    items, rows, _ = planted(2)
    table = docs(rows)
    whole = {tuple(r) for r in D.findings(table, D.build(spark, table, bench(spark, items))).collect()}
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 7)
    parts = D.build(spark, table, bench(spark, items))
    assert len(parts) == 5
    assert {(a, b) for a, b, _ in map(tuple, D.findings(table, parts).collect())} == {(a, b) for a, b, _ in whole}


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 50)) + 0.01 * rng.normal(size=(80, 50))
    rows = [(list(range(50)), r.tolist()) for r in a]
    v = D.randomised_svd(spark, rows, 50, 6)
    want = np.linalg.svd(a)[2][:6].T
    assert np.linalg.norm(v @ v.T - want @ want.T) < 1e-3


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 30))], [rng.randrange(8) for _ in range(rng.randint(0, 60))]
        assert D.common(a, b, set())[0] == lcs(a, b)


def test_frequencies(spark, odd, docs):
    import pyarrow as pa

    rows = docs([(1, "a b a"), (2, "B c"), (3, None), (4, ""), (5, "c")])
    n, df = D.frequencies(rows, pa.array(["a", "b", "c", "z"], pa.large_string()))
    assert n == 5 and df.tolist() == [1, 2, 2, 0]
    assert D.frequencies(docs([]), pa.array(["a"], pa.large_string()))[1].tolist() == [0]


def test_odd_rows(spark, odd, docs):
    items = [(1, None), (2, ""), (3, "..."), (4, "lost words here"), (4, "lost words here"), (None, "one"), (5, "here words lost")]
    indexes = D.build(spark, odd, bench(spark, items))
    got = sorted((str(r["doc_id"]), r["item_id"], r["lcs"]) for r in D.findings(odd, indexes).collect())
    assert got == [("None", 4, 1.0)]
    assert D.drop_contaminated(odd, indexes).count() == odd.count() - 1
    assert D.build(spark, odd, bench(spark, [])) == [] and D.findings(odd, []).count() == 0
    assert D.drop_contaminated(odd, []).count() == odd.count()
    assert D.findings(docs([]), D.build(spark, docs([]), bench(spark, items))).count() == 0


def test_item_deep_in_a_long_text(spark, docs):
    rng = random.Random(8)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(20))
    table = docs([(1, prose(rng, 30_000) + " " + item + " " + prose(rng, 30_000)), (2, prose(rng, 500))])
    got = D.findings(table, D.build(spark, table, bench(spark, [(9, item)]))).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 9)]


def test_item_of_stop_words_is_found_as_a_run(spark, docs):
    rng = random.Random(4)
    item = "the one that all of these texts hold somewhere"
    rows = [(k, f"{prose(rng, 60)} {item} {prose(rng, 60)}") for k in range(80)] + [(k, " ".join(rng.sample(item.split(), 9)) + " " + prose(rng, 60)) for k in range(80, 100)]
    table = docs(rows)
    indexes = D.build(spark, table, bench(spark, [(1, item)]))
    assert not indexes[0].weight.any()
    assert {r["doc_id"] for r in D.findings(table, indexes).collect()} == set(range(80))


def test_ids_of_any_type(spark, docs):
    from pyspark.sql import functions as F

    items, rows, truth = planted(5)
    table = docs(rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    named = bench(spark, items).withColumn("item_id", F.concat(F.lit("i"), F.col("item_id")))
    got = {(r["doc_id"], r["item_id"]) for r in D.findings(table, D.build(spark, table, named)).collect()}
    assert len(got & {(f"d{a}", f"i{b}") for a, b in truth}) >= 0.95 * len(truth) and len(got) <= len(truth)


def accepted(item, needed, text):
    """Whether some window of the text (with the item's length on either side) holds the item, without any search for candidates."""
    for at in range(0, max(1, len(text)), D.WINDOW // 2):
        part = text[max(0, at - len(item)) : at + D.WINDOW + len(item)]
        share = lcs(item, part) / len(item)
        if share >= D.MIN_LCS and (share >= D.SURE_LCS or 2 * len(needed & set(part)) >= len(needed)):
            return True
    return False


@pytest.mark.parametrize("n", [200, 1500])
def test_prose_against_brute_force(spark, docs, n):
    """Items and documents of the same words, some frequent and most rare; copies with words changed, left out and put in."""
    rng = random.Random(n)
    vocabulary = [a + b for a in WORDS[:60] for b in WORDS[::4]]
    rng.shuffle(vocabulary)
    weights = [1 / (k + 3) for k in range(len(vocabulary))]
    natural = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    items = [(k, natural(rng.randint(12, 50))) for k in range(n)]
    rows, made = [], []
    for d in range(90):
        words, k = natural(rng.randint(40, 150)).split(), rng.randrange(n)
        rate = rng.choice([0, 0.1, 0.2, 0.3])
        item = [x for w in items[k][1].split() for x in ([] if rng.random() < rate / 3 else [natural(1)] if rng.random() < rate / 3 else [w, natural(1)] if rng.random() < rate / 3 else [w])]
        words[(at := rng.randrange(len(words))) : at] = item
        rows.append((d, " ".join(words)))
        made.append((d, k, rate))
    table = docs(rows)
    indexes = D.build(spark, table, bench(spark, items))
    got = {(r["doc_id"], r["item_id"]) for r in D.findings(table, indexes).collect()}
    answers = {}
    for index in indexes:
        for k, i in enumerate(index.ids.to_pylist()):
            answers[i] = {index.vocabulary[w].as_py() for w in index.answers[k]}
    assert {(d, k) for d, k, rate in made if rate == 0} <= got
    want = {(d, k) for d, k, _ in made if accepted(items[k][1].split(), answers[k], rows[d][1].split())}
    assert len(want & got) >= 0.97 * len(want) and len(want) > 70
    some = rng.sample([(d, k) for d, k in got], min(len(got), 60)) + [(rng.randrange(90), rng.randrange(n)) for _ in range(60)]
    for d, k in some:
        assert ((d, k) in got) == accepted(items[k][1].split(), answers[k], rows[d][1].split()) or (d, k) in want


def test_recall_of_a_thousand_items(spark, docs):
    rng = random.Random(12)
    items = [(k, " ".join(f"t{rng.randrange(20_000)}" for _ in range(rng.randint(15, 57)))) for k in range(1100)]
    rows, truth = [], {"verbatim": set(), "changed": set()}
    for d in range(400):
        words, k = prose(rng, rng.randint(60, 300)).split(), rng.randrange(1100)
        item = [rng.choice(WORDS) if d % 2 and rng.random() < 0.1 else w for w in items[k][1].split()]
        at = rng.randrange(len(words))
        words[at:at] = item
        truth["changed" if d % 2 else "verbatim"].add((d, k))
        rows.append((d, " ".join(words)))
    table = docs(rows)
    got = {(r["doc_id"], r["item_id"]) for r in D.findings(table, D.build(spark, table, bench(spark, items))).collect()}
    assert truth["verbatim"] <= got and len(truth["changed"] & got) >= 0.97 * len(truth["changed"])
    assert got <= truth["verbatim"] | truth["changed"]


def test_items_that_many_documents_hold_and_a_long_one(spark, docs):
    rng = random.Random(13)
    items = [(0, " ".join(f"s{rng.randrange(10**6)}" for _ in range(8))), (1, " ".join(f"l{rng.randrange(10**6)}" for _ in range(2000)))]
    items += [(k, " ".join(f"o{rng.randrange(400)}" for _ in range(30))) for k in range(2, 60)]
    rows = []
    for d in range(400):
        words = [f"o{rng.randrange(400)}" if rng.random() < 0.3 else f"u{d}x{j}" for j in range(200)]
        if d % 12 == 0:
            words[(at := rng.randrange(200)) : at] = items[0][1].split()
        if d in (5, 6):
            words[90:90] = items[1][1].split() if d == 5 else [w for w in items[1][1].split() if rng.random() < 0.9]
        rows.append((d, " ".join(words)))
    table = docs(rows)
    got = {(r["doc_id"], r["item_id"]) for r in D.findings(table, D.build(spark, table, bench(spark, items))).collect()}
    assert got == {(d, 0) for d in range(0, 400, 12)} | {(5, 1), (6, 1)}


def test_candidates_do_not_depend_on_the_number_of_documents(spark):
    import pyarrow as pa

    rng = random.Random(14)
    item = prose(rng, 12)
    text = " ".join(f"u{j}" for j in range(100)) + " " + item + " " + " ".join(f"v{j}" for j in range(100))
    for n in (10**4, 10**12):
        df = {w: n // 10 for w in item.split()}
        index = D._index(spark, {w: float(np.log((n + 1) / x)) for w, x in df.items()}, pa.array([7]), (item,), (item.split(),))
        assert D.matches(index, pa.array([text], pa.large_string())) == {(0, 0): 1.0}
