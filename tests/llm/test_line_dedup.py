import random

import duckdb

from geolattice.llm import line_dedup as L


def brute(rows, ratio, least):
    from collections import Counter

    totals, counts = Counter(), Counter()
    for _, text, _, host in rows:
        totals[host] += 1
        counts.update({(host, x.strip(" ")) for x in (text or "").split("\n")})
    bad = {k for k, n in counts.items() if k[1] and n >= least and n > totals[k[0]] * ratio}
    out = []
    for i, text, _, host in rows:
        out.append((i, None if text is None else "\n".join(x for x in text.split("\n") if not x.strip(" ") or (host, x.strip(" ")) not in bad)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    lines = [f"line {k}" for k in range(60)]
    return [(k, "\n".join(rng.choice([rng.choice(lines[:5]), " " + rng.choice(lines[:3]) + " ", rng.choice(lines), ""]) for _ in range(rng.randint(1, 8))), "en", rng.choice(["a", "b", None])) for k in range(200)]


def test_same_as_brute_force(spark, docs):
    rows = corpus(1)
    got = L.drop_lines(docs(rows), 0.2, 4)
    assert got.columns == docs(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute(rows, 0.2, 4)
    assert any(t != r[1] for (_, t), r in zip(brute(rows, 0.2, 4), sorted(rows, key=str)))


def test_ratio_itself_stays(spark, docs):
    rows = [(k, "same" if k < 5 else f"own {k}", "en", "h") for k in range(10)]
    assert {r["text"] for r in L.drop_lines(docs(rows), 0.5, 2).collect() if r["doc_id"] < 5} == {"same"}
    assert {r["text"] for r in L.drop_lines(docs(rows), 0.49, 2).collect() if r["doc_id"] < 5} == {""}


def test_odd_rows(spark, odd, docs):
    """Of three pages without a host two are the same, so they share their line; no other host's pages share any."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    got = L.drop_lines(odd, dropped_col="n_dropped")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute(rows, L.RATIO, L.MIN_PAGES)
    assert sorted(r["doc_id"] for r in got.collect() if r["n_dropped"]) == [4, 4]
    assert L.drop_lines(docs([])).count() == 0


def test_the_ratio_alone_decides_on_hosts_of_any_size(spark, docs):
    """A line on one page stays, one on two of 99 and on two of two goes, one on two of 101 stays."""
    rows = [(k, f"own {k}\nshared" if k < 2 else f"own {k}", "en", "two") for k in range(2)]
    rows += [(100 + k, f"own {k}\nshared" if k < 2 else f"own {k}", "en", "hundred") for k in range(99)]
    rows += [(300 + k, f"own {k}\nshared" if k < 2 else f"own {k}", "en", "more") for k in range(101)] + [(500, "alone", "en", "one")]
    got = {r["doc_id"]: r["text"] for r in L.drop_lines(docs(rows)).collect()}
    assert got[0] == "own 0" and got[100] == "own 0" and got[300] == "own 0\nshared" and got[500] == "alone"
    assert sorted(got.items()) == brute(rows, L.RATIO, L.MIN_PAGES)


def test_sql_says_the_same(spark, docs, tmp_path):
    rows = corpus(2)
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, con.sql(L.SQL).fetchall()))
    got = L.query(spark, str(tmp_path))
    assert sorted(str((r["doc_id"], r["source"], r["text"], r["n_dropped"])) for r in got.collect()) == want
