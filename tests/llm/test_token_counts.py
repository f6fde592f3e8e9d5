import os

import pytest

from geolattice.llm import _tokens, token_counts as T

pytestmark = pytest.mark.skipif(not os.path.exists(_tokens.VOCABULARY), reason="no vocabulary file")


def test_same_as_brute_force(spark, odd):
    enc = _tokens.encoding(_tokens.VOCABULARY)
    lengths = sorted(len(enc.encode_ordinary(r["text"] or "")) for r in odd.collect())
    rows = {r["n_tokens"]: r for r in T.limits(T.histogram(odd)).collect()}
    assert {n: r["n_docs"] for n, r in rows.items()} == {n: lengths.count(n) for n in lengths}
    for n, r in rows.items():
        assert r["docs_over"] == sum(x > n for x in lengths) and r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["docs_total"] == len(lengths) and r["tokens_total"] == sum(lengths)
        assert r["tokens_truncated"] == sum(min(x, n) for x in lengths)
        assert r["share_fits"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for limit in (0, 1, 5, 1000, 10**7):
        r = T.at_limit(T.histogram(odd), limit).first()
        assert r["docs_over"] == sum(x > limit for x in lengths) and r["tokens_truncated"] == sum(min(x, limit) for x in lengths)
    assert T.quantile(T.limits(T.histogram(odd)), 0.5) == lengths[(len(lengths) + 1) // 2 - 1]


def test_texts_round_trip():
    enc = _tokens.encoding(_tokens.VOCABULARY)
    for t in ["été", "a  b\n\n c", "<|endoftext|>", "x" * 10_000]:
        assert enc.decode(enc.encode_ordinary(t)) == t


def test_empty_table(spark, docs):
    assert T.limits(T.histogram(docs([]))).count() == 0
    assert T.at_limit(T.histogram(docs([])), 10).first()["docs_total"] == 0
