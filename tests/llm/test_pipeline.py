import os
import random

import pytest

import corpus_pipeline
from geolattice.llm import _tokens, decontaminate, line_dedup, packing, registry, simhash_dedup, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.exists(SF) and os.path.exists(_tokens.VOCABULARY)), reason="no test data")


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def test_each_stage_does_what_its_operator_finds(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in now.collect()}
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in after.collect()}
        if name == "toxicity":
            model = toxicity.fit(now, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == before - {r["doc_id"] for r in toxicity.toxic_documents(now, model).collect()}
        elif name == "line_dedup":
            assert ids == before
            want = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(now).collect()}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "simhash_dedup":
            assert ids == before - {r["id"] for r in simhash_dedup.copies(now).collect()}
        elif name == "decontamination":
            found = decontaminate.findings(now, decontaminate.build(spark, now, spark.read.parquet(f"{SF}/benchmark.parquet")))
            assert ids == before - {r["doc_id"] for r in found.collect()}
        else:
            assert ids == before and packing.QUERY
        if k < 4:
            assert after.columns == columns
        now = after
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in now.collect()}


ROWS = "doc_id long, text string, lang string, source string, n_chars long, toxic string, bucket int, gone string, w0 long, bp_host string, item_id long, n_tokens string"


def folder(spark, tmp_path, texts, items=()):
    """Tables of documents (with columns whose names the stages use), of labels and of a benchmark."""
    rows = [(i, t, lang, source, None if t is None else len(t), "x", 1, "y", 2, "z", 3, "n") for i, t, lang, source in texts]
    spark.createDataFrame(rows, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int("vilescum" in (t or ""))) for i, t, _, _ in texts if i is not None and i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_odd_rows_through_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ties: what must go goes, all else stays."""
    rng = random.Random(1)
    own = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item, twin, long = own(25), own(80), own(40_000)
    texts = [(k, own(60), "en", f"s{k % 3}") for k in range(300)]
    texts += [(1000 + k, f"{own(20)} vilescum {own(20)}", "en", "s0") for k in range(40)]
    texts += [(2000, twin, "en", "s0"), (2001, twin, "fr", "s1"), (2002, twin.replace("w1", "w1", 1) + " end", None, None), (2003, f"{own(50)} {item} {own(50)}", "en", "s2")]
    texts += [(3000, None, None, None), (3001, "", "en", "s0"), (3002, " \n\t ", "", "s1"), (3003, "!!! ???", "en", None), (None, own(30), "en", "s0"), (3004, long, "en", "s1"), (3005, own(10), "en", "s5"), (3005, own(10), "en", "s6")]
    texts += [(4000 + k, f"{own(40)}\nread more on our site\n{own(40)}", "en", "s7") for k in range(20)]
    sf = folder(spark, tmp_path, texts, [(1, item), (2, None), (None, "x y z"), (3, "")])
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in out]
    gone = {1000 + k for k in range(40)} | {2001, 2002, 2003}
    assert sorted(i for i in ids if i is not None) == sorted(i for i, *_ in texts if i is not None and i not in gone)
    assert ids.count(None) == 1 and ids.count(3005) == 2
    sizes = {r["doc_id"]: r["n_tokens"] for r in out}
    assert sizes[3000] == sizes[3001] == 0 < sizes[2000] < sizes[3004]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [c.split()[0] for c in ROWS.split(", ")], name
    assert {r["text"].count("read more") for r in docs.collect() if r["doc_id"] and 4000 <= r["doc_id"] < 4020} == {0}


@pytest.mark.parametrize("texts", [[], [(None, None, None, None)], [(1, "one text", "en", "s")]])
def test_tables_of_hardly_any_rows(spark, tmp_path, texts):
    """Nothing in, nothing out; a table without labels or benchmark keeps its rows."""
    sf = folder(spark, tmp_path, texts)
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()] == [t[0] for t in texts]
