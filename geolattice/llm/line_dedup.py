"""Operator 9: lines that too many pages of one site share.

For each host the pages that contain a line are counted, divided by the host's page
total, and the line is dropped from all of that host's pages where the quotient
exceeds the boilerplate ratio.  A line that is on one page only is shared with no other
page, whatever the ratio: `min_pages` is 2 unless the caller asks for more.

Plan: lines are hashed with their host (64 bits) on the map side and counted by hash, so
no text is shuffled and a hot host's lines spread over all tasks.  Lines above the ratio
are few per host (at most its mean number of lines a page / ratio); they are written to
the shared folder, so that the planner knows their size and broadcasts them only if
small, else it shuffles, splitting a hot host.

Defined results: a line counts once a page, compared without spaces at its ends; blank
lines are neither counted nor dropped; a null text stays null and counts as a page
without lines; an empty text stays; a text all of whose lines go becomes empty; a null
host is a host of its own; repeated rows are pages of their own; a line on exactly the
ratio stays; lines are told apart by 64-bit hashes, so that of a billion different lines
of a host hardly one is taken for another; an empty table gives an empty one; very long texts are handled whole; other
columns are untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm._store import documents, fresh, keep

RATIO, MIN_PAGES = 0.02, 2


def _hashes(text: Column) -> Column:
    """Hashes of the lines that aren't blank, each once."""
    return F.array_distinct(F.transform(F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """host, lines: for each host that has any, the hashes of its boilerplate lines."""
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = pages.select("host", F.explode(_hashes(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    share = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return share.filter(F.col("n") > F.col("total") * ratio).groupBy("c.host").agg(F.collect_list("line").alias("lines"))


def drop_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """docs with the boilerplate lines taken out of text_col; dropped_col, if given, holds how many."""
    found = keep(boilerplate(docs, ratio, min_pages, host_col, text_col), "boilerplate")
    host, lines = fresh(docs.columns, "bp_host", "bp_lines")
    both = docs.join(found.toDF(host, lines), F.col(host_col).eqNullSafe(F.col(host)), "left")
    stays = F.filter(_lines(F.col(text_col)), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(lines), F.xxhash64(F.trim(x))))
    same = F.col(lines).isNull() | F.col(text_col).isNull()
    text = F.when(same, F.col(text_col)).otherwise(F.concat_ws("\n", stays))
    size = lambda c: F.size(_lines(c))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if dropped_col:
        kept = F.when(same, 0).otherwise(size(F.col(text_col)) - F.size(stays))
        out.append(kept.cast("long").alias(dropped_col))
    return both.select(*out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text cleaned and the number of lines dropped."""
    return drop_lines(documents(spark, sf_dir), dropped_col="n_dropped").select("doc_id", "source", "text", "n_dropped")


QUERY = "op9_line_dedup"
SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM pages),
counts AS (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line HAVING count(*) >= {MIN_PAGES}),
boiler AS (SELECT c.source, list(c.line) AS bl FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n > t.total * CAST({RATIO} AS DOUBLE) GROUP BY c.source),
done AS (SELECT doc_id, p.source, text, ls, list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(bl, []), trim(x, ' '))) AS stays
         FROM pages p LEFT JOIN boiler b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(stays, chr(10)) END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(stays) END AS BIGINT) AS n_dropped FROM done
"""
