"""Operator 3: token counts from an exact histogram of lengths.

The corpus is encoded once and aggregated by encoded length.  With sums over the
histogram's longer rows, each context limit's answers follow without the corpus: how
many documents fit, their tokens, the tokens that truncation at the limit leaves, and
the quantile that the limit is.

Plan: one pass over the texts in Arrow batches, whose only shuffle is (length, count);
the sums run over distinct lengths, of which there are at most as many as tokens in the
longest document.

Defined results: null and empty texts have length 0; documents of equal length are one
row, whose count says how many; a document exactly as long as a limit fits; repeated
rows count each; an empty table gives no rows; texts are encoded whole, however long;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.llm._store import documents
from geolattice.llm._tokens import VOCABULARY, with_lengths


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs for each length that occurs."""
    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    return with_lengths(rows, vocabulary, "id", "text").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length taken as context limit: what lies above it, in total, and truncated to it."""
    above = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = F.coalesce(F.sum("n_docs").over(above), F.lit(0))
    over_tokens = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(above), F.lit(0))
    docs, tokens = F.sum("n_docs").over(whole), F.sum(F.col("n_docs") * F.col("n_tokens")).over(whole)
    return hist.select(
        "n_tokens", "n_docs", over.alias("docs_over"), over_tokens.alias("tokens_over"), docs.alias("docs_total"), tokens.alias("tokens_total"),
        (tokens - over_tokens + over * F.col("n_tokens")).alias("tokens_truncated"), ((docs - over) / docs).alias("share_fits"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit, whether or not a document has that length."""
    n, c = F.col("n_tokens"), F.col("n_docs")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return hist.agg(
        F.lit(limit).alias("context_limit"), total(c).alias("docs_total"), total(n * c).alias("tokens_total"),
        total(F.when(n > limit, c)).alias("docs_over"), total(F.least(n, F.lit(limit)) * c).alias("tokens_truncated"),
    )


def quantile(table: DataFrame, share: float) -> int | None:
    """Least length that `share` of the documents don't exceed; of the table that limits() gives."""
    row = table.filter(F.col("share_fits") >= share).agg(F.min("n_tokens")).first()
    return row[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of the whole table with the answers for every limit."""
    return limits(histogram(documents(spark, sf_dir)))


QUERY, SQL = "op3_token_counts", None
