"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolattice.llm import decontaminate, embedding_dedup, html_extract, licences, line_dedup, packing, pii, simhash_dedup, token_counts, toxicity

MODULES = [html_extract, licences, token_counts, pii, embedding_dedup, packing, simhash_dedup, toxicity, line_dedup, decontaminate]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.SQL for m in MODULES if m.SQL}
