"""Five stages that make a training corpus of `documents`; part of the llm subpackage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns a table that is written as Parquet and read again for the next.  All but the
last return the columns of documents.

Defined results, of all stages: rows with null ids, null and empty texts are kept (such
a text is neither toxic nor a copy nor contaminated, and its length is 0); rows of one id
are judged each by itself, but share their fate among near copies; ties and repeated rows
are those of the operators; very long texts are handled whole; an empty table gives an
empty one, and an empty table of labels or benchmark lets all rows pass; columns beside
those of documents are passed on, whatever their names, until packing, which returns the
id, the length, the bucket and the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolattice.llm import decontaminate, line_dedup, packing, simhash_dedup, toxicity
from geolattice.llm._store import documents, forget, keep

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: A trained classifier and an index search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document that all stages keep."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, name)
            forget(last)
    return docs
