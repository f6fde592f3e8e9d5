"""Encoded lengths by a public byte-level BPE vocabulary, given as a path."""

from __future__ import annotations

import base64
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm._store import small_batches
from geolattice.llm._text import texts_of, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """id, n_tokens of every row: null and empty texts have 0; texts are encoded whole."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(vocabulary)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in texts_of(b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=[id_col, out])

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"`{id_col}` {kind}, `{out}` long")
