"""Catalog documents from files."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.functions import documents as D
from geolattice.functions.geometry import from_wkb


#: Columns of a dehydrated dump.
_DUMP = "id geom collection datetime end_datetime content".split()


def read_ndjson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc: one document a line; files are split, so size doesn't matter."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("doc"))


def read_json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc: members of a file that is one JSON array, features of a FeatureCollection, or the file's one object."""
    whole = spark.read.text(path, wholetext=True)

    @F.pandas_udf("array<string>")
    def members(texts: pd.Series) -> pd.Series:
        def of(t: str) -> list[str]:
            x = json.loads(t)
            x = x["features"] if isinstance(x, dict) and x.get("type") == "FeatureCollection" else x
            return [D.canonical(d) for d in (x if isinstance(x, list) else [x])]

        return texts.map(of)

    return whole.select(F.explode(members("value")).alias("doc"))


def read_json(spark: SparkSession, source: str | Iterable[dict | str | bytes]) -> DataFrame:
    """doc: from NDJSON if its first line is a document by itself, else from a JSON array or object; from Python objects too."""
    if not isinstance(source, str):
        rows = [(x if isinstance(x, str) else x.decode() if isinstance(x, bytes) else D.canonical(x),) for x in source]
        return spark.createDataFrame(rows, "doc string")
    first = spark.read.text(source).filter(F.trim("value") != "").first()
    try:
        if first is not None and isinstance(json.loads(first[0]), dict):
            return read_ndjson(spark, source)
    except json.JSONDecodeError:
        pass
    return read_json_array(spark, source)


def read_dehydrated(spark: SparkSession, path: str | list[str], base_items: dict[str, dict] | None = None) -> DataFrame:
    """doc: items of a tab-separated dump (id, geometry as hex WKB, collection, datetime, end_datetime, content); tabs in the content are kept.

    base_items: by collection, what its items were dehydrated against.
    """
    parts = F.split("value", "\t", 6)
    rows = spark.read.text(path).filter(F.trim("value") != "").select(*[parts[k].alias(n) for k, n in enumerate(_DUMP)])
    bases = base_items or {}

    @F.pandas_udf("string")
    def build(id: pd.Series, geom: pd.Series, collection: pd.Series, start: pd.Series, end: pd.Series, content: pd.Series) -> pd.Series:
        out = []
        for i, g, c, s, e, t in zip(id, geom, collection, start, end, content):
            body = D.rehydrate(bases[c], json.loads(t)) if c in bases else _without_marks(json.loads(t))
            props = dict(body.get("properties") or {})
            if "datetime" not in props and "start_datetime" not in props:
                props |= {"datetime": s} if s == e else {"datetime": None, "start_datetime": s, "end_datetime": e}
            out.append(D.canonical({**body, "properties": props, "id": i, "type": "Feature", "collection": c, "geometry": from_wkb(bytes.fromhex(g))}))
        return pd.Series(out, dtype=object)

    return rows.select(build(*_DUMP).alias("doc"))


def _without_marks(x):
    if isinstance(x, dict):
        return {k: _without_marks(v) for k, v in x.items() if not (isinstance(v, str) and v == D.MARKER)}
    return [_without_marks(v) for v in x] if isinstance(x, list) else x


def load_queryables(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
