"""Documents to columns and back.

One pass of an Arrow UDF reads each document once; everything that follows (fragments,
deduplication, assignment) is joins and aggregates on its columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geolattice.functions import documents as D
from geolattice.functions.geometry import box_of
from geolattice.functions.timeranges import earlier, instant
from geolattice.model import FRAGMENT_SCHEMA, ITEM_SCHEMA, PROMOTED, PROMOTED_NAMES, TEMPORAL
from geolattice.plans.normalize import geometry_of

_COLUMN = {p.name: (p.column, p.kind) for p in PROMOTED}
_TOP = {"id", "geometry", "collection", "type", "bbox", "links", "assets", "properties", "stac_version", "stac_extensions"}
_EPOCH = datetime(1970, 1, 1)


class BadItem(ValueError):
    """An item lacks what every item must have."""


def micros(text: str) -> int:
    """Microseconds since 1970 of an instant; years beyond 9999 too."""
    return _micros(instant(text))


def _micros(at: str) -> int:
    year = int(at.split("-")[0])
    shift = (year - 2000) // 400 if year > 9999 else 0
    near = datetime.fromisoformat(f"{year - 400 * shift:04d}-{at.split('-', 1)[1]}")
    return (near - _EPOCH) // timedelta(microseconds=1) + shift * 146_097 * 86_400_000_000


def times(properties: dict) -> tuple[str, str, bool]:
    """start, end, whether it is a range: both ends if given, else datetime for both."""
    p = properties or {}
    if p.get("start_datetime") is not None and p.get("end_datetime") is not None:
        lo, hi = instant(p["start_datetime"]), instant(p["end_datetime"])
        if earlier(hi, lo):
            raise BadItem("start_datetime is after end_datetime")
        return lo, hi, p.get("datetime") is None
    if p.get("datetime") is None:
        raise BadItem("an item needs datetime, or start_datetime and end_datetime")
    at = instant(p["datetime"])
    return at, at, False


def _scalar_text(v: Any) -> str | None:
    return None if v is None else v if isinstance(v, str) else D.canonical(v)


def _promoted_value(kind: str, v: Any) -> Any:
    if v is None:
        return None
    if kind == "time":
        return micros(v)
    if kind == "text":
        return _scalar_text(v)
    if kind == "texts":
        return [_scalar_text(x) for x in v] if isinstance(v, list) else [_scalar_text(v)]
    if kind == "double":
        return float(v)
    if kind in ("long", "int"):
        return int(v)
    return D.canonical(v)


def _rest(doc: dict) -> dict:
    """Properties without columns of their own."""
    return {k: v for k, v in (doc.get("properties") or {}).items() if k not in _COLUMN and k not in TEMPORAL}


def row_of(doc: dict, now: int | None = None) -> dict[str, Any]:
    """One document as a row; times are microseconds. Promoted properties that it hasn't are left out."""
    if doc.get("id") is None:
        raise BadItem("an item needs an id")
    props = doc.get("properties") or {}
    start, end, is_range = times(props)
    geometry = geometry_of(doc)
    if geometry is None:
        raise BadItem(f"item {doc['id']} has no geometry")
    box = box_of(geometry) or (None,) * 4
    text = lambda v: None if v is None else D.canonical(v)
    extra = {k: v for k, v in doc.items() if k not in _TOP}
    own = {_COLUMN[k][0]: _promoted_value(_COLUMN[k][1], v) for k, v in props.items() if k in _COLUMN}
    out = dict(zip(("xmin", "ymin", "xmax", "ymax"), box))
    out |= {
        "id": str(doc["id"]), "collection": doc.get("collection"), "geometry": D.canonical(geometry), "datetime": _micros(start), "end_datetime": _micros(end), "datetime_is_range": is_range,
        "stac_version": doc.get("stac_version"), "stac_extensions": text(doc.get("stac_extensions") or []), "updated_at": now, "item_hash": D.digest(doc), "fragment_hash": None,
        "bbox": text(doc.get("bbox")), "links": text(doc.get("links") or None), "assets": text(doc.get("assets") or None),
        "properties": D.canonical(_rest(doc)), "extra": text(extra or None),
        "link_hrefs": D.link_targets(doc.get("links")), "private": None,
    }
    return out | own


def _arrow(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema, timezone="UTC") if "timezone" in to_arrow_schema.__code__.co_varnames else to_arrow_schema(schema)


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    arrays, used = [], {k for r in rows for k in r}
    for f in schema:
        if f.name not in used:
            arrays.append(pa.nulls(len(rows), f.type))
            continue
        values = [r.get(f.name) for r in rows]
        arrays.append(pa.array(values, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def now_micros() -> int:
    return (datetime.now(timezone.utc).replace(tzinfo=None) - _EPOCH) // timedelta(microseconds=1)


_SPLIT_SCHEMA = T.StructType([*ITEM_SCHEMA.fields, T.StructField("frag_content", T.StringType()), T.StructField("frag_links", T.StringType())])


def dehydrate(docs: DataFrame, configs: DataFrame | None = None, doc_col: str = "doc") -> DataFrame:
    """Rows of ITEM_SCHEMA, with the fragment's content and links template beside them, from JSON documents.

    Reading a document is the greatest part of loading it, and a small file may hold
    millions, so documents are dealt to as many tasks as there are cores, or more by size.
    configs: id, fragment_config of collections; it is as small as the list of collections,
    and the planner broadcasts it if it is.
    """
    wanted = _arrow(_SPLIT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, rows = now_micros(), []
            for text, config in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    continue
                doc = json.loads(text)
                row = row_of(doc, now)
                piece = D.fragment(doc, config)
                template = D.links_template(doc.get("links"))
                if config and (piece is not None or template is not None):
                    row["frag_content"] = D.canonical(piece or {})
                    row["frag_links"] = None if template is None else D.canonical(template)
                    if row["assets"] is not None:
                        row["assets"] = D.canonical(D.without_fragment(doc["assets"], "assets", config))
                    row["properties"] = D.canonical(D.without_fragment(_rest(doc), "properties", config))
                    row["links"] = None
                    if "stac_extensions" in config:
                        row["stac_extensions"] = None
                    if "stac_version" in config:
                        row["stac_version"] = None
                rows.append(row)
            yield _table(rows, wanted)

    rows = docs.select(F.col(doc_col).alias("doc"))
    if configs is None:
        rows = rows.withColumn("config", F.lit(None).cast("array<string>"))
    else:
        rows = rows.withColumn("c", F.get_json_object("doc", "$.collection")).join(configs.select(F.col("id").alias("c"), F.col("fragment_config").alias("config")), "c", "left").select("doc", "config")
    split = rows.hint("rebalance").mapInArrow(run, _SPLIT_SCHEMA)
    own = F.sha2(F.concat_ws("\x1f", F.coalesce("frag_content", F.lit("")), F.coalesce("frag_links", F.lit("\x1e"))), 256)
    return split.withColumn("fragment_hash", F.when(F.col("frag_content").isNotNull(), own))


def fragments_of(split: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Fragments that the rows need and that aren't there yet, each once."""
    new = split.filter("fragment_hash is not null").groupBy("collection", F.col("fragment_hash").alias("hash")).agg(F.min("frag_content").alias("content"), F.min("frag_links").alias("links_template")).withColumn("created_at", F.current_timestamp())
    if existing is not None:
        new = new.join(existing.select("collection", "hash"), ["collection", "hash"], "left_anti")
    return new.select(*[f.name for f in FRAGMENT_SCHEMA.fields])


def item_rows(split: DataFrame) -> DataFrame:
    return split.select(*[f.name for f in ITEM_SCHEMA.fields])


def needs_fragment(fields: dict | None) -> bool:
    """Whether a projection may ask for something that a fragment holds."""
    include = (fields or {}).get("include")
    exclude = (fields or {}).get("exclude") or []
    shared = [t for t in ("assets", "properties", "links", "stac_version", "stac_extensions") if t not in exclude]
    if not isinstance(include, list) or not include:
        return bool(shared)
    for path in include:
        top, _, rest = str(path).partition(".")
        if top not in shared:
            continue
        if top == "properties" and rest and (rest in PROMOTED_NAMES or rest in TEMPORAL):
            continue
        return True
    return False


_NUMBERS = {"double", "long", "int"}


def hydrate_row(row: dict[str, Any], fields: dict | None = None) -> dict:
    """The document of a row; times in it are text already, JSON columns are text."""
    load = lambda v: None if v is None else json.loads(v)
    frag = load(row.get("frag_content")) or {}
    if row["datetime_is_range"]:
        props: dict = {"datetime": None, "start_datetime": row["datetime"], "end_datetime": row["end_datetime"]}
    else:
        props = {"datetime": row["datetime"]}
        if row["datetime"] != row["end_datetime"]:
            props |= {"start_datetime": row["datetime"], "end_datetime": row["end_datetime"]}
    for name, (column, kind) in _COLUMN.items():
        v = row.get(column)
        if v is None:
            continue
        if kind == "json":
            v = load(v)
            if v is None:
                continue
        elif kind == "texts":
            v = list(v)
        elif kind == "double" and v == int(v) and abs(v) < 1e15:
            v = int(v)
        props[name] = v
    shared = {k: v for k, v in (frag.get("properties") or {}).items()}
    own = D.merge(shared, load(row["properties"]) or {})
    doc = {"id": row["id"], "type": "Feature", "collection": row["collection"], "geometry": load(row["geometry"])}
    if row["bbox"] is not None:
        doc["bbox"] = load(row["bbox"])
    if (version := row["stac_version"] or frag.get("stac_version")) is not None:
        doc["stac_version"] = version
    if extensions := (load(row["stac_extensions"]) or frag.get("stac_extensions")):
        doc["stac_extensions"] = extensions
    template = load(row.get("frag_links"))
    doc["links"] = D.links_of(template, row["link_hrefs"]) if row.get("frag_content") is not None else load(row["links"]) or []
    if assets := D.merge(frag.get("assets"), load(row["assets"]) or {}):
        doc["assets"] = assets
    doc["properties"] = {**props, **own}
    doc |= load(row["extra"]) or {}
    return D.project(doc, fields)


def hydrate(items: DataFrame, fragments: DataFrame | None = None, fields: dict | None = None, *keep: str) -> DataFrame:
    """keep..., doc: documents of the rows. The join with the fragments is left out where `fields` makes it needless."""
    from geolattice.functions.columns import time_text

    rows = items
    if fragments is not None and needs_fragment(fields):
        rows = rows.join(fragments.select("collection", F.col("hash").alias("fragment_hash"), F.col("content").alias("frag_content"), F.col("links_template").alias("frag_links")), ["collection", "fragment_hash"], "left")
    else:
        rows = rows.withColumns({"frag_content": F.lit(None).cast("string"), "frag_links": F.lit(None).cast("string")})
    stamps = [c for c, t in rows.dtypes if t.startswith("timestamp") and c not in keep]
    names = [f.name for f in ITEM_SCHEMA.fields if f.name not in ("updated_at", "private", "item_hash")] + ["frag_content", "frag_links"]
    always = set(names) - {column for column, _ in _COLUMN.values()}
    packed = F.struct(*[(time_text(F.col(c)) if c in stamps else F.col(c)).alias(c) for c in names])

    @F.arrow_udf("string")
    def rebuild(row: pa.Array) -> pa.Array:
        # columns without a value are left out, so that a row costs what it holds
        held = [(n, c) for n, c in zip(names, row.flatten()) if c.null_count < len(c) or n in always]
        rows = pa.Table.from_arrays([c for _, c in held], names=[n for n, _ in held]).to_pylist()
        return pa.array([D.canonical(hydrate_row(r, fields)) for r in rows], pa.string())

    return rows.select(*keep, rebuild(packed).alias("doc"))
