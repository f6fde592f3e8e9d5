"""Which properties there are: registered ones merged, new ones found, all noted."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.functions import documents as D
from geolattice.functions.aggregates import field_rows
from geolattice.model import PROMOTED_NAMES, TEMPORAL
from geolattice.plans.properties import FIXED, Queryable, promoted_queryables


DRAFT = "http://json-schema.org/draft-07/schema#"


def signature(name: str, collections: list[str] | None) -> str:
    return f"{name}:{','.join(sorted(collections or []))}"


def merged(queryables: dict[str, Queryable] | list[Queryable], known: list[str], ids: list[str] | None = None, additional: bool = True) -> dict[str, Any] | None:
    """JSON schema of the queryables of some collections, or of all; None if a collection is unknown.

    Of one name's definitions, lists of values are united, minima and maxima widened.
    """
    if ids is not None and set(ids) - set(known):
        return None
    base = {n: q for n, q in promoted_queryables().items()}
    properties: dict[str, Any] = {n: q.definition for n, q in base.items()}
    properties |= {"id": dict(type="string", title="Id"), "datetime": dict(type="string", format="date-time", title="Time"), "geometry": dict(type="object", title="Geometry")}
    own: dict[str, list[dict]] = {}
    for q in queryables.values() if isinstance(queryables, dict) else queryables:
        if ids is None or not q.collections or set(q.collections) & set(ids):
            own.setdefault(q.name, []).append(q.definition)
    for name, definitions in own.items():
        out = {k: v for d in reversed(definitions) for k, v in d.items()}
        if any("enum" in d for d in definitions):
            out["enum"] = sorted({json.dumps(v) for d in definitions for v in d.get("enum", [])})
            out["enum"] = [json.loads(v) for v in out["enum"]]
        for key, pick in (("minimum", min), ("maximum", max)):
            if found := [d[key] for d in definitions if key in d]:
                out[key] = pick(found)
        properties[name] = out
    return {"type": "object", "$schema": DRAFT, "properties": properties, "additionalProperties": additional}


def from_schema(schema: dict[str, Any], collections: list[str] | None = None, index_fields: list[str] | None = None) -> list[Queryable]:
    """Queryables of a JSON-schema file; the fixed fields need none."""
    out = []
    for name, d in schema.get("properties", {}).items():
        if name in FIXED:
            continue
        wrapper = {"number": "to_float", "integer": "to_int", "array": "to_text_array"}.get(d.get("type"))
        if d.get("format") == "date-time":
            wrapper = "to_tstz"
        out.append(Queryable(name, d, None, wrapper or "to_text", collections, "BTREE" if name in (index_fields or []) else None))
    return out


_TYPES = {"number": ("number", "to_float"), "string": ("string", "to_text"), "array": ("array", "to_text_array"), "boolean": ("boolean", "to_text"), "object": ("object", "to_text"), "null": ("string", "to_text")}


def _top_kinds(items: DataFrame) -> DataFrame:
    """collection, name, kind of the items' own properties, each once for a batch of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {(c, name, kind) for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None for name, _, kind in D.paths(json.loads(t), depth=1)}
            yield pa.RecordBatch.from_pylist([dict(zip(("collection", "name", "kind"), x)) for x in sorted(seen, key=repr)], pa.schema([(n, pa.string()) for n in ("collection", "name", "kind")]))

    return items.select("collection", "properties").mapInArrow(run, "collection string, name string, kind string")


def missing(items: DataFrame, registered: list[str], percent: float = 5.0, min_rows: int = 10, seed: int = 42) -> DataFrame:
    """collection, name, type, wrapper of properties in a sample of the items that nothing registers.

    The sample is a share of the rows (all of them where the share would be under min_rows).
    """
    skip = sorted({*registered, *PROMOTED_NAMES, *TEMPORAL})
    share = min(1.0, percent / 100)
    sampled = items.sample(share, seed) if share < 1 and items.count() * share >= min_rows else items
    top = _top_kinds(sampled).filter(~F.contains("name", F.lit(".")))
    rows = top.filter(~F.col("name").isin(skip)).groupBy("collection", "name").agg(F.min_by("kind", F.when(F.col("kind") != "null", F.col("kind"))).alias("kind"))
    as_map = lambda k: F.create_map(*[F.lit(x) for a, b in _TYPES.items() for x in (a, b[k])])
    kind = F.coalesce("kind", F.lit("null"))
    return rows.select("collection", "name", as_map(0)[kind].alias("type"), as_map(1)[kind].alias("wrapper"))


def field_registry(items: DataFrame, existing: DataFrame | None = None, large: int = 10_000, share: float = 0.05, small: int = 1000, seed: int = 42, json_col: str = "properties") -> DataFrame:
    """collection, path, is_leaf, kinds, first_seen, last_seen: what items have in them.

    A sampling operator: of more than `large` items a share is looked at, else `small` of them.
    """
    sampled = items.sample(share, seed) if items.limit(large + 1).count() > large else items.limit(small)
    now = F.current_timestamp()
    found = field_rows(sampled, json_col, "collection").groupBy("collection", "path").agg(F.every("is_leaf").alias("is_leaf"), F.array_sort(F.collect_set("kind")).alias("kinds")).withColumns({"first_seen": now, "last_seen": now})
    if existing is None:
        return found
    return existing.unionByName(found).groupBy("collection", "path").agg(F.every("is_leaf").alias("is_leaf"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def refresh_registry(registry: DataFrame, collection: str | None = None, days: float = 90) -> tuple[DataFrame, DataFrame]:
    """The registry without what hasn't been seen for long, and how many fields each collection keeps."""
    old = F.col("last_seen") < F.current_timestamp() - F.make_interval(secs=F.lit(days * 86400))
    kept = registry.filter(~old if collection is None else ~(old & (F.col("collection") == collection)))
    return kept, kept.groupBy("collection").agg(F.count(F.lit(1)).alias("n_fields"))


def extension_urls(collections: DataFrame) -> DataFrame:
    """Distinct extension schemas that collections name, without fragments."""
    return collections.select(F.explode(F.from_json(F.get_json_object("content", "$.stac_extensions"), "array<string>")).alias("u")).select(F.regexp_replace("u", "#.*$", "").alias("url")).distinct()


def extension_queryables(extensions: DataFrame) -> DataFrame:
    """name, definition of the fields that extension schemas (url, content) define; references made absolute."""
    from geolattice.functions.columns import qualify_refs

    fields = F.from_json(F.get_json_object("content", "$.definitions.fields.properties"), "map<string,string>")
    return extensions.select("url", F.explode(fields).alias("name", "definition")).select("name", qualify_refs(F.col("url"), F.col("definition")).alias("definition"))
