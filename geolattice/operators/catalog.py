"""A catalog at rest: items, collections, fragments and what is known of them.

Items lie in Parquet by collection and time bucket. A manifest says which files each
partition and each small table consist of, so adding rows adds files, and changing rows
rewrites only the partitions they are in. Every change writes its files first and then
publishes one new manifest, under the next number, by a rename that fails if that number
is taken: a reader sees the catalog before or after a change, a crash leaves it as it
was, and of two writers at once the second is told (Conflict). Files that no manifest
names any more stay for readers until vacuum().
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolattice.functions import documents as D
from geolattice.functions.geometry import box_of
from geolattice.model import COLLECTION_SCHEMA, FRAGMENT_SCHEMA, ITEM_SCHEMA, TOMBSTONE_SCHEMA
from geolattice.operators import items as I
from geolattice.plans.normalize import BadRequest, bbox_polygon
from geolattice.plans.properties import Queryable
from geolattice.plans.settings import Settings

_STORED = T.StructType([*ITEM_SCHEMA.fields, T.StructField("dt_bucket", T.StringType())])
STATS = "collection string, dt_bucket string, n long, dt_lo timestamp, dt_hi timestamp, edt_lo timestamp, edt_hi timestamp, xmin double, ymin double, xmax double, ymax double"
_SMALL = {"collections": COLLECTION_SCHEMA, "fragments": FRAGMENT_SCHEMA, "deleted": TOMBSTONE_SCHEMA}
#: Rows of a task that writes items, about; a larger partition is written by several, by ranges of time.
FILE_ROWS = 200_000
#: A small table that consists of so many folders is written anew as one.
MOST_FOLDERS = 64
#: Manifests that are kept.
MANIFESTS = 20


class Mode(str, Enum):
    """What becomes of an item whose id and collection are there already."""

    insert = "insert"
    ignore = "ignore"
    insert_ignore = "insert_ignore"
    upsert = "upsert"
    delsert = "delsert"


class Duplicate(ValueError):
    """An item is there already, or twice in one batch."""


class Missing(KeyError):
    """What should be changed isn't there."""


class Conflict(RuntimeError):
    """Someone else changed the catalog in the meantime."""


class ReadOnly(PermissionError):
    """The catalog may not be changed."""


def bucket(at: Column, trunc: Column) -> Column:
    """Partition of a time: '' for the whole collection, yyyy, or yyyyMM."""
    return F.when(trunc == "year", F.date_format(at, "yyyy")).when(trunc == "month", F.date_format(at, "yyyyMM")).otherwise("")


def partition_stats(items: DataFrame) -> DataFrame:
    """One row for each partition, exact."""
    return items.groupBy("collection", "dt_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("dt_lo"), F.max("datetime").alias("dt_hi"), F.min("end_datetime").alias("edt_lo"), F.max("end_datetime").alias("edt_hi"),
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
    )


def collection_row(doc: dict, trunc: str | None, config: list[str] | None, private: str | None = None) -> dict[str, Any]:
    """A collection with what its extent says; odd extents (bare arrays) are read too."""
    if trunc not in (None, "year", "month"):
        raise BadRequest("partition_trunc is year or month")
    extent = doc.get("extent") or {}
    spatial, temporal = extent.get("spatial"), extent.get("temporal")
    boxes = spatial.get("bbox") if isinstance(spatial, dict) else spatial
    box = boxes[0] if isinstance(boxes, list) and boxes and isinstance(boxes[0], list) else boxes
    spans = temporal.get("interval") if isinstance(temporal, dict) else temporal
    span = spans[0] if isinstance(spans, list) and spans and isinstance(spans[0], list) else spans
    shape = bbox_polygon(box) if isinstance(box, list) else None
    at = [I.micros(x) if x else None for x in span[:2]] if isinstance(span, list) and len(span) > 1 else [None, None]
    bounds = box_of(shape) if shape else (None,) * 4
    return {"id": str(doc["id"]), "content": D.canonical(doc), "fragment_config": config, "partition_trunc": trunc, "private": private, "geometry": D.canonical(shape) if shape else None, **dict(zip(("xmin", "ymin", "xmax", "ymax"), bounds)), "datetime": at[0], "end_datetime": at[1]}


@dataclass
class Catalog:
    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    jobs: dict[str, Callable[[], Any]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")  # times are read and written as text in places
        self._hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._held: tuple[int, dict[str, Any]] | None = None
        self.settings.spark = self.spark
        self.settings.stored = (self._read("settings.json") or {}) | self.settings.stored
        self.settings.save = lambda stored: self._put("settings.json", stored)
        self.jobs = {"extents": self.update_collection_extents, "analyze": self.analyze, "vacuum": self.vacuum, "gc_fragments": self.gc_fragments, "gc_deleted": self.gc_deleted} | self.jobs
        if not self._versions():
            self._publish({"version": 1, "items": [], "tables": {}, "queryables": []}, 1)

    # Files

    def _read(self, name: str) -> Any:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, value: Any, replace: bool = True) -> bool:
        """A small file, whole or not at all; without replace, whether the name was free."""
        draft, path = self._path(f"{self.root}/_drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(path.getParent())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.OVERWRITE if replace else self._hadoop.Options.Rename.NONE
        qualified = lambda x: self._fs.makeQualified(x)
        try:
            self._context.rename(qualified(draft), qualified(path), options)
        except Exception:
            self._fs.delete(draft, False)
            if not replace and self._fs.exists(path):
                return False
            raise
        return True

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self._names("manifests") if x.endswith(".json") and not x.startswith("."))

    @property
    def manifest(self) -> dict[str, Any]:
        """The newest manifest; read again only if there is a newer one."""
        newest = self._versions()[-1]
        if self._held is None or self._held[0] != newest:
            self._held = newest, self._read(f"manifests/{newest}.json")
        return self._held[1]

    def _publish(self, manifest: dict[str, Any], number: int) -> None:
        if not self._put(f"manifests/{number}.json", manifest, replace=False):
            raise Conflict(f"manifest {number} is there already")
        for old in self._versions()[:-MANIFESTS]:
            self._fs.delete(self._path(f"{self.root}/manifests/{old}.json"), False)

    @contextmanager
    def _change(self) -> Iterator[dict[str, Any]]:
        """The manifest to be changed; what was done to it is published at the end, at once, unless something fails."""
        self._changes()
        now = json.loads(json.dumps(self.manifest))
        number = self._held[0]
        yield now
        self._publish(now, number + 1)

    def _changes(self) -> None:
        if self.settings.flag("readonly"):
            raise ReadOnly("the catalog is read-only")

    def _keep(self, df: DataFrame, label: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{label}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    @contextmanager
    def _staging(self) -> Iterator[str]:
        """A folder for what a load needs on its way; it goes with the load."""
        folder = f"staging/{uuid.uuid4().hex}"
        try:
            yield folder
        finally:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    # Small tables

    def table(self, name: str, manifest: dict[str, Any] | None = None) -> DataFrame:
        paths = (manifest or self.manifest)["tables"].get(name)
        return self.spark.read.schema(_SMALL[name]).parquet(*[f"{self.root}/{x}" for x in paths]) if paths else self.spark.createDataFrame([], _SMALL[name])

    def _written(self, name: str, df: DataFrame) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        df.select(*[f.name for f in _SMALL[name].fields]).write.parquet(f"{self.root}/{path}")
        return path

    def _replace(self, manifest: dict[str, Any], name: str, df: DataFrame) -> None:
        manifest["tables"][name] = [self._written(name, df)]

    def _append(self, manifest: dict[str, Any], name: str, df: DataFrame) -> None:
        """Rows added as a folder of their own; folders are merged when there are many."""
        paths = [*manifest["tables"].get(name, []), self._written(name, df)]
        manifest["tables"][name] = paths
        if len(paths) >= MOST_FOLDERS:
            self._replace(manifest, name, self.table(name, manifest).coalesce(max(1, len(paths) // 16)))

    # Items

    def items(self, keep: Callable[[dict[str, Any]], bool] | None = None) -> DataFrame:
        """All items, or those of the partitions that pass `keep`, which is asked before any file is opened."""
        return self.rows_of([p for p in self.manifest["items"] if keep is None or keep(p)])

    def rows_of(self, parts: list[dict[str, Any]]) -> DataFrame:
        paths = [f"{self.root}/{x}" for p in parts for x in p["paths"]]
        return self.spark.read.schema(_STORED).parquet(*paths) if paths else self.spark.createDataFrame([], _STORED)

    def stats(self) -> DataFrame:
        return self.stats_of(self.manifest["items"])

    def stats_of(self, parts: list[dict[str, Any]]) -> DataFrame:
        text = STATS.replace("timestamp", "string")
        out = self.spark.createDataFrame([(p["collection"], p["bucket"], *p["stats"]) for p in parts], text)
        return out.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in STATS.split(", ")])

    def _commit(self, manifest: dict[str, Any], changed: dict[tuple[str, str], list[str]], added: dict[tuple[str, str], list[str]]) -> None:
        """Partitions given new files in place of theirs, or besides theirs, with statistics of all their files."""
        parts = {(p["collection"], p["bucket"]): p for p in manifest["items"]}
        for key, paths in changed.items():
            parts[key] = {"collection": key[0], "bucket": key[1], "paths": paths, "stats": None}
        for key, paths in added.items():
            old = parts.get(key, {"collection": key[0], "bucket": key[1], "paths": []})
            parts[key] = old | {"paths": [*old["paths"], *paths], "stats": None}
        parts = {k: p for k, p in parts.items() if p["paths"]}
        self._measure([p for p in parts.values() if p["stats"] is None])
        manifest["items"] = sorted(parts.values(), key=lambda p: (p["collection"], p["bucket"]))

    def _measure(self, parts: list[dict[str, Any]]) -> None:
        """Exact statistics put into the partitions' entries."""
        stale = {(p["collection"], p["bucket"]): p for p in parts}
        if not stale:
            return
        cast = [F.col(c).cast("string") if c.startswith(("dt_l", "dt_h", "edt")) else F.col(c) for c in ("n", "dt_lo", "dt_hi", "edt_lo", "edt_hi", "xmin", "ymin", "xmax", "ymax")]
        paths = [f"{self.root}/{x}" for p in parts for x in p["paths"]]
        for r in partition_stats(self.spark.read.schema(_STORED).parquet(*paths)).select("collection", "dt_bucket", *cast).collect():  # as many rows as partitions changed
            stale[(r[0], r[1])]["stats"] = list(r[2:])

    def _store(self, rows: DataFrame, n: int) -> dict[tuple[str, str], list[str]]:
        """Writes about n rows by partition and ranges of time, so that a large partition is the work of several tasks and files and row groups prune; gives the files' folders."""
        base = f"items/{uuid.uuid4().hex}"
        spread = rows.repartitionByRange(max(1, math.ceil(n / FILE_ROWS)), "collection", "dt_bucket", "datetime", "id").sortWithinPartitions("collection", "dt_bucket", "datetime")
        spread.withColumns({"p_c": F.col("collection"), "p_b": F.when(F.col("dt_bucket") == "", "all").otherwise(F.col("dt_bucket"))}).write.partitionBy("p_c", "p_b").parquet(f"{self.root}/{base}")
        out: dict[tuple[str, str], list[str]] = {}
        for c in self._fs.listStatus(self._path(f"{self.root}/{base}")):
            if not c.isDirectory():
                continue
            from urllib.parse import unquote

            for b in self._fs.listStatus(c.getPath()):
                name, part = unquote(c.getPath().getName().removeprefix("p_c=")), b.getPath().getName().removeprefix("p_b=")
                out[(name, "" if part == "all" else part)] = [f"{base}/{c.getPath().getName()}/{b.getPath().getName()}"]
        return out

    def _partition(self, rows: DataFrame, collections: DataFrame) -> DataFrame:
        return rows.join(collections.select(F.col("id").alias("collection"), "partition_trunc"), "collection").withColumn("dt_bucket", bucket(F.col("datetime"), F.coalesce("partition_trunc", F.lit("")))).select(*[f.name for f in _STORED.fields])

    def load_items(self, docs: DataFrame, mode: Mode | str = Mode.insert, doc_col: str = "doc") -> int:
        """JSON documents taken in; the number of rows written. Items, fragments and deletions become visible together."""
        mode = Mode(mode)
        with self._change() as manifest, self._staging() as staging:
            n = self._load(manifest, staging, docs, mode, doc_col)
        if self.settings.flag("update_collection_extent"):
            self.run_or_queue("extents")
        return n

    def _load(self, manifest: dict[str, Any], staging: str, docs: DataFrame, mode: Mode, doc_col: str) -> int:
        collections = self.table("collections", manifest)
        split = self._keep(I.dehydrate(docs, collections, doc_col), staging, I._SPLIT_SCHEMA)
        unknown = split.select("collection").distinct().join(collections.select(F.col("id").alias("collection")), "collection", "left_anti").first()
        if unknown is not None:
            raise Missing(f"no collection {unknown[0]}")
        rows = self._partition(I.item_rows(split), collections)
        twice = rows.groupBy("collection", "id").count().filter("count > 1").first()
        if twice is not None:
            if mode is Mode.insert:
                raise Duplicate(f"item {twice['id']} occurs twice")
            # the same item twice in a batch: one of them, the one of least hash
            rows = rows.groupBy("collection", "id").agg(F.min_by(F.struct(*rows.columns), "item_hash").alias("r")).select("r.*")
        # Only the collections of the batch can hold its items.
        names = {r[0] for r in split.select("collection").distinct().collect()}
        there = self.rows_of([p for p in manifest["items"] if p["collection"] in names])
        held = there.select("collection", "id", F.col("dt_bucket").alias("old_bucket"), F.col("item_hash").alias("old_hash"))
        changed: dict[tuple[str, str], list[str]] = {}
        if mode is Mode.insert:
            if (hit := rows.join(held, ["collection", "id"], "left_semi").select("id").first()) is not None:
                raise Duplicate(f"item {hit['id']} is there already")
        elif mode in (Mode.ignore, Mode.insert_ignore):
            rows = rows.join(held, ["collection", "id"], "left_anti")
        else:
            matched = rows.select("collection", "id", "item_hash").join(held, ["collection", "id"])
            if mode is Mode.upsert:
                rows = rows.join(matched.filter("item_hash = old_hash").select("collection", "id"), ["collection", "id"], "left_anti")
                matched = matched.filter("item_hash <> old_hash")
            changed = self._without(manifest, matched.select("collection", "id", "old_bucket"))
        rows = self._keep(rows, staging, _STORED)
        n = rows.count()
        added = self._store(rows, n) if n else {}
        new = I.fragments_of(split, self.table("fragments", manifest))
        if new.limit(1).count():
            self._append(manifest, "fragments", new)
        self._commit(manifest, changed, added)
        return n

    def _without(self, manifest: dict[str, Any], gone: DataFrame) -> dict[tuple[str, str], list[str]]:
        """New files for the partitions that lose rows; the rows lost are noted as deleted."""
        buckets = {(r[0], r[1]) for r in gone.select("collection", "old_bucket").distinct().collect()}
        if not buckets:
            return {}
        parts = [p for p in manifest["items"] if (p["collection"], p["bucket"]) in buckets]
        touched, keys = self.rows_of(parts), gone.select("collection", "id").distinct()
        lost = touched.join(keys, ["collection", "id"], "left_semi").select(F.col("id").alias("item_id"), "collection", "dt_bucket", "datetime", "end_datetime", "item_hash", F.current_timestamp().alias("deleted_at"))
        stay = self._store(touched.join(keys, ["collection", "id"], "left_anti"), sum(p["stats"][0] for p in parts))
        self._append(manifest, "deleted", lost)
        return {p: stay.get(p, []) for p in buckets}

    def docs(self, *docs: dict) -> DataFrame:
        return self.spark.createDataFrame([(D.canonical(d),) for d in docs], "doc string")

    def create_items(self, docs: list[dict]) -> int:
        return self.load_items(self.docs(*docs), Mode.insert)

    def create_item(self, doc: dict) -> int:
        return self.create_items([doc])

    def upsert_items(self, docs: list[dict]) -> int:
        return self.load_items(self.docs(*docs), Mode.upsert)

    def upsert_item(self, doc: dict) -> int:
        return self.upsert_items([doc])

    def _located(self, id: str, collection: str | None) -> DataFrame:
        rows = self.items(None if collection is None else lambda p: p["collection"] == collection)
        return rows.filter(F.col("id") == id)

    def delete_item(self, id: str, collection: str | None = None) -> None:
        """Exactly one item must answer to the id."""
        with self._change() as manifest:
            found = self._only(id, collection)
            self._commit(manifest, self._without(manifest, found.select("collection", "id", F.col("dt_bucket").alias("old_bucket"))), {})

    def _only(self, id: str, collection: str | None) -> DataFrame:
        found = self._located(id, collection)
        n = found.limit(2).count()
        if n != 1:
            raise Missing(f"no item {id}") if n == 0 else Duplicate(f"several collections have an item {id}")
        return found

    def update_item(self, doc: dict) -> None:
        """The item that is there gives way to this one, in one step; exactly one must answer to id and collection."""
        self._only(doc["id"], doc.get("collection"))
        self.load_items(self.docs(doc), Mode.delsert)

    def item_by_id(self, id: str, collection: str | None = None) -> DataFrame:
        return self._located(id, collection)

    def get_item(self, id: str, collection: str | None = None) -> dict | None:
        row = I.hydrate(self._located(id, collection), self.table("fragments")).first()
        return None if row is None else json.loads(row["doc"])

    # Collections

    def _collection_frame(self, rows: list[dict[str, Any]]) -> DataFrame:
        import pyarrow as pa

        schema = I._arrow(COLLECTION_SCHEMA)
        batch = I._table(rows, schema)
        return self.spark.createDataFrame(pa.Table.from_batches([batch]), COLLECTION_SCHEMA) if rows else self.spark.createDataFrame([], COLLECTION_SCHEMA)

    def load_collections(self, docs: list[dict], mode: Mode | str = Mode.insert, partition_trunc: str | None = None, fragment_config: list[str] | None = None) -> None:
        with self._change() as manifest:
            self._collect(manifest, docs, Mode(mode), partition_trunc, fragment_config)

    def _collect(self, manifest: dict[str, Any], docs: list[dict], mode: Mode, partition_trunc: str | None, fragment_config: list[str] | None) -> None:
        docs = list({str(d["id"]): d for d in docs}.values()) if mode is not Mode.insert else docs
        old = self.table("collections", manifest)
        ids = [str(d["id"]) for d in docs]
        there = {r["id"]: r for r in old.filter(F.col("id").isin(ids)).select("id", "fragment_config", "partition_trunc", "private").collect()}
        if mode is Mode.insert and (there or len(set(ids)) < len(ids)):
            raise Duplicate(f"collections there already: {sorted(there)}")
        if mode in (Mode.ignore, Mode.insert_ignore):
            docs = [d for d in docs if str(d["id"]) not in there]
        moved = []
        rows = []
        for d in docs:
            known = there.get(str(d["id"]))
            config = fragment_config if fragment_config is not None else (known["fragment_config"] if known else D.default_fragment_paths(d)) or None
            trunc = partition_trunc or (known["partition_trunc"] if known else None)
            if known and trunc != known["partition_trunc"]:
                moved.append((d["id"], trunc))
            rows.append(collection_row(d, trunc, config, known["private"] if known else None))
        new = self._collection_frame(rows)
        self._replace(manifest, "collections", old.join(new.select("id"), "id", "left_anti").unionByName(new))
        for id, trunc in moved:
            self._rebucket(manifest, id, trunc)

    def create_collection(self, doc: dict, partition_trunc: str | None = None, fragment_config: list[str] | None = None) -> None:
        self.load_collections([doc], Mode.insert, partition_trunc, fragment_config)

    def upsert_collection(self, doc: dict, partition_trunc: str | None = None, fragment_config: list[str] | None = None) -> None:
        self.load_collections([doc], Mode.upsert, partition_trunc, fragment_config)

    def update_collection(self, doc: dict, partition_trunc: str | None = None, fragment_config: list[str] | None = None) -> None:
        if self.get_collection(doc["id"]) is None:
            raise Missing(f"no collection {doc['id']}")
        self.upsert_collection(doc, partition_trunc, fragment_config)

    def delete_collection(self, id: str) -> None:
        """Its items, fragments and statistics go with it."""
        with self._change() as manifest:
            if self.get_collection(id) is None:
                raise Missing(f"no collection {id}")
            self._replace(manifest, "collections", self.table("collections", manifest).filter(F.col("id") != id))
            self._replace(manifest, "fragments", self.table("fragments", manifest).filter(F.col("collection") != id))
            manifest["items"] = [p for p in manifest["items"] if p["collection"] != id]

    def get_collection(self, id: str) -> dict | None:
        row = self.table("collections").filter(F.col("id") == id).select("content").first()
        return None if row is None else json.loads(row[0])

    def all_collections(self) -> list[dict]:
        return [json.loads(r[0]) for r in self.table("collections").orderBy("id").select("content").collect()]

    def repartition(self, collection: str, trunc: str | None) -> None:
        """A collection's items put into buckets of another length."""
        if trunc not in (None, "year", "month"):
            raise BadRequest("partition_trunc is year or month")
        with self._change() as manifest:
            c = self.table("collections", manifest)
            self._replace(manifest, "collections", c.withColumn("partition_trunc", F.when(F.col("id") == collection, F.lit(trunc)).otherwise(F.col("partition_trunc"))))
            self._rebucket(manifest, collection, trunc)

    def _rebucket(self, manifest: dict[str, Any], collection: str, trunc: str | None) -> None:
        parts = [p for p in manifest["items"] if p["collection"] == collection]
        n = sum(p["stats"][0] for p in parts)
        new = self._store(self.rows_of(parts).withColumn("dt_bucket", bucket(F.col("datetime"), F.lit(trunc or ""))), n) if n else {}
        self._commit(manifest, {(p["collection"], p["bucket"]): [] for p in parts} | new, {})

    # Extents

    def collection_bbox(self, id: str) -> list[float] | None:
        r = self.stats().filter(F.col("collection") == id).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
        return None if r[0] is None else list(r)

    def collection_temporal_extent(self, id: str) -> list[str | None]:
        from geolattice.functions.columns import time_text

        r = self.items(lambda p: p["collection"] == id).agg(time_text(F.min("datetime")), time_text(F.max("datetime"))).first()
        return list(r)

    def collection_extent(self, id: str) -> dict | None:
        """From the partitions' statistics: least start, greatest end, box of all."""
        from geolattice.functions.columns import time_text

        r = self.stats().filter(F.col("collection") == id).agg(time_text(F.min("dt_lo")), time_text(F.max("edt_hi"))).first()
        box = self.collection_bbox(id)
        return None if box is None and r[0] is None else {"spatial": {"bbox": [box]}, "temporal": {"interval": [list(r)]}}

    def update_collection_extents(self) -> None:
        docs = []
        for doc in self.all_collections():
            extent = self.collection_extent(doc["id"])
            if extent is not None:
                docs.append(doc | {"extent": extent})
        if docs:
            self.load_collections(docs, Mode.upsert)

    # Queryables

    def queryables(self) -> dict[str, Queryable]:
        return {q["name"]: Queryable(**q) for q in self.manifest["queryables"]}

    def add_queryables(self, new: list[Queryable], delete_missing: bool = False) -> None:
        """A name may be registered once for a collection; collections must exist."""
        known = {r[0] for r in self.table("collections").select("id").collect()}
        kept = [] if delete_missing else [q for q in self.manifest["queryables"] if q["name"] not in {n.name for n in new}]
        seen: set[tuple[str, str | None]] = set()
        for q in new:
            for c in q.collections or [None]:
                if c is not None and c not in known:
                    raise Missing(f"no collection {c}")
                if (q.name, c) in seen or (q.name, None) in seen:
                    raise Duplicate(f"{q.name} is registered twice for one collection")
                seen.add((q.name, c))
        with self._change() as manifest:
            manifest["queryables"] = kept + [vars(q) for q in new]

    # Maintenance

    def gc_fragments(self, collection: str | None = None, retention_days: float = 90) -> dict[str, int]:
        """Old fragments that no item refers to go; how many, by collection."""
        with self._change() as manifest:
            frags = self.table("fragments", manifest)
            used = self.rows_of(manifest["items"]).select("collection", F.col("fragment_hash").alias("hash")).filter("hash is not null").distinct()
            old = F.col("created_at") < F.current_timestamp() - F.make_interval(days=F.lit(0), secs=F.lit(retention_days * 86400))
            gone = frags.filter(old if collection is None else old & (F.col("collection") == collection)).join(used, ["collection", "hash"], "left_anti").select("collection", "hash")
            counts = {r[0]: r[1] for r in gone.groupBy("collection").count().collect()}
            if counts:
                self._replace(manifest, "fragments", frags.join(gone, ["collection", "hash"], "left_anti"))
        return counts

    def gc_deleted(self, retention_days: float = 30) -> int:
        with self._change() as manifest:
            log = self.table("deleted", manifest)
            old = F.col("deleted_at") < F.current_timestamp() - F.make_interval(secs=F.lit(retention_days * 86400))
            n = log.filter(old).count()
            if n:
                self._replace(manifest, "deleted", log.filter(~old))
        return n

    def analyze(self, collection: str | None = None) -> int:
        """Statistics of all partitions, or of a collection's, taken anew from their files; how many had others before."""
        with self._change() as manifest:
            parts = [p for p in manifest["items"] if collection is None or p["collection"] == collection]
            before = [p["stats"] for p in parts]
            self._measure(parts)
        return sum(a != p["stats"] for a, p in zip(before, parts))

    def violations(self) -> DataFrame:
        """collection, dt_bucket, id, reason of items that aren't where they should be: outside the statistics or the time bucket of their partition, twice in a collection, or of an unknown collection."""
        trunc = self.table("collections").select(F.col("id").alias("collection"), F.coalesce("partition_trunc", F.lit("")).alias("trunc"), F.lit(True).alias("known"))
        rows = self.items().select("collection", "dt_bucket", "id", "datetime", "end_datetime", "xmin", "ymin", "xmax", "ymax")
        stats = self.stats().select("collection", "dt_bucket", "dt_lo", "dt_hi", "edt_lo", "edt_hi", *[F.col(c).alias("s_" + c) for c in ("xmin", "ymin", "xmax", "ymax")])
        placed = rows.join(trunc, "collection", "left").join(stats, ["collection", "dt_bucket"], "left")
        outside = (F.col("datetime") < F.col("dt_lo")) | (F.col("datetime") > F.col("dt_hi")) | (F.col("end_datetime") < F.col("edt_lo")) | (F.col("end_datetime") > F.col("edt_hi"))
        beyond = (F.col("xmin") < F.col("s_xmin")) | (F.col("ymin") < F.col("s_ymin")) | (F.col("xmax") > F.col("s_xmax")) | (F.col("ymax") > F.col("s_ymax"))
        reason = F.when(F.col("known").isNull(), "unknown collection").when(F.col("dt_lo").isNull() | outside | beyond, "outside its partition's statistics").when(F.col("dt_bucket") != bucket(F.col("datetime"), F.col("trunc")), "in another time bucket")
        twice = rows.groupBy("collection", "id").agg(F.max("dt_bucket").alias("dt_bucket"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("collection", "dt_bucket", "id", F.lit("twice in its collection").alias("reason"))
        return placed.select("collection", "dt_bucket", "id", reason.alias("reason")).filter("reason is not null").unionByName(twice)

    def vacuum(self, retention_hours: float = 24) -> int:
        """Folders that the manifest doesn't name and that are older than the retention are deleted; how many."""
        self._changes()
        manifest = self.manifest
        named = {x.split("/")[1] for p in manifest["items"] for x in p["paths"]} | {x.split("/")[1] for paths in manifest["tables"].values() for x in paths}
        edge, gone = (time.time() - retention_hours * 3600) * 1000, 0
        for kind in ("items", "staging", "_drafts", *_SMALL):
            path = self._path(f"{self.root}/{kind}")
            for x in self._fs.listStatus(path) if self._fs.exists(path) else []:
                if x.getPath().getName() not in named and x.getModificationTime() <= edge:
                    self._fs.delete(x.getPath(), True)
                    gone += 1
        return gone

    # Queue: names of jobs, stored, so that another process may run them

    @property
    def queue(self) -> list[str]:
        return self._read("queue.json") or []

    @property
    def queue_history(self) -> list[dict[str, Any]]:
        """What was run from the queue, oldest first."""
        return [self._read(f"queue_history/{x}") for x in self._names("queue_history") if not x.startswith(".")]

    def run_or_queue(self, name: str, job: Callable[[], Any] | None = None) -> None:
        """Now, or later if use_queue is on; a job queued twice runs once. A job of one's own is known by its name in this process."""
        later = self.settings.flag("use_queue")
        if later and name in (queue := self.queue):
            return
        if job is not None:
            self.jobs[name] = job
        if later:
            self._put("queue.json", [*queue, name])
        else:
            self.jobs[name]()

    def run_queued(self) -> int:
        """Runs what is queued until the time is up; failures are noted and don't stop the rest."""
        began, done = time.monotonic(), 0
        while (queue := self.queue) and time.monotonic() - began < float(self.settings.get("queue_timeout")):
            name, error, at = queue[0], None, time.time()
            self._put("queue.json", queue[1:])
            try:
                self.jobs[name]()
            except Exception as e:  # the queue's history says what failed
                error = f"{type(e).__name__}: {e}"
            self._put(f"queue_history/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", {"query": name, "at": at, "seconds": time.time() - at, "error": error})
            done += 1
        return done

    # Registered searches, stored, so that a key holds for other processes and after a restart

    def stored_search(self, key: str) -> dict[str, Any] | None:
        return self._read(f"searches/{key}.json")

    def store_search(self, key: str, value: dict[str, Any]) -> None:
        self._put(f"searches/{key}.json", value)

    def forget_search(self, key: str) -> None:
        self._fs.delete(self._path(f"{self.root}/searches/{key}.json"), False)

    def stored_searches(self) -> list[str]:
        return [x.removesuffix(".json") for x in self._names("searches") if x.endswith(".json") and not x.startswith(".")]
