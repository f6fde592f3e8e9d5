"""The catalog from the command line: python -m geolattice ROOT COMMAND ...; results are JSON, one document a line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession

from geolattice import __version__
from geolattice.operators.catalog import Catalog, Mode
from geolattice.operators.queryables import extension_urls, from_schema, merged, missing
from geolattice.operators.search import Search
from geolattice.operators.tiles import geojson_search, xyz_search
from geolattice.sources.readers import load_queryables, read_dehydrated, read_json


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="geolattice", description=__doc__)
    out.add_argument("root", help="the catalog's folder, of any Hadoop file system; made if there is none")
    out.add_argument("--version", action="version", version=__version__)
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, *arguments: tuple[str, dict[str, Any]]) -> None:
        c = sub.add_parser(name, help=help)
        for a, options in arguments:
            c.add_argument(a, **options)

    mode = ("--mode", {"choices": [m.value for m in Mode], "default": "insert", "help": "what becomes of what is there already"})
    request = ("request", {"help": "a search request, as JSON"})
    key = ("key", {"help": "hash of a registered search"})
    command("collections", "list the collections' documents")
    command("load-collections", "collections from NDJSON or a JSON array", ("path", {}), mode, ("--partition", {"choices": ["year", "month"]}), ("--fragment", {"action": "append", "help": "a path that items share; may be repeated"}))
    command("load", "items from NDJSON, a JSON array or a FeatureCollection", ("path", {}), mode, ("--dehydrated", {"action": "store_true", "help": "a tab-separated dump"}))
    command("get", "an item", ("id", {}), ("--collection", {}))
    command("delete", "delete an item", ("id", {}), ("--collection", {}))
    command("delete-collection", "delete a collection and its items", ("id", {}))
    command("search", "one page of items", request)
    command("search-all", "the items of all pages", request, ("--most", {"type": int}))
    command("collection-search", "one page of collections", request)
    command("register", "make a search known by its hash", request, ("--metadata", {"default": "{}"}))
    command("tile", "items of a registered search in a tile", key, *[(n, {"type": int}) for n in "xyz"])
    command("shape", "items of a registered search over a GeoJSON geometry", key, ("geometry", {}))
    command("queryables", "the JSON schema of what may be queried", ("--collection", {"action": "append"}))
    command("load-queryables", "queryables from a JSON schema file", ("path", {}), ("--collection", {"action": "append"}), ("--delete-missing", {"action": "store_true"}))
    command("missing-queryables", "properties that nothing registers", ("--percent", {"type": float, "default": 5.0}))
    command("extensions", "schemas that the collections name")
    command("repartition", "put a collection into buckets of another length", ("collection", {}), ("--partition", {"choices": ["year", "month"]}))
    command("extents", "write the collections' extents from their items")
    command("stats", "the partitions and their statistics")
    command("analyze", "take the partitions' statistics anew", ("--collection", {}))
    command("violations", "items that aren't where they should be")
    command("gc", "delete old fragments that nobody uses, old tombstones and unused searches", ("--days", {"type": float, "default": 90}))
    command("vacuum", "delete files that the catalog doesn't name any more", ("--hours", {"type": float, "default": 24}))
    command("run-queue", "run what is queued")
    command("history", "what was run from the queue")
    command("set", "store a setting", ("name", {}), ("value", {}))
    return out


def run(spark: SparkSession, a: argparse.Namespace) -> Iterable[Any]:
    """What the command says, a document each."""
    catalog = Catalog(spark, a.root)
    search = Search(catalog)
    rows = lambda df: (r.asDict(True) for r in df.toLocalIterator())
    match a.command:
        case "collections":
            return catalog.all_collections()
        case "load-collections":
            docs = [json.loads(r[0]) for r in read_json(spark, a.path).collect()]  # a list that is small, as collections are
            catalog.load_collections(docs, a.mode, a.partition, a.fragment)
            return [{"collections": len(docs)}]
        case "load":
            return [{"items": catalog.load_items((read_dehydrated if a.dehydrated else read_json)(spark, a.path), a.mode)}]
        case "get":
            return [x] if (x := catalog.get_item(a.id, a.collection)) else []
        case "delete":
            catalog.delete_item(a.id, a.collection)
        case "delete-collection":
            catalog.delete_collection(a.id)
        case "search":
            return [search.search(json.loads(a.request))]
        case "search-all":
            return search.search_all(json.loads(a.request), a.most)
        case "collection-search":
            return [search.collection_search(json.loads(a.request))]
        case "register":
            return [{"hash": search.register(json.loads(a.request), json.loads(a.metadata)).hash}]
        case "tile":
            return [xyz_search(search, a.x, a.y, a.z, a.key)]
        case "shape":
            return [geojson_search(search, json.loads(a.geometry), a.key)]
        case "queryables":
            found = merged(catalog.queryables(), [c["id"] for c in catalog.all_collections()], a.collection, catalog.settings.flag("additional_properties"))
            return [found] if found else []
        case "load-queryables":
            catalog.add_queryables(from_schema(load_queryables(a.path), a.collection), a.delete_missing)
        case "missing-queryables":
            return rows(missing(catalog.items(), list(catalog.queryables()), a.percent))
        case "extensions":
            return rows(extension_urls(catalog.table("collections")))
        case "repartition":
            catalog.repartition(a.collection, a.partition)
        case "extents":
            catalog.run_or_queue("extents")
        case "stats":
            return rows(catalog.stats())
        case "analyze":
            return [{"changed": catalog.analyze(a.collection)}]
        case "violations":
            return rows(catalog.violations())
        case "gc":
            return [{"fragments": catalog.gc_fragments(retention_days=a.days), "deleted": catalog.gc_deleted(a.days), "searches": search.gc_searches(a.days)}]
        case "vacuum":
            return [{"folders": catalog.vacuum(a.hours)}]
        case "run-queue":
            return [{"ran": catalog.run_queued()}]
        case "history":
            return catalog.queue_history
        case "set":
            catalog.settings.set(a.name, a.value)
    return []


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("geolattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        for doc in run(spark, a):
            print(json.dumps(doc, default=str, ensure_ascii=False))
    except (ValueError, KeyError, PermissionError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0
