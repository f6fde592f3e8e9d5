"""Searches of items and of collections: pages, counts, registered searches."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolattice.functions import documents as D
from geolattice.functions.timeranges import earlier, instant, order_key
from geolattice.operators import items as I
from geolattice.operators.bands import month_histogram
from geolattice.operators.catalog import Catalog
from geolattice.plans.compile import Compiler
from geolattice.plans.envelope import Envelope, envelope
from geolattice.plans.keyset import Key, decode, encode, seek, sort_keys
from geolattice.plans.normalize import BadRequest, search_tree
from geolattice.plans.properties import Queryable
from geolattice.plans.settings import Settings

DEFAULT_LIMIT = 10
#: A page's first band of partitions holds so many times the rows of the page.
BAND_MARGIN = 3
#: Rows that a task may hold for a top-k.
TOP_K = 100_000


@dataclass
class Plan:
    """A search that hasn't run: matching rows, their order, and where the page begins."""

    rows: DataFrame
    where: Column
    keys: list[Key]
    tree: dict | None
    after: Column | None = None
    back: bool = False
    lead: str | None = None  # first sort value of the token

    @property
    def matched(self) -> DataFrame:
        return self.rows.filter(self.where)

    def page(self, limit: int) -> DataFrame:
        """The first rows from the token on, in order: a top-k, not a sort, for Spark."""
        df = self.matched if self.after is None else self.matched.filter(self.after)
        return df.orderBy(*[k.order(self.back) for k in self.keys]).limit(limit)


def split_token(token: str | None) -> tuple[str | None, bool]:
    """The token without its prefix, and whether it leads back."""
    if not token:
        return None, False
    for prefix in ("next:", "prev:"):
        if token.startswith(prefix):
            return token[len(prefix) :], prefix == "prev:"
    return token, False


def plan(rows: DataFrame, request: dict, queryables: dict[str, Queryable] | None = None, settings: Settings | None = None, default_sort: tuple[str, str] = ("datetime", "desc"), text_fields: tuple[str, ...] = ("description", "title", "keywords")) -> Plan:
    """Compiles a request against any table with an item's columns; nothing is read."""
    settings = settings or Settings()
    conf = request.get("conf")
    tree = search_tree(request, str(settings.get("default_filter_lang", conf)))
    compiler = Compiler(rows, queryables, settings.flag("additional_properties", conf), text_fields)
    keys = sort_keys(compiler.props, request.get("sortby"), default_sort)
    token, back = split_token(request.get("token"))
    values = decode(token) if token else [None]
    return Plan(rows, compiler.where(tree), keys, tree, seek(keys, values, back) if token else None, back, values[0])


def search_df(rows: DataFrame, request: dict, queryables: dict[str, Queryable] | None = None, settings: Settings | None = None) -> DataFrame:
    """A page of matching rows in order, as a lazy DataFrame."""
    return plan(rows, request, queryables, settings).page(int(request.get("limit") or DEFAULT_LIMIT))


def search_hash(tree: dict | None, metadata: dict | None = None) -> str:
    """Identity of a search: its predicate and metadata, not its limit, order or token."""
    return D.digest({"where": tree, "metadata": metadata or {}})


@dataclass
class Registered:
    hash: str
    search: dict
    tree: dict | None
    metadata: dict
    usecount: int = 0
    lastused: float = 0.0
    stats_at: float | None = None
    count: int | None = None


@dataclass
class Page:
    features: list[dict]
    next: str | None
    prev: str | None
    matched: int | None


@dataclass
class Search:
    """Searches over a catalog."""

    catalog: Catalog
    searches: dict[str, Registered] = field(default_factory=dict)

    @property
    def settings(self) -> Settings:
        return self.catalog.settings

    def _collections(self) -> list[str]:
        return [r[0] for r in self.catalog.table("collections").select("id").collect()]

    def partitions(self, env: Envelope) -> list[dict]:
        """Partitions that the envelope leaves, by the statistics kept with them."""

        def span_ok(spans, lo, hi) -> bool:
            if spans is None or lo is None or hi is None:
                return True
            lo, hi = instant(lo), instant(hi)
            return any((b is None or not earlier(b, lo)) and (a is None or not earlier(hi, a)) for a, b in spans)

        def keep(p: dict) -> bool:
            if env.is_empty() or env.collections is not None and p["collection"] not in env.collections:
                return False
            if not p["stats"]:
                return True
            _, dlo, dhi, elo, ehi, x0, y0, x1, y1 = p["stats"]
            if not span_ok(env.start, dlo, dhi) or not span_ok(env.end, elo, ehi):
                return False
            return env.box is None or x0 is None or x0 <= env.box[2] and x1 >= env.box[0] and y0 <= env.box[3] and y1 >= env.box[1]

        return [p for p in self.catalog.manifest["items"] if keep(p)]

    def scan(self, env: Envelope) -> DataFrame:
        return self.catalog.rows_of(self.partitions(env))

    def plan(self, request: dict) -> Plan:
        tree = search_tree(request, str(self.settings.get("default_filter_lang", request.get("conf"))))
        return plan(self.scan(envelope(tree, self._collections())), request, self.catalog.queryables(), self.settings)

    def register(self, request: dict, metadata: dict | None = None) -> Registered:
        """Known by its hash from now on, to whoever opens the catalog; each call counts as a use."""
        tree = search_tree(request)
        key = search_hash(tree, metadata)
        found = self._stored(key) or Registered(key, request, tree, metadata or {})
        if not self.settings.flag("readonly", request.get("conf")):
            found.usecount += 1
            found.lastused = time.time()
            self._store(found)
        else:
            self.searches[key] = found
        return found

    def _stored(self, key: str) -> Registered | None:
        kept = self.catalog.stored_search(key)
        return Registered(**kept) if kept else self.searches.get(key)

    def _store(self, found: Registered) -> None:
        self.searches[found.hash] = found
        self.catalog.store_search(found.hash, vars(found))

    def from_hash(self, key: str) -> Registered:
        if (found := self._stored(key)) is None:
            raise BadRequest(f"no search {key}")
        return found

    def gc_searches(self, unused_days: float = 7) -> int:
        """Registered searches without metadata that nobody used for so long are forgotten; how many."""
        edge, gone = time.time() - unused_days * 86400, 0
        for key in self.catalog.stored_searches():
            found = self._stored(key)
            if found and not found.metadata and found.lastused < edge:
                self.searches.pop(key, None)
                self.catalog.forget_search(key)
                gone += 1
        return gone

    def count(self, request: dict, p: Plan, force: bool = False) -> int | None:
        """Matches: none if context is off; with auto an estimate from the statistics, if that is many; else exact. Either is kept for a while.

        The estimate takes the rows of the partitions that the request's envelope leaves,
        each by the share of its time range and of its box that the envelope covers.
        """
        conf = request.get("conf")
        context = str(self.settings.get("context", conf)).lower()
        if context == "off":
            return None
        kept = self._stored(search_hash(p.tree)) or self.register(request)
        ttl = float(self.settings.get("context_stats_ttl", conf))
        if not force and kept.count is not None and kept.stats_at is not None and time.time() - kept.stats_at < ttl:
            return kept.count
        estimate = self.estimate(p.tree) if context == "auto" else 0
        kept.count = estimate if estimate > int(self.settings.get("context_estimated_count", conf)) else p.matched.count()
        kept.stats_at = time.time()
        if not self.settings.flag("readonly", conf):
            self._store(kept)
        return kept.count

    def estimate(self, tree: dict | None) -> int:
        """Rows that may match, from the partitions' statistics alone."""
        env = envelope(tree, self._collections())
        total = 0.0
        for x in self.partitions(env):
            if x["stats"]:
                n, dlo, dhi, _, _, x0, y0, x1, y1 = x["stats"]
                share = 1.0
                if env.start is not None and dlo is not None and (width := I.micros(dhi) - I.micros(dlo)) > 0:
                    lo, hi = I.micros(dlo), I.micros(dhi)
                    share = sum(max(0, min(hi, hi if b is None else I.micros(b)) - max(lo, lo if a is None else I.micros(a))) for a, b in env.start) / width
                if env.box is not None and x0 is not None:
                    for lo, hi, a, b in ((x0, x1, env.box[0], env.box[2]), (y0, y1, env.box[1], env.box[3])):
                        share *= (min(hi, b) - max(lo, a)) / (hi - lo) if hi > lo else 1.0
                total += n * min(1.0, max(0.0, share))
        return round(total)

    def page(self, request: dict) -> Page:
        """One page; the rows are cut to it before documents are rebuilt."""
        p, limit = self.plan(request), int(request.get("limit") or DEFAULT_LIMIT)
        names = [f"k{n}" for n in range(len(p.keys))]
        texts = [(F.date_format(k.column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if k.dtype.startswith("timestamp") else k.column.cast("string")).alias(n) for n, k in zip(names, p.keys)]
        docs: list = []
        for part in self._bands(p, limit + 1):
            placed = part.page(limit + 1).select("*", *texts, F.monotonically_increasing_id().alias("place"))
            docs = I.hydrate(placed, self.catalog.table("fragments"), request.get("fields"), "place", *names).orderBy("place").collect()  # a page of rows
            if len(docs) > limit:
                break
        more, docs = len(docs) > limit, docs[:limit]
        if p.back:
            docs = docs[::-1]
        token = lambda r: encode([r[n] for n in names])
        has_next = (p.back or more) and docs
        has_prev = (more if p.back else p.after is not None) and docs
        return Page([json.loads(r["doc"]) for r in docs], token(docs[-1]) if has_next else None, token(docs[0]) if has_prev else None, self.count(request, p))

    def _bands(self, p: Plan, wanted: int) -> Iterator[Plan]:
        """Plans over ever more of the partitions, the last over all of them; each gives the first rows of the whole order, or too few.

        Where time is the first key, partitions are taken from the end at which the page
        begins until they hold `BAND_MARGIN` times the rows wanted, then four times as many
        each time.  Only rows beyond all times of the partitions not taken count.
        """
        parts = self.partitions(envelope(p.tree, self._collections()))
        if p.keys[0].field != "datetime" or len(parts) < 2 or any(not x["stats"] or x["stats"][1] is None for x in parts):
            yield p
            return
        down = p.keys[0].descending != p.back
        if p.lead is not None:  # partitions that lie wholly before the page
            at = instant(p.lead)
            parts = [x for x in parts if not (earlier(at, instant(x["stats"][1])) if down else earlier(instant(x["stats"][2]), at))]
        nearest = sorted(parts, key=lambda x: order_key(x["stats"][2 if down else 1]), reverse=down)
        goal, held, taken = wanted * BAND_MARGIN, 0, 0
        while taken < len(nearest):
            while taken < len(nearest) and held < goal:
                held += nearest[taken]["stats"][0]
                taken += 1
            if taken == len(nearest):
                break
            edge = F.lit(nearest[taken]["stats"][2 if down else 1]).cast("timestamp")
            yield replace(p, rows=self.catalog.rows_of(nearest[:taken]), where=p.where & (F.col("datetime") > edge if down else F.col("datetime") < edge))
            goal *= 4
        yield replace(p, rows=self.catalog.rows_of(parts))

    def search_plan(self, request: dict) -> dict[str, Any]:
        """A search that the caller runs: its rows as a DataFrame, and what its partitions say of where they lie in time."""
        p = self.plan(request)
        parts = self.partitions(envelope(p.tree, self._collections()))
        held = [x for x in parts if x["stats"]]
        stats = self.catalog.stats_of(held)
        return {
            "rows": p.page(int(request.get("limit") or DEFAULT_LIMIT)), "matched": p.matched, "keys": [(k.field, "desc" if k.descending else "asc") for k in p.keys],
            "histogram": month_histogram(stats), "estimate": sum(x["stats"][0] for x in held),
            "first": min((x["stats"][1] for x in held), key=order_key, default=None), "last": max((x["stats"][2] for x in held), key=order_key, default=None),
        }

    def collection_search_plan(self, request: dict) -> Plan:
        """A search of collections that the caller runs."""
        return plan(collections_as_items(self.catalog.table("collections")), request, self.catalog.queryables(), self.settings, ("id", "asc"))

    def search(self, request: dict | None = None) -> dict[str, Any]:
        """A FeatureCollection with links to itself and the pages beside it."""
        request = request or {}
        found = self.page(request)
        base = str(self.settings.get("base_url", request.get("conf"))).rstrip("/")
        out: dict[str, Any] = {"type": "FeatureCollection", "features": found.features, "links": links(base, "search", found.next, found.prev), "numberReturned": len(found.features)}
        return out if found.matched is None else out | {"numberMatched": found.matched}

    def search_all(self, request: dict, max_items: int | None = None) -> Iterator[dict]:
        """Features of all pages, one after the other.

        The first page is a top-k, as soon as it is there.  All others are one pass over
        the matching rows: sorted once, rebuilt by the executors and streamed in by
        partitions of the sort, so that their number costs no further scans.
        """
        found = self.page(request)
        left = None if max_items is None else max(0, max_items - len(found.features))
        yield from found.features[:max_items]
        if found.next is None or left == 0:
            return
        p = self.plan(request | {"token": "next:" + found.next})
        keys = [replace(k, column=F.col(f"k{n}")) for n, k in enumerate(p.keys)]
        rows = p.page(left) if left is not None and left <= TOP_K else p.matched.filter(p.after)
        rows = rows.select("*", *[k.column.alias(f"k{n}") for n, k in enumerate(p.keys)])
        docs = I.hydrate(rows, self.catalog.table("fragments"), request.get("fields"), *[f"k{n}" for n in range(len(keys))]).orderBy(*[k.order() for k in keys]).select("doc")
        for row in islice(docs.toLocalIterator(), left):
            yield json.loads(row["doc"])

    def collection_search(self, request: dict | None = None) -> dict[str, Any]:
        """Collections that match; always counted, by id if no order is asked for."""
        request = request or {}
        limit = int(request.get("limit") or DEFAULT_LIMIT)
        p = self.collection_search_plan(request)
        names = [f"k{n}" for n in range(len(p.keys))]
        got = p.page(limit + 1).select("content", *[k.column.cast("string").alias(n) for n, k in zip(names, p.keys)]).collect()
        more, got = len(got) > limit, got[:limit]
        if p.back:
            got = got[::-1]
        docs = [D.project(json.loads(r["content"]), request.get("fields")) for r in got]
        token = lambda r: encode([r[n] for n in names])
        base = str(self.settings.get("base_url", request.get("conf"))).rstrip("/")
        nxt = token(got[-1]) if (p.back or more) and got else None
        prv = token(got[0]) if (more if p.back else p.after is not None) and got else None
        return {"collections": docs, "links": links(base, "collections", nxt, prv), "numberMatched": p.matched.count(), "numberReturned": len(docs)}


def links(base: str, path: str, nxt: str | None, prv: str | None) -> list[dict]:
    def link(rel: str, href: str, kind: str = "json", **more: str) -> dict:
        return dict(rel=rel, type=f"application/{kind}", href=href, **more)

    here = f"{base}/{path}"
    beside = [link(rel, f"{here}?token={rel}:{token}", "geo+json", method="GET") for rel, token in (("next", nxt), ("prev", prv)) if token]
    return [link("root", base), link("self", here), *beside]


def page_token(document: dict, rel: str = "next") -> str | None:
    """Token in a page's link."""
    for link in document.get("links", []):
        if link.get("rel") == rel and "token=" in link["href"]:
            return link["href"].split("token=", 1)[1].split("&")[0]
    return None


def collections_as_items(collections: DataFrame) -> DataFrame:
    """Collections with an item's columns, so that one compiler serves both; what an item keeps elsewhere isn't among the properties.

    A collection without a start or an end is there since, or for, all times.
    """
    text = F.col("content")
    drop = ["links", "assets", "stac_version", "stac_extensions"]
    ever = lambda c, at: F.coalesce(c, F.lit(at).cast("timestamp")).alias(c)

    @F.pandas_udf("string")
    def rest(column: pd.Series) -> pd.Series:
        return column.map(lambda t: D.canonical({k: v for k, v in json.loads(t).items() if k not in drop}))

    return collections.select(
        "id", F.lit("collections").alias("collection"), "geometry", "xmin", "ymin", "xmax", "ymax", ever("datetime", "-200000-01-01 00:00:00Z"), ever("end_datetime", "+200000-01-01 00:00:00Z"), "content",
        *[F.get_json_object(text, f"$.{d}").alias(d) for d in drop], rest(text).alias("properties"),
    )
