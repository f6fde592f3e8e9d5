"""Search by tile or shape: the fewest rows, in the search's order, that cover it.

Which row is next worth taking depends on those taken before, so the walk is a fold over
an ordered list. Spark filters by the shape, orders and cuts the list; the driver folds it
as it streams in, and stops early.
"""

from __future__ import annotations

import json
import math
import time
from typing import Any

import numpy as np

from geolattice.functions.columns import MERC_MAX
from geolattice.functions.geometry import Box, Shape, clip, union_area
from geolattice.operators import items as I
from geolattice.operators.search import TOP_K, Search, plan
from geolattice.plans.envelope import envelope
from geolattice.plans.normalize import bbox_polygon


def tile_envelope(zoom: int, x: int, y: int) -> Box:
    """Web-Mercator square of a tile, in metres."""
    size = 2 * MERC_MAX / 2**zoom
    return x * size - MERC_MAX, MERC_MAX - (y + 1) * size, (x + 1) * size - MERC_MAX, MERC_MAX - y * size


def tile_lonlat(zoom: int, x: int, y: int) -> Box:
    x0, y0, x1, y1 = tile_envelope(zoom, x, y)
    lat = lambda m: math.degrees(2 * math.atan(math.exp(m / MERC_MAX * math.pi)) - math.pi / 2)
    return x0 / MERC_MAX * 180, lat(y0), x1 / MERC_MAX * 180, lat(y1)


def rectangle(polygon: list) -> Box | None:
    """Sides of a polygon that is a rectangle along the axes."""
    if len(polygon) != 1 or len(polygon[0]) != 5 or len(set(polygon[0])) != 4:
        return None
    xs, ys = {x for x, _ in polygon[0]}, {y for _, y in polygon[0]}
    return (min(xs), min(ys), max(xs), max(ys)) if len(xs) == len(ys) == 2 else None


class Coverage:
    """What of a shape is covered so far. Rows are cut to the shape's box; within a shape that isn't one, areas count only inside it.

    As long as the shape and the rows are rectangles, what is still free is kept as a list
    of rectangles, so that a row costs one pass over these. Of other rows, what is gained is
    found from the parts near it alone.
    """

    def __init__(self, shape: Shape):
        self.shape, self.total, self.parts, self.area = shape, union_area(shape.polygons), [], 0.0
        self.boxes = np.zeros((0, 4))
        box = rectangle(shape.polygons[0]) if len(shape.polygons) == 1 else None
        self.is_box, self.free = box is not None, None if box is None else np.array([box])

    def _covered(self, parts: list) -> float:
        if self.is_box:
            return union_area(parts)
        # |A and B| = |A| + |B| - |A or B|
        return union_area(parts) + self.total - union_area([*parts, *self.shape.polygons])

    def _take(self, box: Box) -> float:
        """Takes a rectangle out of what is free; the area that it took."""
        f = self.free
        x0, y0, x1, y1 = np.maximum(f[:, 0], box[0]), np.maximum(f[:, 1], box[1]), np.minimum(f[:, 2], box[2]), np.minimum(f[:, 3], box[3])
        hit = (x0 < x1) & (y0 < y1)
        if not hit.any():
            return 0.0
        g, x0, y0, x1, y1 = f[hit], x0[hit], y0[hit], x1[hit], y1[hit]
        rest = np.concatenate([
            np.stack([g[:, 0], g[:, 1], x0, g[:, 3]], 1), np.stack([x1, g[:, 1], g[:, 2], g[:, 3]], 1),
            np.stack([x0, g[:, 1], x1, y0], 1), np.stack([x0, y1, x1, g[:, 3]], 1),
        ])
        self.free = np.concatenate([f[~hit], rest[(rest[:, 0] < rest[:, 2]) & (rest[:, 1] < rest[:, 3])]])
        return float(((x1 - x0) * (y1 - y0)).sum())

    def _gain(self, polygon: list) -> float:
        box = rectangle(polygon)
        if self.free is not None and box is not None:
            return self._take(box)
        self.free = None
        xs, ys = [x for r in polygon for x, _ in r], [y for r in polygon for _, y in r]
        b = self.boxes
        near = [self.parts[k] for k in np.flatnonzero((b[:, 0] < max(xs)) & (b[:, 2] > min(xs)) & (b[:, 1] < max(ys)) & (b[:, 3] > min(ys)))]
        return self._covered([*near, polygon]) - self._covered(near)

    def add(self, geometry: dict | str) -> bool:
        """Takes a row in; whether it covers anything new."""
        gained = 0.0
        for p in Shape(geometry).polygons:
            if cut := clip(p, self.shape.box):
                gain = self._gain(cut)
                if gain > 0:
                    ring = cut[0]
                    self.parts.append(cut)
                    self.boxes = np.vstack([self.boxes, [min(x for x, _ in ring), min(y for _, y in ring), max(x for x, _ in ring), max(y for _, y in ring)]])
                    gained += gain
        grew = gained > 1e-12 * max(self.total, 1e-30)
        self.area += gained
        return grew

    @property
    def full(self) -> bool:
        return self.area >= self.total * (1 - 1e-9)


def geometry_search(search: Search, geometry: dict, key: str, fields: dict | None = None, scanlimit: int | None = 10_000, limit: int = 100, timelimit: float = 5.0, exitwhenfull: bool = True, skipcovered: bool = True) -> dict[str, Any]:
    """FeatureCollection of a registered search's items over a geometry."""
    shape = Shape(geometry)
    if not shape.polygons:
        exitwhenfull = skipcovered = False
    exitwhenfull = exitwhenfull or skipcovered
    stored = search.from_hash(key)
    meets = {"op": "s_intersects", "args": [{"property": "geometry"}, geometry]}
    tree = {"op": "and", "args": [stored.tree, meets]} if stored.tree else meets
    request = {"filter": tree, "sortby": stored.search.get("sortby"), "filter-lang": "cql2-json"}
    rows = search.scan(envelope(tree, search._collections()))
    p = plan(rows, request, search.catalog.queryables(), search.settings)
    ordered = p.matched.orderBy(*[k.order() for k in p.keys])
    if scanlimit is not None and scanlimit <= TOP_K:  # a top-k; of more rows a sort, from which as many are taken
        ordered = ordered.limit(scanlimit)
    began, cover, taken = time.monotonic(), Coverage(shape) if shape.polygons else None, []
    for scanned, row in enumerate(ordered.select("id", "collection", "geometry").toLocalIterator(prefetchPartitions=False)):
        if scanlimit is not None and scanned >= scanlimit:
            break
        grew = cover.add(row["geometry"]) if cover else True
        if skipcovered and not grew:
            continue
        taken.append((row["id"], row["collection"]))
        if len(taken) >= limit or time.monotonic() - began > timelimit or (exitwhenfull and cover and cover.full):
            break
    if not taken:
        return {"type": "FeatureCollection", "features": []}
    wanted = search.catalog.spark.createDataFrame([(i, c, n) for n, (i, c) in enumerate(taken)], "id string, collection string, place int")
    docs = I.hydrate(rows.join(wanted, ["id", "collection"]), search.catalog.table("fragments"), fields, "place").orderBy("place").collect()
    return {"type": "FeatureCollection", "features": [json.loads(r["doc"]) for r in docs]}


def geojson_search(search: Search, geojson: dict, key: str, **options: Any) -> dict[str, Any]:
    return geometry_search(search, geojson.get("geometry", geojson) if geojson.get("type") == "Feature" else geojson, key, **options)


def xyz_search(search: Search, x: int, y: int, z: int, key: str, **options: Any) -> dict[str, Any]:
    return geometry_search(search, bbox_polygon(list(tile_lonlat(z, x, y))), key, **options)
