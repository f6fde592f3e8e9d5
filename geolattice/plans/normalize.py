"""A search request as one CQL2 tree."""

from __future__ import annotations

from typing import Any

Tree = dict[str, Any]


class BadRequest(ValueError):
    """The request can't be understood."""


def prop(name: str) -> Tree:
    return {"property": name}


def from_query(query: dict[str, Any]) -> Tree:
    """The older `query` member: {property: {op: value}}, a bare value meaning equality."""
    args = []
    for name, ops in query.items():
        pairs = ops.items() if isinstance(ops, dict) else [("eq", ops)]
        args += [{"op": op, "args": [prop(name), value]} for op, value in pairs]
    return {"op": "and", "args": args}


def from_cql1(node: Any) -> Any:
    """CQL-JSON {op: args} as CQL2 {op, args}; geometries and scalars stay."""
    if isinstance(node, list):
        return [from_cql1(x) for x in node]
    if not isinstance(node, dict):
        return node
    if "filter" in node:
        return from_cql1(node["filter"])
    if "property" in node or "type" in node and ("coordinates" in node or "geometries" in node):
        return node
    for op, args in node.items():
        return {"op": op, "args": from_cql1(args)}
    return None


def mentions(node: Any, key: str) -> bool:
    if isinstance(node, dict):
        return key in node or any(mentions(x, key) for x in node.values())
    return isinstance(node, list) and any(mentions(x, key) for x in node)


def bbox_polygon(bbox: list[float]) -> Tree | None:
    """Rectangle of a bbox of 4 or 6 numbers."""
    if len(bbox) == 4:
        w, s, e, n = bbox
    elif len(bbox) == 6:
        w, s, _, e, n, _ = bbox
    else:
        return None
    ring = [[x, y] for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]
    return {"type": "Polygon", "coordinates": [ring]}


def geometry_of(request: dict) -> Tree | None:
    """intersects, else geometry, else bbox."""
    for key in ("intersects", "geometry"):
        if request.get(key) is not None:
            return request[key]
    return bbox_polygon(request["bbox"]) if request.get("bbox") is not None else None


def search_tree(request: dict, default_lang: str = "cql2-json") -> Tree | None:
    """Everything that restricts the rows of a search, joined by AND; None if nothing does."""
    parts: list[Tree] = []
    if request.get("ids") is not None:
        parts.append({"op": "in", "args": [prop("id"), request["ids"]]})
    if request.get("collections") is not None:
        parts.append({"op": "in", "args": [prop("collection"), request["collections"]]})
    if request.get("datetime") is not None:
        parts.append({"op": "anyinteracts", "args": [prop("datetime"), request["datetime"]]})
    if (geometry := geometry_of(request)) is not None:
        parts.append({"op": "s_intersects", "args": [prop("geometry"), geometry]})
    if request.get("q") is not None:
        parts.append({"op": "q", "args": request["q"]})
    if request.get("query") is not None and request.get("filter") is not None:
        raise BadRequest("query and filter can't be used together")
    if request.get("query") is not None:
        parts.append(from_query(request["query"]))
    elif request.get("filter") is not None:
        lang = request.get("filter-lang") or (request.get("conf") or {}).get("default_filter_lang") or default_lang
        old = lang == "cql-json" or not mentions(request["filter"], "op")
        tree = from_cql1(request["filter"]) if old else request["filter"]
        if tree:
            parts.append(tree)
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else {"op": "and", "args": parts}


def properties_in(node: Any) -> set[str]:
    """Names of all properties that a tree mentions."""
    if isinstance(node, list):
        return set().union(*map(properties_in, node)) if node else set()
    if not isinstance(node, dict):
        return set()
    own = {node["property"]} if isinstance(node.get("property"), str) else set()
    return own.union(*(properties_in(v) for k, v in node.items() if k != "property"))
