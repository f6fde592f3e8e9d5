"""What a property name stands for: a typed column, or a path in the JSON of an item."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolattice.model import PROMOTED, column_name

FIXED = "id geometry datetime end_datetime collection".split()
TOP = ("links", "assets", "stac_version", "stac_extensions")
NUMBER, TEXT, TIME, ARRAY, FLAG = "number", "text", "time", "array", "flag"
WRAPPERS = {"to_int": NUMBER, "to_float": NUMBER, "to_tstz": TIME, "to_text": TEXT, "to_text_array": ARRAY}


@dataclass
class Queryable:
    """A registered property."""

    name: str
    definition: dict[str, Any] = field(default_factory=dict)
    path: str | None = None
    wrapper: str | None = None
    collections: list[str] | None = None
    index: str | None = None

    def kind(self) -> str | None:
        """What its values compare as; None where the definition doesn't tell."""
        if self.wrapper:
            return WRAPPERS.get(self.wrapper, TEXT)
        if self.definition.get("type") in ("number", "integer"):
            return NUMBER
        if self.definition.get("format") in ("date-time", "date"):
            return TIME
        return None


def promoted_queryables() -> dict[str, Queryable]:
    out = {n: Queryable(n, {"type": t, "title": n.replace("_", " ").title()}, n) for n, t in (("stac_version", "string"), ("stac_extensions", "array"))}
    for p in PROMOTED:
        out[p.name] = Queryable(p.name, p.definition(), p.column)
    return out


def json_path(steps: list[str]) -> str:
    return "$" + "".join("['" + s.replace("'", "\\'") + "']" for s in steps)


@dataclass
class Found:
    """A resolved property: its column as stored, how it compares, and whether it is a typed column."""

    column: Column
    kind: str | None
    native: bool
    dtype: T.DataType | None = None


class Properties:
    """Resolves names against the columns of a table of items."""

    def __init__(self, df: DataFrame, queryables: dict[str, Queryable] | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.queryables = promoted_queryables() | (queryables or {})

    def known(self, name: str) -> bool:
        bare = name.removeprefix("properties.")
        return bare in FIXED or bare == "start_datetime" or bare in self.queryables or f"properties.{bare}" in self.queryables

    def find(self, name: str) -> Found:
        bare = name.replace("properties.", "", 1) if name.startswith("properties.") else name
        if bare == "start_datetime":
            bare = "datetime"
        if bare in FIXED:
            return Found(F.col(bare), _kind_of(self.types.get(bare)), True, self.types.get(bare))
        q = self.queryables.get(bare) or self.queryables.get(f"properties.{bare}")
        path = (q.path if q and q.path else None) or column_name(bare)
        if path in self.types and path not in ("properties", *TOP[:2]):
            dtype = self.types[path]
            return Found(F.col(f"`{path}`"), _kind_of(dtype), True, dtype)
        kind = q.kind() if q else None
        steps = (q.path if q and q.path and "." in q.path else bare).split(".")
        root = "properties"
        if steps[0] in TOP or steps[0] == "properties":
            root, steps = steps[0], steps[1:]
        if not steps:
            return Found(F.col(root), kind or TEXT, False)
        return Found(F.get_json_object(root, json_path(steps)), kind, False)


def _kind_of(dtype: T.DataType | None) -> str | None:
    if dtype is None:
        return None
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(dtype, T.ArrayType):
        return ARRAY
    if isinstance(dtype, T.BooleanType):
        return FLAG
    return TEXT
