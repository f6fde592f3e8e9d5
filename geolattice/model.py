"""The item model: promoted properties, and the schema of items at rest."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T


def column_name(prop: str) -> str:
    return prop.replace(":", "_")


@dataclass(frozen=True)
class Promoted:
    """A property kept in a typed column of its own."""

    name: str
    kind: str  # time, text, texts, double, long, int, json

    @property
    def column(self) -> str:
        return column_name(self.name)

    @property
    def dtype(self) -> T.DataType:
        return {"time": T.TimestampType(), "text": T.StringType(), "texts": T.ArrayType(T.StringType()), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "json": T.StringType()}[self.kind]

    def definition(self) -> dict[str, Any]:
        shape = {"time": dict(type="string", format="date-time"), "texts": {"type": "array"}, "double": {"type": "number"}, "long": {"type": "integer"}, "int": {"type": "integer"}, "json": {"type": "array"}}
        return {"title": self.name.split(":")[-1].replace("_", " ").title(), **shape.get(self.kind, {"type": "string"})}


_KINDS = {
    "time": "created updated sat:anx_datetime",
    "text": "platform constellation mission proj:code proj:wkt2 sci:doi sci:citation file:checksum file:byte_order sat:orbit_state sat:platform_international_designator",
    "texts": "instruments",
    "double": "eo:cloud_cover eo:snow_cover gsd view:off_nadir view:incidence_angle view:azimuth view:sun_azimuth view:sun_elevation view:moon_azimuth view:moon_elevation",
    "long": "file:size file:header_size",
    "int": "sat:relative_orbit sat:absolute_orbit",
    "json": "bands proj:geometry proj:projjson proj:bbox proj:centroid proj:shape proj:transform sci:publications",
}
PROMOTED = [Promoted(name, kind) for kind, names in _KINDS.items() for name in names.split()]
PROMOTED_NAMES = {p.name for p in PROMOTED}
TEMPORAL = ("datetime", "start_datetime", "end_datetime")

_S, _TS, _D = T.StringType(), T.TimestampType(), T.DoubleType()
ITEM_SCHEMA = T.StructType(
    [
        T.StructField("id", _S), T.StructField("collection", _S), T.StructField("geometry", _S),
        *(T.StructField(c, _D) for c in ("xmin", "ymin", "xmax", "ymax")),
        T.StructField("datetime", _TS), T.StructField("end_datetime", _TS), T.StructField("datetime_is_range", T.BooleanType()),
        T.StructField("stac_version", _S), T.StructField("stac_extensions", _S), T.StructField("updated_at", _TS),
        T.StructField("item_hash", _S), T.StructField("fragment_hash", _S),
        *(T.StructField(c, _S) for c in ("bbox", "links", "assets", "properties", "extra")),
        *(T.StructField(p.column, p.dtype) for p in PROMOTED),
        T.StructField("link_hrefs", T.ArrayType(_S)), T.StructField("private", _S),
    ]
)
#: Columns that say what an item is; the others follow from these or are kept by the engine.
CONTENT = [f.name for f in ITEM_SCHEMA.fields if f.name not in ("updated_at", "private", "item_hash")]

FRAGMENT_SCHEMA = T.StructType([T.StructField("collection", _S), T.StructField("hash", _S), T.StructField("content", _S), T.StructField("links_template", _S), T.StructField("created_at", _TS)])
COLLECTION_SCHEMA = T.StructType(
    [
        T.StructField("id", _S), T.StructField("content", _S), T.StructField("fragment_config", T.ArrayType(_S)), T.StructField("partition_trunc", _S), T.StructField("private", _S),
        T.StructField("geometry", _S), *(T.StructField(c, _D) for c in ("xmin", "ymin", "xmax", "ymax")), T.StructField("datetime", _TS), T.StructField("end_datetime", _TS),
    ]
)
TOMBSTONE_SCHEMA = T.StructType([T.StructField("item_id", _S), T.StructField("collection", _S), T.StructField("dt_bucket", _S), T.StructField("datetime", _TS), T.StructField("end_datetime", _TS), T.StructField("item_hash", _S), T.StructField("deleted_at", _TS)])
