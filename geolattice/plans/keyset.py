"""Sort keys, their order, and tokens that say where a page ends."""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolattice.plans.normalize import BadRequest
from geolattice.plans.properties import NUMBER, TEXT, TIME, Properties

PART, NULL = "\x1f", "\x1e"
NEVER_NULL = ("id", "collection", "datetime", "end_datetime")


@dataclass
class Key:
    field: str
    column: Column
    kind: str | None
    descending: bool
    dtype: str

    def order(self, back: bool = False) -> Column:
        """Nulls are the highest values."""
        return self.column.desc_nulls_first() if self.descending != back else self.column.asc_nulls_last()

    def value(self, text: str) -> Column:
        return F.lit(text).cast(self.dtype)


def sort_keys(props: Properties, sortby: list[dict[str, Any]] | None, default: tuple[str, str] = ("datetime", "desc")) -> list[Key]:
    """The request's keys, then id and collection in the first one's direction; of a field named twice the first counts."""
    asked = [{"field": s[1:] if s[0] in "+-" else s, "direction": "desc" if s[0] == "-" else "asc"} if isinstance(s, str) else s for s in sortby or [{"field": default[0], "direction": default[1]}]]
    lead = asked[0].get("direction")
    out: dict[str, Key] = {}
    for s in [*asked, {"field": "id", "direction": lead}, {"field": "collection", "direction": lead}]:
        name = str(s["field"])
        bare = name.removeprefix("properties.")
        if bare in out or bare == "collection" and "collection" not in props.types:
            continue
        found = props.find(name)
        column = found.column if found.native or found.kind in (None, TEXT) else found.column.try_cast("double" if found.kind == NUMBER else "timestamp")
        dtype = found.dtype.simpleString() if found.native and found.dtype is not None else {NUMBER: "double", TIME: "timestamp"}.get(found.kind, "string")
        out[bare] = Key(bare, column, found.kind, str(s.get("direction") or "asc").lower().startswith("desc"), dtype)
    return list(out.values())


def seek(keys: list[Key], values: list[str | None], back: bool = False) -> Column | None:
    """Rows that come after the token's in the order of the keys (before it, if back)."""
    if len(values) != len(keys):
        raise BadRequest("the token doesn't fit this search's sort keys")
    alternatives, equal = [], []
    for key, text in zip(keys, values):
        c, down = key.column, key.descending != back
        if text is None:
            beyond = c.isNotNull() if down else None
        elif down:
            beyond = c < key.value(text)
        else:
            beyond = c > key.value(text) if key.field in NEVER_NULL else (c > key.value(text)) | c.isNull()
        if beyond is not None:
            alternatives.append(reduce(lambda a, b: a & b, [*equal, beyond]))
        equal.append(c.isNull() if text is None else c == key.value(text))
    return reduce(lambda a, b: a | b, alternatives) if alternatives else None


def as_text(value: Any) -> str | None:
    if value is None:
        return None
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.%f")
    return repr(value) if isinstance(value, float) else str(value)


def encode(values: list[str | None]) -> str:
    return base64.b64encode(PART.join(NULL if v is None else v for v in values).encode()).decode()


def decode(token: str) -> list[str | None]:
    try:
        text = base64.b64decode(token, validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError) as error:
        raise BadRequest("not a page token") from error
    return [None if v == NULL else v for v in text.split(PART)]
