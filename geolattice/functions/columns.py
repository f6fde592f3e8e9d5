"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what is left without the accent.
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
_BARE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
assert len(_ACCENTED) == len(_BARE)


def unaccent(c: Column) -> Column:
    x = F.translate(c, _ACCENTED, _BARE)
    for a, b in (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Ø", "O"), ("ø", "o"), ("Œ", "OE"), ("œ", "oe"), ("Ł", "L"), ("ł", "l"), ("Đ", "D"), ("đ", "d")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def json_text(c: Column) -> Column:
    """Text of a JSON scalar; arrays and objects stay JSON."""
    return F.get_json_object(c, "$")


def to_double(c: Column) -> Column:
    """Number of a JSON scalar, or of text that holds one; null otherwise."""
    return F.trim(json_text(c), F.lit('"')).try_cast("double")


def to_int(c: Column) -> Column:
    return F.floor(to_double(c)).try_cast("int")


def to_time(c: Column, ntz: bool = False) -> Column:
    return json_text(c).try_cast("timestamp_ntz" if ntz else "timestamp")


def text_array(c: Column) -> Column:
    """Elements of a JSON array as text; a scalar is one element."""
    return F.when(c.isNull(), F.lit(None).cast("array<string>")).when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def bbox_struct(c: Column) -> Column:
    """xmin, ymin, xmax, ymax of a bbox of 4 or 6 numbers; null for any other."""
    a = F.from_json(c, "array<double>") if not isinstance(c, list) else c
    pick = lambda *k: F.struct(*[F.element_at(a, i).alias(n) for i, n in zip(k, ("xmin", "ymin", "xmax", "ymax"))])
    return F.when(F.size(a) == 4, pick(1, 2, 3, 4)).when(F.size(a) == 6, pick(1, 2, 4, 5))


def bbox_array(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.when(xmin.isNotNull(), F.array(xmin, ymin, xmax, ymax))


def time_text(c: Column) -> Column:
    """ISO-8601 in UTC, with a fraction only if there is one."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z"))


def non_empty(c: Column) -> Column:
    """Null for JSON null, {} and []."""
    return F.when(~F.trim(c).isin("null", "{}", "[]"), c)


def empty_array(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) < 1


def prefixes(c: Column) -> Column:
    """All ancestors of a dotted path, the path last: a.b.c -> [a], [a, b], [a, b, c]."""
    steps = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.slice(steps, 1, k))


def qualify_refs(url: Column, c: Column) -> Column:
    """Local references of a JSON schema made absolute."""
    return F.regexp_replace(c, F.lit(r'"\$ref"\s*:\s*"#'), F.concat(F.lit('"\\$ref": "'), url, F.lit("#")))


def age_ms(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1000


MERC_MAX = 20037508.3427892


def tile_bounds(zoom: Column, x: Column, y: Column) -> dict[str, Column]:
    """Web-Mercator metres of a tile's sides."""
    size = F.lit(2 * MERC_MAX) / F.pow(F.lit(2.0), zoom)
    return {"x0": x * size - MERC_MAX, "x1": (x + 1) * size - MERC_MAX, "y0": F.lit(MERC_MAX) - (y + 1) * size, "y1": F.lit(MERC_MAX) - y * size}


def mercator_lon(x: Column) -> Column:
    return x / MERC_MAX * 180.0


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / MERC_MAX * 3.141592653589793)) - 1.5707963267948966)
