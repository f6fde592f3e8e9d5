"""A CQL2 tree as a Spark Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolattice.functions import freetext, geometry
from geolattice.functions.columns import text_array, unaccent
from geolattice.functions.timeranges import Range, instant, parse_range
from geolattice.plans.normalize import BadRequest, bbox_polygon, properties_in
from geolattice.plans.properties import ARRAY, FLAG, NUMBER, TEXT, TIME, Properties, Queryable

#: Operators by name; callers may add their own. Each takes Columns and gives a Column.
OPS: dict[str, Callable[..., Column]] = {}
for _names, _f in (
    ("eq =", lambda a, b: a == b), ("neq ne != <>", lambda a, b: a != b), ("lt <", lambda a, b: a < b), ("lte le <=", lambda a, b: a <= b),
    ("gt >", lambda a, b: a > b), ("gte ge >=", lambda a, b: a >= b), ("like", lambda a, b: F.like(a, b)), ("ilike", lambda a, b: F.ilike(a, b)),
    ("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b), ("/", lambda a, b: a / b),
    ("not", lambda a: ~a), ("between", lambda a, b, c: a.between(b, c)), ("isnull", lambda a: a.isNull()),
    ("upper casei", F.upper), ("lower", F.lower), ("accenti", unaccent),
):
    OPS |= dict.fromkeys(_names.split(), _f)
ARITHMETIC = {"+", "-", "*", "/"}
TEXTUAL = {"like", "ilike", "upper", "lower", "casei", "accenti"}
RELATIONS = ("intersects", "equals", "disjoint", "touches", "within", "overlaps", "crosses", "contains")


class Compiler:
    def __init__(self, df: DataFrame, queryables: dict[str, Queryable] | None = None, additional_properties: bool = True, text_fields: tuple[str, ...] = ("description", "title", "keywords")):
        self.props = Properties(df, queryables)
        self.strict, self.text_fields = not additional_properties, text_fields

    def where(self, tree: Any) -> Column:
        """The rows that match; everything where tree is None."""
        if tree is None:
            return F.lit(True)
        if self.strict:
            for name in sorted(properties_in(tree)):
                if not self.props.known(name):
                    raise BadRequest(f"{name} is not a queryable property")
        return self.node(tree, None)[0]

    def node(self, j: Any, kind: str | None) -> tuple[Column, str | None]:
        """Column of a node and what it compares as; kind is what its siblings make it."""
        if isinstance(j, dict):
            if "filter" in j:
                return self.node(j["filter"], kind)
            for short in ("upper", "lower", "casei", "accenti"):
                if short in j:
                    return self.node({"op": short, "args": j[short]}, kind)
            if "op" in j:
                return self.call(str(j["op"]).lower(), j.get("args"))
            if "timestamp" in j or "date" in j:
                return self.time(j.get("timestamp", j.get("date"))), TIME
            if "interval" in j:
                raise BadRequest("an interval needs a temporal operator")
            if "property" in j:
                found = self.props.find(j["property"])
                if found.native:
                    return found.column, found.kind
                want = kind or found.kind
                return self.cast(found.column, want, TEXT), want or TEXT
        return self.literal(j, kind)

    def time(self, text: Any, dtype: str | None = None) -> Column:
        """A literal instant, of the type of the table's datetime."""
        mine = self.props.types.get("datetime")
        name = dtype or ("timestamp_ntz" if isinstance(mine, T.TimestampNTZType) else "timestamp")
        at = instant(str(text))
        if not at[:5].endswith("-"):
            at = "+" + at
        return F.lit(at if name == "timestamp_ntz" else at + "Z").cast(name)

    def literal(self, value: Any, kind: str | None) -> tuple[Column, str | None]:
        if value is None:
            return F.lit(None), kind
        if kind == TIME:
            return self.time(value), TIME
        if kind == NUMBER and not isinstance(value, (dict, list)):
            try:
                return F.lit(float(value)), NUMBER
            except (TypeError, ValueError):
                return F.lit(None).cast("double"), NUMBER
        if kind == FLAG:
            return F.lit(value if isinstance(value, bool) else str(value).lower() == "true"), FLAG
        if kind == TEXT:
            return F.lit(str(value).lower() if isinstance(value, bool) else str(value)), TEXT
        own = FLAG if isinstance(value, bool) else NUMBER if isinstance(value, (int, float)) else TEXT
        return F.lit(value), own

    def cast(self, c: Column, kind: str | None, own: str | None) -> Column:
        if kind == own or kind is None:
            return c
        if kind == NUMBER:
            return c.try_cast("double")
        if kind == TIME:
            return c.try_cast("timestamp_ntz" if isinstance(self.props.types.get("datetime"), T.TimestampNTZType) else "timestamp")
        if kind == FLAG:
            return c.try_cast("boolean")
        return c.cast("string")

    def call(self, op: str, args: Any) -> tuple[Column, str | None]:
        if args is None:
            raise BadRequest(f"{op} has no arguments")
        if op in ("and", "or"):
            parts = [self.node(a, None)[0] for a in (args if isinstance(args, list) else [args])]
            if not parts:
                raise BadRequest(f"{op} has no arguments")
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts), FLAG
        if op.startswith("t_") or op == "anyinteracts":
            return self.temporal(op, args), FLAG
        if op.startswith("s_") or op == "intersects":
            return self.spatial(op, args), FLAG
        if op == "q":
            fields = [self.props.find(f).column for f in self.text_fields]
            return freetext.matches([c.cast("string") for c in fields], args), FLAG
        if op in ("a_equals", "a_contains", "a_contained_by", "a_overlaps"):
            return self.arrays(op, args), FLAG
        args = args if isinstance(args, list) else [args]
        if op == "in":
            members = args[1]["list"] if isinstance(args[1], dict) and "list" in args[1] else args[1]
            args = [args[0], *members]
            if len(args) == 1:
                return F.lit(False), FLAG
        elif op not in OPS:
            raise BadRequest(f"operator {op} is not supported")
        kind = self.kind_of(op, args)
        cols = []
        for a in args:
            c, own = self.node(a, kind)
            cols.append(self.cast(c, kind, own) if op != "isnull" else c)
        if op == "in":
            return cols[0].isin(cols[1:]), FLAG
        if op in ARITHMETIC:
            return OPS[op](*cols), NUMBER
        return OPS[op](*cols), TEXT if op in ("upper", "lower", "casei", "accenti") else FLAG

    def kind_of(self, op: str, args: list[Any]) -> str | None:
        """One kind for all arguments: that of a typed property, else number if any is one, else text."""
        if op in ARITHMETIC:
            return NUMBER
        if op in TEXTUAL:
            return TEXT
        if op == "not":
            return None
        found = [self.props.find(a["property"]) for a in args if isinstance(a, dict) and isinstance(a.get("property"), str)]
        for f in found:
            if f.kind and f.kind != ARRAY and (f.native or f.kind != TEXT):
                return f.kind
        if any(isinstance(a, dict) and ("timestamp" in a or "date" in a) for a in args):
            return TIME
        inner = [self.node(a, None)[1] for a in args if isinstance(a, dict) and ("op" in a or {"upper", "lower", "casei", "accenti"} & a.keys())]
        if any(isinstance(a, (int, float)) and not isinstance(a, bool) for a in args) or NUMBER in inner:
            return NUMBER
        if inner and inner[0] == FLAG:
            return FLAG
        return TEXT

    def arrays(self, op: str, args: list[Any]) -> Column:
        sides = []
        for a in args:
            if isinstance(a, dict) and "property" in a:
                found = self.props.find(a["property"])
                sides.append(found.column.cast("array<string>") if found.kind == ARRAY and found.native else text_array(found.column))
            else:
                items = a if isinstance(a, list) else [a]
                sides.append(F.array(*[F.lit(str(x).lower() if isinstance(x, bool) else str(x)) for x in items]).cast("array<string>"))
        a, b = sides
        if op == "a_equals":
            return a == b
        if op == "a_overlaps":
            return F.arrays_overlap(a, b)
        inner, outer = (b, a) if op == "a_contains" else (a, b)
        return F.when(inner.isNotNull() & outer.isNotNull(), F.size(F.array_except(inner, outer)) == 0)

    def temporal(self, op: str, args: list[Any]) -> Column:
        bounds = parse_range(args[1])
        return temporal_predicate(op, F.col("datetime"), F.col("end_datetime"), bounds, self.time)

    def spatial(self, op: str, args: list[Any]) -> Column:
        name = op.removeprefix("s_")
        if name not in RELATIONS:
            raise BadRequest(f"spatial operator {op} is not supported")
        other = args[1]
        shape = bbox_polygon(other) if isinstance(other, list) else other
        try:
            box = geometry.box_of(shape)
        except (ValueError, TypeError, KeyError, IndexError, AttributeError) as error:
            raise BadRequest(f"not a geometry: {other}") from error
        if box is None:
            return F.lit(name == "disjoint")
        near = boxes_meet(box)
        if "geometry" not in self.props.types:
            if not is_rectangle(shape):
                raise BadRequest("the table has only boxes; give a bbox")
            return rectangle_predicate(name, box)
        exact = geometry.spatial_predicate(name, F.col("geometry"), shape)
        return ~near | exact if name == "disjoint" else near & exact


def boxes_meet(box: geometry.Box) -> Column:
    return (F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1])


def is_rectangle(shape: dict[str, Any]) -> bool:
    if shape.get("type") != "Polygon" or len(shape["coordinates"]) != 1:
        return False
    ring = [tuple(p[:2]) for p in shape["coordinates"][0]]
    return len(ring) == 5 and len({x for x, _ in ring}) == 2 and len({y for _, y in ring}) == 2


def rectangle_predicate(name: str, box: geometry.Box) -> Column:
    """Relation of the rows' rectangles to a box, in built-in expressions."""
    x0, y0, x1, y1 = F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")
    meet = boxes_meet(box)
    inner = (x0 < box[2]) & (x1 > box[0]) & (y0 < box[3]) & (y1 > box[1])
    within = (x0 >= box[0]) & (x1 <= box[2]) & (y0 >= box[1]) & (y1 <= box[3])
    contains = (x0 <= box[0]) & (x1 >= box[2]) & (y0 <= box[1]) & (y1 >= box[3])
    return {
        "intersects": meet, "disjoint": ~meet, "within": within, "contains": contains, "equals": within & contains,
        "touches": meet & ~inner, "overlaps": inner & ~within & ~contains, "crosses": F.lit(False),
    }[name]


def temporal_predicate(op: str, start: Column, end: Column, bounds: Range, literal: Callable[[str], Column]) -> Column:
    """start and end are the row's, bounds the request's; an open bound lies beyond all times."""
    lo, hi = bounds

    def cmp(c: Column, sign: str, bound: str | None, infinite: int) -> Column:
        if bound is None:
            return F.lit((sign in ("<", "<=") and infinite > 0) or (sign in (">", ">=") and infinite < 0))
        b = literal(bound)
        return {"<": c < b, "<=": c <= b, ">": c > b, ">=": c >= b, "=": c == b}[sign]

    sl = lambda sign: cmp(start, sign, lo, -1)
    sh = lambda sign: cmp(start, sign, hi, 1)
    el = lambda sign: cmp(end, sign, lo, -1)
    eh = lambda sign: cmp(end, sign, hi, 1)
    table = {
        "t_before": lambda: el("<"), "t_after": lambda: sh(">"), "t_meets": lambda: el("="), "t_metby": lambda: sh("="),
        "t_overlaps": lambda: sl("<") & el(">") & eh("<"), "t_overlappedby": lambda: sl(">") & sh("<") & eh(">"),
        "t_starts": lambda: sl("=") & eh("<"), "t_startedby": lambda: sl("=") & eh(">"),
        "t_during": lambda: sl(">") & eh("<"), "t_contains": lambda: sl("<") & eh(">"),
        "t_finishes": lambda: sl(">") & eh("="), "t_finishedby": lambda: sl("<") & eh("="), "t_equals": lambda: sl("=") & eh("="),
        "t_disjoint": lambda: ~(sh("<=") & el(">=")), "t_intersects": lambda: sh("<=") & el(">="), "anyinteracts": lambda: sh("<=") & el(">="),
    }
    if op not in table:
        raise BadRequest(f"operator {op} is not supported")
    return table[op]()
