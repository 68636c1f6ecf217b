"""Scalars: geometry beyond areas, calibration and quantities, dates, digests, canonical JSON, names and array checks. All are
column expressions, but for canonical JSON, which Arrow functions make in batches."""

from __future__ import annotations

import json
import math
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.functions import measures as M
from quireframe.session import ship_to_active

EPSILON = 1e-9


def polyline(points: Column) -> Column:
    """Length of the way through an array of points (x, y)."""
    n = F.size(points)
    sides = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)


def metres_per_point(length: Column, unit: Column, points: Column) -> Column:
    """Scale of a drawing: a known length in mm, cm, m, in or ft over its points; null unless both are positive and the unit
    is known."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in M.METRES.items() for x in kv]), unit)
    return F.when((length > 0) & (points > 0), length * factor / points)


def fifteen_digits(value: Column) -> Column:
    """A number to fifteen significant digits."""
    return F.when(value == 0, 0.0).otherwise(F.format_string("%.14e", value).cast("double"))


def six_places(value: Column) -> Column:
    return F.round(value, 6)


def quantity(kind: Column, points: Column, scale: Column) -> Column:
    """What a measurement of a kind gives: count its points, distance and perimeter metres, area square metres."""
    closed = F.concat(points, F.slice(points, 1, 1))
    return F.when(kind == "count", F.size(points).cast("double")).when(kind == "distance", fifteen_digits(polyline(points) * scale)).when(kind == "perimeter", fifteen_digits(polyline(closed) * scale)).when(kind == "area", fifteen_digits(M.area(points) * scale * scale))


def displayed(value: Column, unit: Column) -> Column:
    """A value of metres, square metres or counts in a unit (ft2 and the like for areas)."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in M.METRES.items() for x in kv]), F.regexp_replace(unit, "2$", ""))
    return F.when(unit == "count", value).when(unit.endswith("2"), fifteen_digits(value / (factor * factor))).otherwise(fifteen_digits(value / factor))


def _turn(a: Column, b: Column, c: Column) -> Column:
    v = (b["y"] - a["y"]) * (c["x"] - b["x"]) - (b["x"] - a["x"]) * (c["y"] - b["y"])
    return F.when(F.abs(v) < EPSILON, 0).when(v > 0, 1).otherwise(2)


def _within(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] <= F.greatest(a["x"], c["x"])) & (b["x"] >= F.least(a["x"], c["x"])) & (b["y"] <= F.greatest(a["y"], c["y"])) & (b["y"] >= F.least(a["y"], c["y"]))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a-b and c-d touch or cross."""
    o1, o2, o3, o4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    return ((o1 != o2) & (o3 != o4)) | ((o1 == 0) & _within(a, c, b)) | ((o2 == 0) & _within(a, d, b)) | ((o3 == 0) & _within(c, a, d)) | ((o4 == 0) & _within(c, b, d))


def polygon_fault(points: Column) -> Column:
    """What is wrong with a polygon: degenerate (points that repeat one after the other, fewer than three different ones, no
    area), self-intersecting (sides that are not neighbours meet), or null."""
    n = F.size(points)
    at = lambda i: F.get(points, i % n)
    sides = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    apart = lambda i, j: (j > i + 1) & ((j + 1) % n != i)
    crossing = F.exists(sides, lambda i: F.exists(sides, lambda j: apart(i, j) & segments_meet(at(i), at(i + 1), at(j), at(j + 1))))
    repeats = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.get(points, i) == F.get(points, i - 1), F.lit(False)))
    return F.when((F.size(F.array_distinct(points)) < 3) | repeats, "degenerate").when(crossing, "self-intersecting").when(M.area(points) <= EPSILON, "degenerate")


def page_to_geo(x: Column, y: Column, origin_x: Column, origin_y: Column, scale: Column, degrees: Column) -> Column:
    """A page's point on the ground: scaled, turned and moved; a struct of x and y."""
    r, u, v = F.radians(degrees), x * scale, y * scale
    return F.struct((origin_x + u * F.cos(r) - v * F.sin(r)).alias("x"), (origin_y + u * F.sin(r) + v * F.cos(r)).alias("y"))


def calculated(operation: Column, a: Column, b: Column) -> Column:
    """add, subtract, multiply or divide of two numbers; null for another operation, a zero divisor or what is not finite."""
    out = F.when(operation == "add", a + b).when(operation == "subtract", a - b).when(operation == "multiply", a * b).when((operation == "divide") & (b != 0), a / F.nullif(b, F.lit(0.0)))
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def raster_dpi(width: Column, height: Column, width_points: Column, height_points: Column, tolerance: float = 3) -> Column:
    """Density of a page's raster; null where the two directions differ by more than ``tolerance`` or it is not 72 to 600."""
    x, y = width * 72 / width_points, height * 72 / height_points
    n = F.floor((x + y) / 2 + 0.5)
    return F.when((F.abs(x - y) <= tolerance) & (n >= 72) & (n <= 600), n.cast("int"))


def in_zone(left: Column, top: Column, width: Column, height: Column, image_width: Column, image_height: Column, zone: Column) -> Column:
    """A box in pixels of a zone's image as shares of the page; zone: x, y, width, height."""
    return F.struct((zone["x"] + left / image_width * zone["width"]).alias("x"), (zone["y"] + top / image_height * zone["height"]).alias("y"), (width / image_width * zone["width"]).alias("width"), (height / image_height * zone["height"]).alias("height"))


def crop_size(width: Column, height: Column, zone: Column) -> Column:
    """Pixels of a zone of a raster, one at least in each direction."""
    one = lambda a, b: F.greatest(F.lit(1), F.floor(a * b + 0.5)).cast("int")
    return F.struct(one(width, zone["width"]).alias("width"), one(height, zone["height"]).alias("height"))


def boxes_match(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two boxes (left, bottom, right, top) are the same but for ``tolerance``; null boxes are not."""
    return F.coalesce(reduce(lambda p, q: p & q, [F.abs(a[c] - b[c]) <= tolerance for c in ("left", "bottom", "right", "top")]), F.lit(False))


def box_holds(outer: Column, inner: Column) -> Column:
    """Whether a box lies in another, edges included; null boxes do not."""
    return F.coalesce((outer["left"] <= inner["left"]) & (outer["bottom"] <= inner["bottom"]) & (outer["right"] >= inner["right"]) & (outer["top"] >= inner["top"]), F.lit(False))


def calendar_date(text: Column) -> Column:
    """The date that a text of the form YYYY-MM-DD names, null if there is no such day."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def expires_later(text: Column, now: Column) -> Column:
    """Whether a moment lies after ``now``; a text that is no moment does not."""
    return F.coalesce(F.try_to_timestamp(text) > now, F.lit(False))


def retained_until(day: Column, days: Column) -> Column:
    """The last day of a retention of 1 to 36,500 days; null for any other number."""
    return F.when(days.between(1, 36_500), F.date_add(day, days.cast("int")))


def short_id(*parts: Column, length: int = 24) -> Column:
    """The first digits of the SHA-256 of parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def recipe_uuid(recipe: Column) -> Column:
    """A UUID of version 5 form made of the SHA-256 of a recipe's JSON text."""
    h = F.sha2(recipe, 256)
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.lit("uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _number(x: float) -> str:
    if isinstance(x, int):
        return str(x) if abs(x) < 2**53 else _number(float(x))
    if x == 0:
        return "0"
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?(?:e([+-]\d+))?", repr(abs(x)))
    d = (m[1] + (m[2] or "")).lstrip("0")
    point = len(m[1]) + int(m[3] or 0) - (len(m[1] + (m[2] or "")) - len(d))
    d = d.rstrip("0")
    k = len(d)
    if k <= point <= 21:
        s = d + "0" * (point - k)
    elif 0 < point <= 21:
        s = d[:point] + "." + d[point:]
    elif -6 < point <= 0:
        s = "0." + "0" * -point + d
    else:
        e = point - 1
        s = d[0] + ("." + d[1:] if k > 1 else "") + ("e+" if e > 0 else "e-") + str(abs(e))
    return "-" + s if x < 0 else s


def canonical_json(value) -> str:
    """JSON with the keys of all objects in order of their UTF-16 units, numbers in their shortest form and nothing between."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _no_constant(name: str):
    raise ValueError(name)


class _NotPlain(Exception):
    """A number whose canonical form is not what it was read as."""


def _whole(digits: str) -> int:
    if len(digits) > 15:
        raise _NotPlain
    return int(digits)


def _fraction(digits: str) -> float:
    raise _NotPlain


_read = json.JSONDecoder(parse_constant=_no_constant).decode
_read_plain = json.JSONDecoder(parse_constant=_no_constant, parse_int=_whole, parse_float=_fraction).decode
_write_plain = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def canonical_text(text: str) -> str | None:
    """The canonical form of a JSON text, as ``canonical``. Where the text is ASCII without escapes of other characters, and its numbers
    are whole ones of 15 characters at most, the library's own order and form are the canonical ones."""
    try:
        if text.isascii() and "\\u" not in text:
            try:
                return _write_plain(_read_plain(text))
            except _NotPlain:
                pass
        v = _read(text)
        return None if _infinite(v) else canonical_json(v)
    except (ValueError, RecursionError):
        return None


def canonical(text: Column) -> Column:
    """The canonical form of a JSON text; null where it is none or holds a number that is not finite."""

    ship_to_active()

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical_text(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def canonical_list(texts: Column) -> Column:
    """``canonical`` of each text of an array."""
    ship_to_active()

    def run(lists: pa.Array) -> pa.Array:
        ends = [0]
        for x in lists:
            ends.append(ends[-1] + (len(x) if x.is_valid else 0))
        flat = pa.array([None if t is None else canonical_text(t) for t in lists.flatten().to_pylist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(texts)


def _infinite(v) -> bool:
    if isinstance(v, dict):
        return any(map(_infinite, v.values()))
    return any(map(_infinite, v)) if isinstance(v, list) else isinstance(v, float) and not math.isfinite(v)


def provenance(text: Column) -> Column:
    """SHA-256 of a JSON text's canonical form."""
    return F.sha2(canonical(text), 256)


#: Keys that an object must not have, and what keys that carry secrets and texts that are paths look like.
UNSAFE_KEY = re.compile(r"^(?:__proto__|prototype|constructor)$", re.IGNORECASE)
SECRET_KEY = re.compile(r"(?:secret|token|password|credential|authorization|api[_-]?key)", re.IGNORECASE)
PATH_VALUE = re.compile(r"^(?:/|~/|\.\.?[\\/]|[A-Za-z]:[\\/]|\\\\)")


def json_fault(text: Column, depth: int = 8, keys: int = 100, length: int = 10_000) -> Column:
    """What makes a JSON text unsafe to keep: malformed, too-deep, too-many-keys, unsafe-key, secret-key, path-value or too-long;
    null if nothing does. The first of these that is met from the root down counts."""

    ship_to_active()

    def fault(v, level: int) -> str | None:
        if level > depth:
            return "too-deep"
        if isinstance(v, dict):
            if len(v) > keys:
                return "too-many-keys"
            for k, x in v.items():
                if UNSAFE_KEY.search(k):
                    return "unsafe-key"
                if SECRET_KEY.search(k):
                    return "secret-key"
                if f := fault(x, level + 1):
                    return f
        elif isinstance(v, list):
            return next((f for x in v if (f := fault(x, level + 1))), None)
        elif isinstance(v, str):
            return "too-long" if len(v) > length else "path-value" if PATH_VALUE.search(v) else None
        return None

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(fault(json.loads(t, parse_constant=_no_constant), 0) if t is not None else None)
            except (ValueError, RecursionError):
                out.append("malformed")
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)


def dense(values: Column, low: int, high: int) -> Column:
    """Whether an array has ``low`` to ``high`` values, none null and none twice."""
    n = F.size(values)
    return F.coalesce(n.between(low, high) & (F.size(F.array_compact(values)) == n) & (F.size(F.array_distinct(values)) == n), F.lit(False))


def allowed_properties(properties: Column, keys: list[str], longest: int) -> Column:
    """The entries of a map whose key is allowed and whose text is not null and not too long."""
    return F.map_filter(properties, lambda k, v: k.isin(*keys) & v.isNotNull() & (F.length(v) <= longest))


def safe_name(text: Column, fallback: str = "file") -> Column:
    """A text as a name: other characters than letters, digits, dots, underscores and hyphens become underscores, none of
    which stay at its ends; what is left of nothing is ``fallback``."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9._-]", "_"), "^_+|_+$", "")
    return F.when(name == "", fallback).otherwise(name)
