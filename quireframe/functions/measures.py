"""Geometry, units, colours, formulas and schedules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per unit.
METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "in": 0.0254, "ft": 0.3048}


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def area(points: Column) -> Column:
    """Shoelace area of a polygon, an array of x and y."""
    cross = F.zip_with(points, _next(points), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def perimeter(points: Column) -> Column:
    sides = F.zip_with(points, _next(points), lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    return F.aggregate(sides, F.lit(0.0), lambda s, v: s + v)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of an sRGB colour with channels 0 to 255."""
    one = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, 2.4))
    return one(r) * 0.2126 + one(g) * 0.7152 + one(b) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances, 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def catch_up(next_at: Column, interval: Column, now: Column, grace: int = 3_600_000) -> Column:
    """When a schedule runs next: on time or up to the grace late as planned, beyond that the last missed moment."""
    late = now - next_at
    return F.when(late > grace, next_at + F.floor(late / interval) * interval).otherwise(next_at)


def formula(text: str) -> Column:
    """Compile ``+ - * /``, parentheses, unary signs, numbers and column names into a column, for Catalyst to fold and
    prune. A zero divisor gives null. Anything else is refused."""
    parts = re.findall(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(.))", text.strip())
    at = 0

    def take(kinds: str) -> str | None:
        nonlocal at
        if at < len(parts) and parts[at][2] and parts[at][2] in kinds:
            at += 1
            return parts[at - 1][2]
        return None

    def factor() -> Column:
        nonlocal at
        if sign := take("+-"):
            return -factor() if sign == "-" else factor()
        if take("("):
            inner = total()
            if not take(")"):
                raise ValueError("missing )")
            return inner
        if at >= len(parts) or parts[at][2]:
            raise ValueError(f"unexpected {parts[at][2] if at < len(parts) else 'end'}")
        number, name, _ = parts[at]
        at += 1
        return F.lit(float(number)) if number else F.col(name).cast("double")

    def term() -> Column:
        left = factor()
        while op := take("*/"):
            right = factor()
            left = left * right if op == "*" else left / F.nullif(right, F.lit(0.0))
        return left

    def total() -> Column:
        left = term()
        while op := take("+-"):
            right = term()
            left = left + right if op == "+" else left - right
        return left

    out = total()
    if at != len(parts):
        raise ValueError(f"unexpected {parts[at]}")
    return out


def cron_values(field: str, low: int, high: int) -> list[int]:
    """The values of a cron field: ``*``, numbers, ranges, and steps over a range or from a number on, parted by commas."""
    values: set[int] = set()
    for item in ["*/1"] if field == "*" else field.split(","):
        if m := re.fullmatch(r"(\*|\d+)(?:-(\d+))?/(\d+)", item):
            a, b, step = low if m[1] == "*" else int(m[1]), int(m[2] or high), int(m[3])
        elif m := re.fullmatch(r"(\d+)(?:-(\d+))?", item):
            a, b, step = int(m[1]), int(m[2] or m[1]), 1
        else:
            raise ValueError(f"bad field {item}")
        if step < 1 or a < low or b > high or a > b:
            raise ValueError(f"out of range: {item}")
        values |= set(range(a, b + 1, step))
    return sorted(values)


def cron_matches(spec: str, ts: Column) -> Column:
    """Whether a moment matches five cron fields: minute, hour, day, month, weekday (Sunday is 0 or 7)."""
    fields = spec.split()
    if len(fields) != 5:
        raise ValueError("five fields are needed")
    parts = [F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1]
    out = F.lit(True)
    for field, part, bounds in zip(fields, parts, [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)], strict=True):
        values = cron_values(field, *bounds)
        out = out & part.isin(*sorted({v % 7 for v in values} if bounds == (0, 7) else values))
    return out
