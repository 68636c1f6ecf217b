"""Review operators: paired pages, forms, rules, job reports, chains and ordered insertions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quireframe.functions.bounded import bounded_test_of
from quireframe.operators.records import digest_sum
from quireframe.session import ship_code


def paired_pages(left: DataFrame, right: DataFrame, of: str) -> DataFrame:
    """Pages (of, page, text) of two sources side by side, whichever has more: presence on each side and status
    unpaired-page, unchanged or changed."""
    a = left.select(F.col(of).alias("_a"), F.col("page").alias("_pa"), F.col("text").alias("_ta"), F.lit(True).alias("_la"))
    b = right.select(F.col(of).alias("_b"), F.col("page").alias("_pb"), F.col("text").alias("_tb"), F.lit(True).alias("_lb"))
    both = a.join(b, (F.col("_a") == F.col("_b")) & (F.col("_pa") == F.col("_pb")), "full_outer")
    here = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(~(here("_la") & here("_lb")), "unpaired-page").when(F.col("_ta").eqNullSafe(F.col("_tb")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("_a", "_b").alias(of), F.coalesce("_pa", "_pb").alias("page"), here("_la").alias("left_present"), here("_lb").alias("right_present"), status.alias("status"))


def pair_totals(pages: DataFrame, of: str) -> DataFrame:
    """Totals of ``paired_pages`` per pair."""
    return pages.groupBy(of).agg(F.count("*").alias("pages"), F.count_if("left_present").alias("left_pages"), F.count_if("right_present").alias("right_pages"), F.count_if(F.col("status") == "changed").alias("changed"))


def calculated(operands: DataFrame, of: str, value: str) -> DataFrame:
    """Sum, average, least, greatest and product of each form's operands; null unless every operand is a finite number."""
    v = F.col(value)
    whole = F.bool_and(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    made = {"total": F.sum(v), "average": F.avg(v), "least": F.min(v), "greatest": F.max(v)}
    return operands.groupBy(of).agg(*[F.round(F.when(whole, x), 6).alias(k) for k, x in made.items()], F.when(whole, F.product(v)).alias("product"))


CALCULATION = r"^(sum|average|min|max|product)\(([A-Za-z0-9._-]+(?:,[A-Za-z0-9._-]+)*)\)$"


def calculated_fields(fields: DataFrame, of: str) -> DataFrame:
    """Fields (of, at, name, value, calculation) of forms with the value that calculations give: sum, average, min, max or
    product of named fields. They are taken in order of ``at``, so that later ones see what earlier ones gave; one that lacks
    a finite operand leaves its field as it is. Of fields with one name the first is meant. A form's fields are one group,
    which a form keeps small."""

    ship_code(fields.sparkSession)
    out = fields.select(of, "at", "name", F.col("value").cast("double").alias("value"), "calculation")
    functions = {"sum": sum, "average": lambda y: sum(y) / len(y), "min": min, "max": max, "product": math.prod}

    def form(rows: list[dict]) -> list[dict]:
        first = {r["name"]: r for r in reversed(rows)}
        for r in rows:
            m = re.fullmatch(CALCULATION, r["calculation"] or "")
            x = [first[n]["value"] if n in first else None for n in m[2].split(",")] if m else []
            if x and all(v is not None and math.isfinite(v) for v in x):
                r["value"] = float(functions[m[1]](x))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in groupby(rows, key=lambda r: r[of]):
            done += form(list(group))
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_pylist(done, kind)
                done = []
        yield pa.RecordBatch.from_pylist(done, kind)

    kind = to_arrow_schema(out.schema)
    return out.repartition(of).sortWithinPartitions(of, "at", "name").mapInArrow(run, out.schema)


def bound_measurements(measurements: DataFrame, calibrations: DataFrame, binding: list[str]) -> DataFrame:
    """Measurements (id, calibration, points, ``binding``) with the scale of their calibration (id, scale, ``binding``) and
    status: bound, uncalibrated (they name none), missing (no such calibration) or other-source (a field of the binding
    differs). Only bound ones have a scale."""
    c = calibrations.select(F.col("id").alias("_c"), "scale", F.struct(*binding).alias("_cb"))
    both = measurements.withColumn("_mb", F.struct(*binding)).join(c, F.col("calibration") == F.col("_c"), "left")
    status = F.when(F.col("calibration").isNull(), "uncalibrated").when(F.col("_c").isNull(), "missing").when(F.col("_mb").eqNullSafe(F.col("_cb")), "bound").otherwise("other-source")
    return both.withColumn("status", status).withColumn("scale", F.when(F.col("status") == "bound", F.col("scale"))).drop("_c", "_cb", "_mb")


def closure(capabilities: DataFrame, coverage: DataFrame, proofs: DataFrame, key: str = "id") -> DataFrame:
    """Every identifier of three catalogs with status: proven (known, covered and proven), covered, bare, or stray: covered or
    proven but not known."""
    parts = [d.select(F.col(key)).distinct().withColumn(f"_{i}", F.lit(True)) for i, d in enumerate((capabilities, coverage, proofs))]
    each = parts[0].join(parts[1], key, "full_outer").join(parts[2], key, "full_outer")
    here = lambda i: F.coalesce(F.col(f"_{i}"), F.lit(False))
    return each.select(key, F.when(~here(0), "stray").when(here(1) & here(2), "proven").when(here(1), "covered").otherwise("bare").alias("status"))


def form_errors(values: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """One row (key, field, code) per rule that a value breaks. ``values`` has a key, field and value (text); ``rules``, a row for
    each field, has type, required, pattern (a bounded expression of 120 characters at most), low and high. A value that is
    required breaks ``required`` if it is missing; one that is there breaks ``pattern`` if no part of it matches; a finite number
    in a field of that type breaks ``min`` below low and ``max`` above high. A rule that is null or empty is not broken, and a
    field without rules breaks none."""
    ship_code(values.sparkSession)
    both = values.select(key, "field", "value").join(rules.select("field", "type", "required", "pattern", "low", "high"), "field")
    v = F.col("value")
    asked = F.when((v != "") & (F.col("pattern") != ""), v)
    number = F.when(F.col("type") == "number", v.try_cast("double"))
    number = F.when(F.abs(number) < float("inf"), number)
    tested = both.withColumn("_matches", bounded_test_of(asked, F.nullif("pattern", F.lit("")), longest=120)).withColumn("_number", number)
    codes = F.array_compact(F.array(F.when(F.col("required") & missing(v), "required"), F.when(~F.col("_matches"), "pattern"), F.when(F.col("_number") < F.col("low"), "min"), F.when(F.col("_number") > F.col("high"), "max")))
    return tested.select(key, "field", F.explode(codes).alias("code"))


def missing(value: Column) -> Column:
    """Whether a required value is not there: null, an empty text or false."""
    return value.isNull() | value.cast("string").isin("", "false")


def takeoff(rows: DataFrame, chosen: DataFrame, key: str, unit: str, value: str) -> DataFrame:
    """Per unit of the chosen rows: sum (to six places), count and a digest of the keys that adds up."""
    each = rows.join(chosen.select(key).distinct(), key, "left_semi")
    return each.groupBy(unit).agg(F.round(F.sum(value), 6).alias("total"), F.count("*").alias("n"), digest_sum(F.col(key)).alias("members"))


def takeoff_checks(rows: DataFrame, chosen: DataFrame, key: str, source: str) -> DataFrame:
    """What a takeoff asks of its choice, in one row: how many keys are chosen, how many of them repeat or are unknown, from
    how many sources they are, and whether all is well: one source, none repeated, none unknown."""
    each = chosen.groupBy(key).agg(F.count("*").alias("_n")).join(rows.select(key, source, F.lit(True).alias("_here")), key, "left")
    out = each.agg(F.count("*").alias("chosen"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_here").isNull()).alias("unknown"), F.count_distinct(source).alias("sources"))
    return out.withColumn("valid", (F.col("repeated") == 0) & (F.col("unknown") == 0) & (F.col("sources") == 1))


def processing_report(jobs: DataFrame, of: str, status: str, completed: str, failed: str) -> DataFrame:
    """Jobs by outcome and the share that completed; 0 of none."""
    each = jobs.groupBy(of).agg(F.count("*").alias("jobs"), F.count_if(F.col(status) == completed).alias("completed"), F.count_if(F.col(status) == failed).alias("failed"))
    return each.withColumn("success_rate", F.round(F.coalesce(F.try_divide("completed", "jobs"), F.lit(0.0)), 6))


def column_alignment(words: DataFrame, table: str, column: str, x: str, within: float = 0.04) -> DataFrame:
    """Each column's anchor, the mean x of its words, and the share of words close to it."""
    anchors = words.groupBy(table, column).agg(F.round(F.avg(x), 6).alias("anchor"))
    near = F.round(F.abs(F.col(x) - F.col("anchor")), 6) <= within
    return words.join(anchors, [table, column]).groupBy(table, column, "anchor").agg(F.round(F.avg(near.cast("int")), 6).alias("score"))


def nearest_anchor(x: Column, anchors: list[float]) -> Column:
    """Place (from 0) of the anchor nearest to ``x``; the first of equally near ones."""
    return F.array_min(F.array(*[F.struct(F.abs(x - a).alias("d"), F.lit(i).alias("i")) for i, a in enumerate(anchors)]))["i"]


def image_resolution(x: Column, y: Column, least: int = 150) -> Column:
    """unknown without both densities, invalid where one is not positive, low below ``least``, else fine."""
    return F.when(x.isNull() | y.isNull(), "unknown").when(F.least(x, y) <= 0, "invalid").when(F.least(x, y) < least, "low").otherwise("fine")


def heading_violations(rows: DataFrame, of: str, order: str, level: str) -> DataFrame:
    """Headings out of sequence: a first one that is not of level 1, or a level more than one below the one before."""
    before = F.lag(level).over(Window.partitionBy(of).orderBy(order))
    code = F.when(before.isNull() & (F.col(level) != 1), "first-not-top").when(F.col(level) > before + 1, "level-skipped")
    return rows.select(of, order, code.alias("code")).filter("code IS NOT NULL")


def ascending(rows: DataFrame, of: str, order: str, value: str) -> DataFrame:
    """Whether each group's values rise strictly; a null does not."""
    w = Window.partitionBy(of).orderBy(order)
    rises = F.when(F.row_number().over(w) == 1, F.col(value).isNotNull()).otherwise(F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False)))
    return rows.select(of, rises.alias("_r")).groupBy(of).agg(F.bool_and("_r").alias("ascending"))


def capped(rows: DataFrame, of: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group with the exact total and whether more were cut off."""
    w = Window.partitionBy(of)
    each = rows.withColumns({"ordinal": F.row_number().over(w.orderBy(order)), "total": F.count("*").over(w)})
    return each.filter(F.col("ordinal") <= most).withColumn("truncated", F.col("total") > most)


def submissions(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Each submission of a key against the first: new, same or conflict."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.first(payload).over(w)
    status = F.when(F.row_number().over(w) == 1, "new").when(F.col(payload).eqNullSafe(first), "same").otherwise("conflict")
    return rows.select(key, order, status.alias("status"))


def transitions(rows: DataFrame, of: str, order: str, state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Each change of state and whether it is allowed; a group's first state is no change."""
    before = F.lag(state).over(Window.partitionBy(of).orderBy(order))
    ok = reduce(lambda a, e: a | ((F.col("before") == e[0]) & (F.col(state) == e[1])), allowed, F.lit(False))
    return rows.select(of, order, before.alias("before"), state).filter("before IS NOT NULL").withColumn("allowed", ok)


def _placed(parts: DataFrame, of: str) -> DataFrame:
    """Pages with _k (array of sort keys) in their final position, from 1."""
    return parts.withColumn("position", F.row_number().over(Window.partitionBy(of).orderBy("_k"))).drop("_k")


def inserted(a: DataFrame, b: DataFrame, after: int, of: str) -> DataFrame:
    """All pages of ``b`` after page ``after`` of ``a``: of, source, page, position."""
    one = a.select(of, "page", F.lit("a").alias("source"), F.array(F.when(F.col("page") <= after, 0).otherwise(2), F.col("page")).alias("_k"))
    return _placed(one.unionByName(b.select(of, "page", F.lit("b").alias("source"), F.array(F.lit(1), F.col("page")).alias("_k"))), of)


def replaced(a: DataFrame, b: DataFrame, first: int, last: int, of: str) -> DataFrame:
    """``a`` with its pages from ``first`` to ``last`` replaced by all of ``b``."""
    return inserted(a.filter(~F.col("page").between(first, last)), b, first - 1, of)


def extracted(pages: DataFrame, order: list[int], of: str) -> DataFrame:
    """The pages in the order given, repeats allowed: page and position; pages that a document lacks are skipped."""
    places = F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i + 1).alias("position")) for i, p in enumerate(order)]), lambda s: s["p"] == F.col("page"))
    return pages.select(of, "page", F.explode(places).alias("s")).select(of, "page", F.col("s.position").alias("position"))


def reverse(pages: DataFrame, of: str) -> DataFrame:
    """The pages of each document from last to first."""
    return _placed(pages.withColumn("_k", F.array(-F.col("page"))), of)


def cover(suspects: DataFrame, decisions: DataFrame, key: str, decision: str) -> DataFrame:
    """Whether decisions cover suspects exactly: counts of decided, missing and unexpected keys."""
    s, d = suspects.select(F.col(key).alias("_s")), decisions.select(F.col(key).alias("_d"), F.col(decision).alias("_w"))
    both = s.join(d, F.col("_s") == F.col("_d"), "full_outer")
    missing, odd = F.col("_d").isNull(), F.col("_s").isNull()
    counts = both.agg(F.count_if(~missing & ~odd).alias("decided"), F.count_if(missing).alias("missing"), F.count_if(odd).alias("unexpected"))
    return counts.withColumn("exact", (F.col("missing") == 0) & (F.col("unexpected") == 0))
