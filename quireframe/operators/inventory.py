"""Selections, counts and orders over records: what lists, inventories and reports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected(rows: DataFrame, **equal) -> DataFrame:
    """Rows with the given values; a value that is None asks for nothing. Null is no match."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), [(k, v) for k, v in equal.items() if v is not None], rows)


def lookup(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted key once with found, whether ``rows`` has it, and the row's columns (null where it has not)."""
    w = wanted.select(F.col(key).alias("_w")).distinct()
    there = rows.withColumn("_here", F.lit(True))
    both = w.join(there, F.col("_w") == F.col(key), "left")
    return both.select(F.col("_w").alias(key), F.coalesce("_here", F.lit(False)).alias("found"), *[c for c in rows.columns if c != key])


def chosen(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``."""
    return rows.join(ids.select(key), key, "left_semi")


def page_count_condition(condition: str, count: Column) -> Column:
    """``pageCount OP number`` with ==, !=, <=, >=, < or >: a boolean column. A condition that does not speak of pageCount
    matches nothing; one that does in another form is refused. A null count is compared as not equal to anything."""
    import re

    m = re.fullmatch(r"\s*pageCount\s*(==|!=|<=|>=|<|>)\s*(\d+)\s*", condition)
    if not m:
        if "pageCount" in condition:
            raise ValueError(f"bad condition {condition}")
        return F.lit(False)
    n = F.lit(int(m[2]))
    out = {"==": count == n, "!=": ~count.eqNullSafe(n), "<=": count <= n, ">=": count >= n, "<": count < n, ">": count > n}[m[1]]
    return F.coalesce(out, F.lit(False))


def condition_holds(actual: Column, operator: str, expected) -> Column:
    """A predicate of eq, gte or lte; null is false, as is any other operator."""
    ops = {"eq": actual == F.lit(expected), "gte": actual >= F.lit(expected), "lte": actual <= F.lit(expected)}
    return F.coalesce(ops[operator], F.lit(False)) if operator in ops else F.lit(False)


def said_yes(value: Column) -> Column:
    """Whether a value is yes, in any case and between any blanks; null is not."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "yes", F.lit(False))


def said_no(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "no", F.lit(False))


def unembedded(fonts: DataFrame, embedded: str = "embedded") -> DataFrame:
    """Fonts that are not reported as embedded; unknown is not."""
    return fonts.filter(~said_yes(F.col(embedded)))


def font_evidence(fonts: DataFrame, of: str, embedded: str = "embedded", unicode: str = "unicode") -> DataFrame:
    """Per document: fonts, and how many are (not, not known to be) embedded and mapped to Unicode."""
    out = [F.count("*").alias("fonts")]
    for name, c in (("embedded", embedded), ("unicode", unicode)):
        out += [F.count_if(said_yes(F.col(c))).alias(name), F.count_if(said_no(F.col(c))).alias(f"not_{name}"), F.count_if(~said_yes(F.col(c)) & ~said_no(F.col(c))).alias(f"unknown_{name}")]
    return fonts.groupBy(of).agg(*out)


def empty_pages(pages: DataFrame) -> DataFrame:
    """Pages without text: null, or white space only."""
    return pages.filter(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))


def named_like(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows of which a column holds ``needle`` in any case."""
    has = [F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False)) for c in columns]
    return rows.filter(reduce(lambda a, b: a | b, has))


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules that are enabled and whose next moment is not after ``now``."""
    return schedules.filter((F.col("status") == "enabled") & (F.col("next_at") <= now))


def zones_to_read(zones: DataFrame, pages: DataFrame, of: str) -> DataFrame:
    """Zones of the pages given whose type is neither image nor exclude."""
    return zones.filter(~F.col("type").isin("image", "exclude")).join(pages.select(of, "page").distinct(), [of, "page"], "left_semi")


def capable(printers: DataFrame, options: Column, wanted: list[str]) -> DataFrame:
    """Printers that have all options wanted."""
    return printers.filter(reduce(lambda a, b: a & b, [F.array_contains(options, w) for w in wanted], F.lit(True)))


def column_formula(rows: DataFrame, of: str, value: str, formula: str) -> DataFrame:
    """sum, avg (mean), count, min or max of each group's values; null where one is no finite number."""
    if formula not in ("sum", "avg", "mean", "count", "min", "max"):
        raise ValueError(f"unknown formula {formula}")
    v = F.col(value).cast("double")
    ok = F.bool_and(F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    made = {"sum": F.sum(v), "avg": F.avg(v), "mean": F.avg(v), "count": F.count("*").cast("double"), "min": F.min(v), "max": F.max(v)}[formula]
    return rows.groupBy(of).agg(F.when(ok, F.round(made, 6)).alias("result"))


def totals(rows: DataFrame, of: str, text: str) -> DataFrame:
    """Per group: rows and the sum of a quantity given as text; what is no number counts as 0."""
    n = F.coalesce(F.expr(f"try_cast(`{text}` AS double)"), F.lit(0.0))
    finite = F.when(F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(n)
    return rows.groupBy(of).agg(F.count("*").alias("n"), F.round(F.sum(finite), 6).alias("total"))


def distinct_geometries(pages: DataFrame, of: str) -> DataFrame:
    """Per document: pages and how many different sizes they have."""
    return pages.groupBy(of).agg(F.count("*").alias("pages"), F.count_distinct("width", "height").alias("geometries"))


def contrast_totals(samples: DataFrame, of: str) -> DataFrame:
    """Per document: findings, warnings, samples that were not checked, and the pages with a warning."""
    w = F.col("status") == "warning"
    return samples.groupBy(of).agg(F.count("*").alias("findings"), F.count_if(w).alias("warnings"), F.count_if(F.col("status") == "not-checked").alias("not_checked"), F.count_distinct(F.when(w, F.col("page"))).alias("pages_with_warnings"))


def manifest(files: DataFrame, of: str, expected: Column) -> DataFrame:
    """A batch in one row: attempted, ok, failed, pages and bytes of what is ok, and complete: as many as expected were
    attempted and none failed."""
    ok = F.col("error").isNull()
    each = files.groupBy(of).agg(F.count("*").alias("attempted"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("pages"))), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"), F.max(expected).alias("_n"))
    return each.withColumn("complete", (F.col("failed") == 0) & (F.col("attempted") == F.col("_n"))).drop("_n")


def state_counts(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    """How many rows there are, and of each state, zeros included."""
    return rows.agg(F.count("*").alias("all"), *[F.count_if(F.col(state) == s).alias(s.replace("-", "_")) for s in states])


def usage_total(rows: DataFrame, counters: list[str]) -> DataFrame:
    """Per row the sum of its counters; what is missing or negative counts as 0."""
    parts = [F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in counters]
    return rows.withColumn("total", reduce(lambda a, b: a + b, parts))


def extents(rows: DataFrame, of: list[str]) -> DataFrame:
    """The box around all boxes (x, y, width, height) of a group."""
    left, top = F.min("x"), F.min("y")
    return rows.groupBy(*of).agg(F.count("*").alias("n"), left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("width")) - left).alias("width"), (F.max(F.col("y") + F.col("height")) - top).alias("height"))


def residue(objects: DataFrame, of: str, revision: str, key: str) -> DataFrame:
    """Objects of earlier revisions that the newest one has not: of and key, once each."""
    newest = objects.groupBy(of).agg(F.max(revision).alias("_newest"))
    each = objects.join(newest, of)
    latest = each.filter(F.col(revision) == F.col("_newest")).select(of, key)
    return each.filter(F.col(revision) < F.col("_newest")).select(of, key).distinct().join(latest, [of, key], "left_anti")


def level_counts(rows: DataFrame, of: str, level: str, levels: int = 6) -> DataFrame:
    """Per document the number of headings of each level from 1 on, zeros included; other levels count as the nearest one."""
    bounded = F.least(F.greatest(F.coalesce(F.col(level), F.lit(1)), F.lit(1)), F.lit(levels))
    return rows.groupBy(of).agg(F.count("*").alias("headings"), *[F.count_if(bounded == i).alias(f"h{i}") for i in range(1, levels + 1)])


def kinds_in_order(rows: DataFrame, of: str, order: str, kind: str, known: list[str], other: str) -> DataFrame:
    """Per document each kind (any that is not known counts as ``other``) with its number and place among the kinds, by first
    occurrence."""
    k = F.when(F.col(kind).isin(*known), F.col(kind)).otherwise(other)
    each = rows.groupBy(of, k.alias("kind")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy(of).orderBy("_first"))).drop("_first")


def presented(rows: DataFrame, by: str | None, order: str) -> DataFrame:
    """Rows with the group that they are shown under (the text of a column, or all) and their place in it (from 1)."""
    g = F.col(by).cast("string") if by else F.lit("all")
    each = rows.withColumn("group", F.coalesce(g, F.lit("")))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(order)))


def listed(rows: DataFrame, of: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group with the exact total and how many were left out."""
    w = Window.partitionBy(of)
    each = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "total": F.count("*").over(w)})
    return each.filter(F.col("place") <= most).withColumn("omitted", F.greatest(F.col("total") - most, F.lit(0)))


def in_collation(rows: DataFrame, name: str, collation: str = "en") -> DataFrame:
    """Rows in the order of a language: lower before upper case of the same letter, accents after it."""
    return rows.orderBy(F.collate(F.col(name), collation), F.col(name))


def merged(a: DataFrame, b: DataFrame, of: str) -> DataFrame:
    """All pages of ``a`` and then all of ``b``: of, source, page, position (from 1)."""
    both = a.select(of, F.lit("a").alias("source"), "page").unionByName(b.select(of, F.lit("b").alias("source"), "page"))
    return both.withColumn("position", F.row_number().over(Window.partitionBy(of).orderBy("source", "page")))


def arranged(pages: DataFrame, selection: DataFrame, of: str) -> DataFrame:
    """Pages in the order of ``selection`` (of, position, page), and for each document ``valid``: no page is chosen twice,
    and none that is not there."""
    here = pages.select(of, "page", F.lit(True).alias("_here"))
    each = selection.join(here, [of, "page"], "left")
    w = Window.partitionBy(of)
    twice = F.count("*").over(Window.partitionBy(of, "page")) > 1
    each = each.withColumn("_bad", twice | F.col("_here").isNull())
    return each.withColumn("valid", ~F.bool_or("_bad").over(w)).drop("_bad", "_here")


def copied_page(source: DataFrame, target: DataFrame, page: int, after: int, of: str) -> DataFrame:
    """``target`` with page ``page`` of ``source`` after its page ``after``: of, source, page, position (from 1)."""
    t = target.select(of, F.lit("target").alias("source"), "page", F.struct(F.col("page").alias("p"), F.lit(0).alias("k")).alias("_k"))
    s = source.filter(F.col("page") == page).select(of, F.lit("source").alias("source"), "page", F.struct(F.lit(after).alias("p"), F.lit(1).alias("k")).alias("_k"))
    return t.unionByName(s).withColumn("position", F.row_number().over(Window.partitionBy(of).orderBy("_k"))).drop("_k")


def sections_of_pages(pages: DataFrame, sections: DataFrame, of: str) -> DataFrame:
    """Each page with the section (start, end) that it lies in and its place there (from 1): a fill forward over the starts,
    as sections do not overlap. Pages in no section are left out."""
    both = pages.select(of, "page", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(1).alias("_k")).unionByName(sections.select(of, F.col("start").alias("page"), F.col("start").cast("int"), F.col("end").cast("int"), F.lit(0).alias("_k")))
    w = Window.partitionBy(of).orderBy("page", "_k").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_s", F.last(F.when(F.col("_k") == 0, F.struct("start", "end")), ignorenulls=True).over(w)).filter("_k = 1 AND _s.end >= page")
    return got.select(of, "page", F.col("_s.start").alias("start"), (F.col("page") - F.col("_s.start") + 1).alias("place"))


def unique_tags(tags: Column) -> Column:
    """Tags in lower case, once each, in order of first occurrence."""
    return F.array_distinct(F.transform(tags, F.lower))


def conflicts(a: Column, b: Column) -> Column:
    """The values of ``a`` that ``b`` has too, in order and with repeats."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def cover_states(suspects: DataFrame, decisions: DataFrame, key: str, decision: str, states: list[str]) -> DataFrame:
    """Suspects by the state that was decided, and whether decisions cover them exactly: each has one of the states, and
    none is about anything else."""
    s, d = suspects.select(F.col(key).alias("_s")), decisions.select(F.col(key).alias("_d"), F.col(decision).alias("_w"))
    both = s.join(d, F.col("_s") == F.col("_d"), "full_outer")
    counts = both.agg(F.count("_s").alias("suspects"), *[F.count_if(F.col("_s").isNotNull() & (F.col("_w") == x)).alias(x.replace("-", "_")) for x in states], F.count_if(F.col("_s").isNull() | F.col("_d").isNull() | ~F.coalesce(F.col("_w").isin(*states), F.lit(False))).alias("_odd"))
    return counts.withColumn("exact", F.col("_odd") == 0).drop("_odd")
