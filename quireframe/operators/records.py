"""Record operators: filtering, keyed diffs, roll-ups, ordered neighbours and page sequences."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.session import ship_code


def matching(rows: DataFrame, needle: str, columns: list[str], **equal: str) -> DataFrame:
    """Rows with the given values whose columns, joined by spaces, hold ``needle`` in any case. Null is no match."""
    has = F.lower(F.concat_ws(" ", *columns)).contains(needle.lower())
    return rows.filter(reduce(lambda a, kv: a & (F.col(kv[0]) == kv[1]), equal.items(), has))


def sorted_as_text(rows: DataFrame, by: str, key: str, descending: bool = False) -> DataFrame:
    """Rows ordered by a column's text, so that 10 comes before 2, then by key; both the other way when descending."""
    cols = [F.col(by).cast("string"), F.col(key)]
    return rows.orderBy(*[c.desc() if descending else c.asc() for c in cols])


def keyed_diff(left: DataFrame, right: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Full outer join of two snapshots: key and status added, deleted, changed or unchanged. A null key is a key."""
    json = lambda: F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"})
    a = left.select(F.col(key).alias("_a"), json().alias("_pa"), F.lit(True).alias("_la"))
    b = right.select(F.col(key).alias("_b"), json().alias("_pb"), F.lit(True).alias("_lb"))
    status = F.when(F.col("_la").isNull(), "added").when(F.col("_lb").isNull(), "deleted").when(F.col("_pa") == F.col("_pb"), "unchanged").otherwise("changed")
    return a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column and in all, in one pass: facet, value, n."""
    sets = rows.groupingSets([[F.col(c)] for c in columns] + [[]], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns])
    facet = reduce(lambda e, c: F.when(F.col(f"_{c}") == 0, c).otherwise(e), columns, F.lit("all"))
    value = F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit(""))
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


def digest_sum(member: Column) -> Column:
    """A digest of a group's members that adds up, so that no task gathers them: the sum of the first 60 bits of each
    one's SHA-256, as text. Their order does not matter, repeats do."""
    return F.sum(F.conv(F.substring(F.sha2(member.cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def legend(rows: DataFrame, keys: list[str], value: str, member: str) -> DataFrame:
    """Groups by ``keys`` with count, sum (to six places) and ``digest_sum`` of the members; null is a group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), digest_sum(F.col(member)).alias("provenance"))


def legend_members(rows: DataFrame, keys: list[str], value: str, member: str) -> DataFrame:
    """A row for each member with its place (from 1) in its group, in order of the members' text, then of their values. Groups are
    few, so each is parted by how its members begin: a row is placed in its part, after all that the parts before it hold."""
    each = rows.withColumn("_begins", F.substring(F.col(member).cast("string"), 1, 4))
    parts = each.groupBy(*keys, "_begins").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_begins")) - F.col("_n")
    held = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_begins").alias("_part"), before.alias("_before"))
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "_begins").orderBy(F.col(member).cast("string"), value)))
    same = F.col("_begins").eqNullSafe(F.col("_part"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(held, same).select(*rows.columns, (F.col("place") + F.col("_before")).cast("int").alias("place"))


def status_counts(rows: DataFrame, status: str, domain: list[str]) -> DataFrame:
    """Counts of each status of a fixed domain, zeros included, and the overall verdict: fail, or review-required where
    there is a warning or a check that was not made, or pass."""
    counts = rows.agg(*[F.count_if(F.col(status) == s).alias(s.replace("-", "_")) for s in domain])
    overall = F.when(F.col("fail") > 0, "fail").when((F.col("warning") > 0) | (F.col("not_checked") > 0), "review-required").otherwise("pass")
    return counts.withColumn("overall", overall)


def section_ends(starts: DataFrame, of: str, start: str, last: Column) -> DataFrame:
    """Each section's end: one before the next start of the same document, the last page for the last. ``valid`` tells
    whether the document's starts begin at 1, rise and lie within its pages."""
    w, whole = Window.partitionBy(of).orderBy(start), Window.partitionBy(of)
    here, before = F.col(start), F.lag(start).over(w)
    each = starts.withColumns({"end": F.coalesce(F.lead(start).over(w) - 1, last), "_ok": F.coalesce((here > F.coalesce(before, F.lit(0))) & (before.isNotNull() | (here == 1)) & (here <= last), F.lit(False))})
    return each.withColumn("valid", F.bool_and("_ok").over(whole)).drop("_ok")


def runs(rows: DataFrame, of: str, order: str, kind: str) -> DataFrame:
    """Consecutive rows of a kind as one: of, run (from 1), kind, begins, n."""
    w = Window.partitionBy(of).orderBy(order)
    new = F.coalesce(F.col(kind) != F.lag(kind).over(w), F.lit(True)).cast("int")
    each = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return each.groupBy(of, "run").agg(F.first(kind).alias(kind), F.min(order).alias("begins"), F.count("*").alias("n"))


def numbered(rows: DataFrame, of: str, order: str, prefix: str, start: int, width: int, suffix: str = "") -> DataFrame:
    """A label per row in order: prefix, number and suffix. Numbers are padded with zeros and never cut."""
    n = (F.row_number().over(Window.partitionBy(of).orderBy(order)) + F.lit(start - 1)).cast("string")
    return rows.withColumn("label", F.concat(F.lit(prefix), F.lpad(n, F.greatest(F.length(n), F.lit(width)), F.lit("0")), F.lit(suffix)))


#: Roman numerals from the largest.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column) -> Column:
    """A positive number in roman numerals."""
    rest, out = n.cast("long"), F.lit("")
    for value, numeral in ROMAN:
        out, rest = F.concat(out, F.repeat(F.lit(numeral), F.floor(rest / value).cast("int"))), rest % value
    return out


def letters(n: Column) -> Column:
    """A positive number in letters: A to Z, then AA to ZZ, AAA and so on."""
    at = n.cast("long") - 1
    return F.repeat(F.char(F.lit(65) + at % 26), (F.floor(at / 26) + 1).cast("int"))


def styled(n: Column, style: Column) -> Column:
    """A number in the style of page labels: D decimal, R and r roman, A and a letters; any other style has no number."""
    return F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", letters(n)).when(style == "a", F.lower(letters(n))).otherwise("")


def page_labels(pages: DataFrame, ranges: DataFrame, of: str = "doc_id") -> DataFrame:
    """Each page's label from the range (start, style, prefix, first) with the greatest start at or below it: a fill forward
    over both in order. Pages before the first range have none and are left out."""
    kinds = {"style": "string", "prefix": "string", "first": "int"}
    both = pages.select(of, "page", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.lit(1).alias("k"))
    both = both.unionByName(ranges.select(of, F.col("start").alias("page"), *kinds, F.lit(0).alias("k")))
    w = Window.partitionBy(of).orderBy("page", "k").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("r", F.last(F.when(F.col("k") == 0, F.struct("page", *kinds)), ignorenulls=True).over(w)).filter("k = 1 AND r IS NOT NULL")
    number = F.col("r.first") + F.col("page") - F.col("r.page")
    return got.select(of, "page", F.concat(F.coalesce("r.prefix", F.lit("")), F.coalesce(styled(number, F.col("r.style")), F.lit(""))).alias("label"))


def interleave(a: DataFrame, b: DataFrame, of: str = "doc_id") -> DataFrame:
    """Pages of two sources by turns, tails kept: of, position (from 1), source, page."""
    both = a.select(of, "page", F.lit("a").alias("source")).unionByName(b.select(of, "page", F.lit("b").alias("source")))
    place = Window.partitionBy(of, "source").orderBy("page")
    return both.withColumn("_n", F.row_number().over(place)).withColumn("position", F.row_number().over(Window.partitionBy(of).orderBy("_n", "source"))).drop("_n")


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """The output part (from 1) that each page goes to when every ``n`` pages start a new one."""
    return pages.withColumn("part", F.floor((F.col("page") - 1) / n).cast("int") + 1)


def imposed(pages: DataFrame, across: int, down: int) -> DataFrame:
    """Sheet, row and column of each page in row-major order."""
    at = F.col("page") - 1
    per = across * down
    return pages.withColumns({"sheet": F.floor(at / per).cast("int"), "row": F.floor((at % per) / across).cast("int"), "col": ((at % per) % across).cast("int")})


def duplicated(pages: DataFrame, chosen: Column) -> DataFrame:
    """Chosen pages twice, in place: copy is 1 or 2."""
    return pages.withColumn("copy", F.explode(F.when(chosen, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))


def overlapping(zones: DataFrame, of: str) -> DataFrame:
    """Pairs of zones (id, x, y, w, h) of one page that overlap by more than an edge: of, left_id and right_id, the lesser first.

    A zone has a level, the power of two that its longer side does not pass, and lies in four cells of that size at most. The
    zones of a page that are as small or smaller look it up there, so that what is joined are zones that are near each
    other, however many a page has; a pair is told by the cell that holds the upper left corner of what both cover. A
    zone that lacks a number meets none."""
    z = zones.select(F.col(of).alias("of"), "id", *[F.col(c).cast("double").alias(c) for c in "xywh"]).filter("x IS NOT NULL AND y IS NOT NULL AND w >= 0 AND h >= 0")
    z = z.withColumn("level", F.ceil(F.log2(F.greatest("w", "h", F.lit(2.0**-20)))).cast("int"))
    cells = lambda low, size: F.explode(F.sequence(F.floor(low / F.pow(F.lit(2.0), F.col("at"))), F.floor((low + size) / F.pow(F.lit(2.0), F.col("at")))))
    laid = lambda t: t.withColumn("i", cells(F.col("x"), F.col("w"))).withColumn("j", cells(F.col("y"), F.col("h")))
    levels = z.groupBy("of").agg(F.collect_set("level").alias("levels"))
    looking = z.join(levels, "of").withColumn("at", F.explode(F.filter("levels", lambda v: v >= F.col("level")))).drop("levels")
    a, b = laid(looking).alias("a"), laid(z.withColumn("at", F.col("level"))).alias("b")
    c = lambda t, k: F.col(f"{t}.{k}")
    meet = (c("a", "x") < c("b", "x") + c("b", "w")) & (c("b", "x") < c("a", "x") + c("a", "w")) & (c("a", "y") < c("b", "y") + c("b", "h")) & (c("b", "y") < c("a", "y") + c("a", "h"))
    once = (c("a", "level") < c("b", "level")) & (c("a", "id") != c("b", "id")) | (c("a", "level") == c("b", "level")) & (c("a", "id") < c("b", "id"))
    size = F.pow(F.lit(2.0), c("a", "at"))
    here = (F.floor(F.greatest(c("a", "x"), c("b", "x")) / size) == c("a", "i")) & (F.floor(F.greatest(c("a", "y"), c("b", "y")) / size) == c("a", "j"))
    same = [c("a", k) == c("b", k) for k in ("of", "at", "i", "j")]
    return a.join(b, reduce(Column.__and__, [*same, meet, once, here])).select(c("a", "of").alias(of), F.least(c("a", "id"), c("b", "id")).alias("left_id"), F.greatest(c("a", "id"), c("b", "id")).alias("right_id"))


def tree_parents(rows: DataFrame, of: str, order: str, depth: str) -> DataFrame:
    """Parent of each row of a depth-coded tree: the nearest earlier row of smaller depth, whatever the depths are. Of rows
    at one place none is before the other. A null depth or place has no parent and is none.

    Rows are dealt by tree, sorted and read one by one; the path to the current row is all that is held.
    """
    ship_code(rows.sparkSession)
    kind, names = rows.schema, rows.columns
    at_of, at_order, at_depth = (names.index(c) for c in (of, order, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, path, waiting = object(), [], []
        for b in batches:
            parents = []
            for t, place, d in zip(*(b.column(i).to_pylist() for i in (at_of, at_order, at_depth)), strict=True):
                if t != tree:
                    tree, path, waiting = t, [], []
                if place is None or d is None:
                    parents.append(None)
                    continue
                if waiting and waiting[0][1] != place:
                    least = min(waiting)
                    while path and path[-1][0] >= least[0]:
                        path.pop()
                    # Of rows at one place the place is all that a parent is told by, so the least depth stands for all.
                    path.append(least)
                    waiting = []
                k = bisect_left(path, d, key=lambda x: x[0])
                parents.append(path[k - 1][1] if k else None)
                waiting.append((d, place))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parents, b.schema.field(at_order).type)], [*b.schema.names, "parent"])

    out = T.StructType([*kind.fields, T.StructField("parent", kind[order].dataType)])
    return rows.repartition(of).sortWithinPartitions(of, order).mapInArrow(run, out)


def chained_log(rows: DataFrame, of: str, order: str, content: Column) -> DataFrame:
    """``rows`` as logs, one for each ``of``, in order: sequence (from 1), previous (the digest of the record before, GENESIS
    for the first) and digest, the SHA-256 of previous, a bar and ``content``. Logs are dealt out, sorted and read record
    by record; all that is held is the last digest."""
    ship_code(rows.sparkSession)
    names = [f.name for f in rows.schema]
    at_of, made = names.index(of), [T.StructField("sequence", T.LongType()), T.StructField("previous", T.StringType()), T.StructField("digest", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, n, last = object(), 0, ""
        for b in batches:
            sequence, previous, digest = [], [], []
            for k, text in zip(b.column(at_of).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if k != log:
                    log, n, last = k, 0, "GENESIS"
                n += 1
                sequence.append(n)
                previous.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                digest.append(last)
            columns = [*b.columns[:-1], pa.array(sequence, pa.int64()), pa.array(previous, pa.string()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(f.name for f in made)])

    dealt = rows.withColumn("_content", content).repartition(of).sortWithinPartitions(of, order)
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, *made]))


def verified_chain(log: DataFrame, sequence: str, previous: str, digest: str, of: str, content: Column) -> DataFrame:
    """Per log: whether it is intact. Each record's sequence is one more than that of the record before, from 1; its
    previous digest is that record's (GENESIS for the first), and its digest is the SHA-256 of ``content``. A null breaks
    the log, as does a sequence that repeats."""
    w = Window.partitionBy(of).orderBy(sequence)
    ok = F.col(previous).eqNullSafe(F.coalesce(F.lag(digest).over(w), F.lit("GENESIS"))) & F.col(digest).eqNullSafe(F.sha2(content, 256)) & F.col(digest).isNotNull()
    ok = ok & F.col(sequence).eqNullSafe(F.coalesce(F.lag(sequence).over(w), F.lit(0)) + 1)
    return log.withColumn("_ok", ok).groupBy(of).agg(F.bool_and("_ok").alias("intact"), F.count("*").alias("n"))


def retained(pages: DataFrame, gone: Column, of: str) -> DataFrame:
    """The pages of each document but those that ``gone`` holds for. A document that would keep none is refused: it keeps
    all, with kept false. A null condition keeps the page."""
    each = pages.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    each = each.withColumn("kept", ~F.bool_and("_gone").over(Window.partitionBy(of)))
    return each.filter(~F.col("_gone") | ~F.col("kept")).drop("_gone")
