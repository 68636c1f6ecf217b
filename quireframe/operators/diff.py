"""Token differences of paired pages. A pair is compared where it lies, in Arrow batches, by operations on whole rows of bits and in
memory that grows with its tokens."""

from __future__ import annotations

import math
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.operators.text import spreadsheet_safe
from quireframe.session import ship_code

RUNS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("count", T.IntegerType())]))
_TOKEN = re.compile("[^\\s\x1c-\x1f\x85\ufeff]+|[\x1c-\x1f\x85]+")
REPORT = ("primary_sha256", "secondary_sha256", "kind", "page", "status", "added", "deleted", "unchanged", "changed_pixels", "compared_pixels")


class _Lengths:
    """The lengths of longest common subsequences of what follows places i of ``a`` and j of ``b``.

    A row, all j of one i, is a whole number of a bit for each j, and the next one up comes of it by an addition. Rows are kept
    at intervals of the root of their number; those between are made again when they are asked for, so that memory grows with
    the tokens and not with their product."""

    def __init__(self, a: list, b: list):
        self.a, self.b, self.full = a, b, (1 << len(b)) - 1
        known = set(a)
        self.at: dict = {}
        for p, t in enumerate(reversed(b)):
            if t in known:
                self.at[t] = self.at.get(t, 0) | 1 << p
        self.step = max(1, math.isqrt(len(a)))
        self.kept, row = {0: self.full}, self.full
        for k in range(1, len(a) + 1):
            row = self._above(row, k)
            if k % self.step == 0:
                self.kept[k] = row
        self.base, self.rows = -1, []

    def _above(self, row: int, k: int) -> int:
        if mask := self.at.get(self.a[len(self.a) - k]):
            met = row & mask
            return (row + met | row - met) & self.full
        return row

    def row(self, i: int) -> int:
        """Bit p is off where one token more of ``b``, the p-th from its end, makes what follows i longer."""
        k = len(self.a) - i
        base = k // self.step * self.step
        if base != self.base:
            self.base, self.rows = base, [self.kept[base]]
        while len(self.rows) <= k - base:
            self.rows.append(self._above(self.rows[-1], base + len(self.rows)))
        return self.rows[k - base]

    def length(self, i: int, j: int) -> int:
        left = len(self.b) - j
        return left - (self.row(i) & (1 << left) - 1).bit_count()


def token_runs(before: str, after: str) -> list[tuple[str, str, int]]:
    """The runs that lead from one text's tokens to the other's by a longest common subsequence: (kind, text, count). Equal
    tokens are taken as soon as they meet; where adding and deleting do as well, what is added comes first."""
    left, right = _TOKEN.findall(before), _TOKEN.findall(after)
    same = 0
    while same < min(len(left), len(right)) and left[same] == right[same]:
        same += 1
    a, b = left[same:], right[same:]
    kinds = ["unchanged"] * same
    tokens = left[:same]
    lengths = _Lengths(a, b)
    i = j = 0
    deleted = None  # what is to come once the next of ``a`` is deleted
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            kinds.append("unchanged")
            tokens.append(a[i])
            i, j, deleted = i + 1, j + 1, None
            continue
        if deleted is None:
            here, deleted = lengths.length(i, j), lengths.length(i + 1, j)
            own, below = lengths.row(i), lengths.row(i + 1)
        p = len(b) - j - 1
        added = here - (not own >> p & 1)
        if added >= deleted:
            kinds.append("added")
            tokens.append(b[j])
            here, deleted, j = added, deleted - (not below >> p & 1), j + 1
        else:
            kinds.append("deleted")
            tokens.append(a[i])
            i, deleted = i + 1, None
    kinds += ["added"] * (len(b) - j) + ["deleted"] * (len(a) - i)
    tokens += b[j:] + a[i:]
    runs = []
    for kind, group in groupby(zip(kinds, tokens, strict=True), key=lambda x: x[0]):
        own = [t for _, t in group]
        runs.append((kind, " ".join(own), len(own)))
    return runs


def diff_runs(before: Column, after: Column) -> Column:
    """``token_runs`` of two texts as a column: array of kind (added, deleted, unchanged), text and count. Null is empty."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = [[dict(zip(("kind", "text", "count"), r, strict=True)) for r in token_runs(x or "", y or "")] for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("count", pa.int32())])))

    return F.arrow_udf(run, RUNS)(before, after)


def page_diffs(left: DataFrame, right: DataFrame, of: str) -> DataFrame:
    """Pages (of, page, text) of two sources side by side, whichever has more: presence on each side, runs, and the numbers
    of tokens added, deleted and unchanged. A page that one side lacks is empty there."""
    ship_code(left.sparkSession)
    a = left.select(F.col(of).alias("_a"), F.col("page").alias("_pa"), F.col("text").alias("_ta"), F.lit(True).alias("_la"))
    b = right.select(F.col(of).alias("_b"), F.col("page").alias("_pb"), F.col("text").alias("_tb"), F.lit(True).alias("_lb"))
    both = a.join(b, (F.col("_a") == F.col("_b")) & (F.col("_pa") == F.col("_pb")), "full_outer")
    each = both.select(F.coalesce("_a", "_b").alias(of), F.coalesce("_pa", "_pb").alias("page"), F.coalesce("_la", F.lit(False)).alias("left_present"), F.coalesce("_lb", F.lit(False)).alias("right_present"), diff_runs(F.col("_ta"), F.col("_tb")).alias("runs"))
    n = lambda kind: F.aggregate("runs", F.lit(0), lambda s, r: s + F.when(r["kind"] == kind, r["count"]).otherwise(0))
    return each.select("*", n("added").alias("added"), n("deleted").alias("deleted"), n("unchanged").alias("unchanged"))


def diff_rows(pages: DataFrame, of: str) -> DataFrame:
    """A row per run of ``page_diffs``: of, page, ordinal (from 1), kind, text and count."""
    each = pages.select(of, "page", F.posexplode("runs").alias("i", "r"))
    return each.select(of, "page", (F.col("i") + 1).alias("ordinal"), "r.kind", "r.text", "r.count")


def diff_totals(pages: DataFrame, of: str) -> DataFrame:
    """Per pair: pages, those on each side, pages that differ, and tokens added, deleted, changed (both) and unchanged."""
    changed = F.col("added") + F.col("deleted")
    return pages.groupBy(of).agg(F.count("*").alias("pages"), F.count_if("left_present").alias("left_pages"), F.count_if("right_present").alias("right_pages"), F.count_if(changed > 0).alias("changed_pages"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum(changed).alias("changed"), F.sum("unchanged").alias("unchanged"))


def comparison_report(pages: DataFrame, primary: Column, secondary: Column, of: str) -> DataFrame:
    """``page_diffs`` as lines of a report, all cells quoted and safe for spreadsheets: of, page and line. The columns are
    those of ``REPORT``; those of images stay empty."""
    cells = [primary, secondary, F.lit("content"), F.col("page"), F.lit(""), F.col("added"), F.col("deleted"), F.col("unchanged"), F.lit(""), F.lit("")]
    return pages.select(of, "page", F.concat_ws(",", *[quoted(c.cast("string")) for c in cells]).alias("line"))


def quoted(cell: Column) -> Column:
    """A cell in quotes, its own doubled, that a spreadsheet does not take for a formula; null is empty."""
    return F.concat(F.lit('"'), F.replace(spreadsheet_safe(F.coalesce(cell, F.lit(""))), F.lit('"'), F.lit('""')), F.lit('"'))
