"""The nearest of many anchors to each of many points on a line, as rows on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireframe.session import checkpointed


def nearest(points: DataFrame, anchors: DataFrame, of: list[str], x: str, place: str) -> DataFrame:
    """``points`` (``of``, ``x``) with nearest, the ``place`` of the anchor of the same keys ``of`` whose ``x`` is nearest, and
    distance. Of equally near anchors the one with the smallest place counts. Without an anchor, or without an x, both are null; null
    keys are keys like others; anchors without x or place count for nothing. With ``of`` empty all anchors serve all points.

    Only the distinct places of points are compared. They and the anchors are cut by ranges of keys and x into blocks, so that one key
    may hold all rows; a block looks at its own rows in order, and takes what lies below and above it from one row a block and key.
    """
    if {"nearest", "distance"} & set(points.columns):
        raise ValueError("points have a column nearest or distance")
    keys = [f"_k{i}" for i in range(len(of))]
    named = [F.col(c).alias(k) for c, k in zip(of, keys, strict=True)]
    at = F.col(x).cast("double").alias("_x")
    wanted = points.select(*named, at).filter("_x IS NOT NULL").distinct()
    marks = anchors.select(*named, at, F.col(place).alias("_p")).filter("_x IS NOT NULL AND _p IS NOT NULL").groupBy(*keys, "_x").agg(F.min("_p").alias("_p"))
    both = wanted.unionByName(marks, allowMissingColumns=True).repartitionByRange(*keys, "_x")
    blocks = checkpointed(both.withColumn("_b", F.spark_partition_id()))

    mark = F.when(F.col("_p").isNotNull(), F.struct("_x", "_p"))
    of_block = blocks.groupBy("_b", *keys).agg(F.max(mark).alias("_last"), F.min(mark).alias("_first"))
    # Frames that begin with a window's first row grow in one pass; so what lies above is looked for in falling order.
    along, back = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys).orderBy(F.desc("_b"))  # a row for each block that a key lies in
    ends = of_block.select("_b", *keys, F.max("_last").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.min("_first").over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))

    up, down = Window.partitionBy("_b", *keys).orderBy("_x"), Window.partitionBy("_b", *keys).orderBy(F.desc("_x"))
    reach = (Window.unboundedPreceding, Window.currentRow)
    near = blocks.withColumns({"_low": F.max(mark).over(up.rangeBetween(*reach)), "_high": F.min(mark).over(down.rangeBetween(*reach))})
    near = near.filter("_p IS NULL").alias("n").join(ends.alias("e"), _same("n", "e", ["_b", *keys]))
    seen = F.array_compact(F.array("n._low", "n._high", "e._below", "e._above"))
    best = F.array_min(F.transform(seen, lambda a: F.struct(F.abs(F.col("n._x") - a["_x"]).alias("d"), a["_p"].alias("p"))))
    found = near.select(*[f"n.{k}" for k in keys], "n._x", best.alias("_best"))
    rows = points.select(F.struct("*").alias("_row"), *named, at)
    return rows.alias("r").join(found.alias("f"), _same("r", "f", [*keys, "_x"]), "left").select("r._row.*", F.col("f._best.p").alias("nearest"), F.col("f._best.d").alias("distance"))


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda p, q: p & q, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])
