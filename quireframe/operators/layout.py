"""Layout of recognized words: rows, columns and tables by their geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALIGNED = 0.04
LEAST_SCORE = 0.6
MOST_ROWS, MOST_COLUMNS = 200, 32


def _rows(words: DataFrame, most_rows: int) -> DataFrame:
    """Words of lines of two words at least: with place (from 0, by x) in their line, n, the line's words, and row (from 0),
    the line's place among the document's by the y of its first word; the first ``most_rows``."""
    line = ["doc_id", "page", "block", "paragraph", "line"]
    w = Window.partitionBy(*line)
    each = words.withColumns({"place": F.row_number().over(w.orderBy("x", "id")) - 1, "n": F.count("*").over(w)}).filter("n >= 2")
    first = each.withColumn("_y", F.min_by("y", F.struct("x", "id")).over(w))
    of = Window.partitionBy("doc_id").orderBy("_y", *line[1:])
    return first.withColumn("row", F.dense_rank().over(of) - 1).filter(F.col("row") < most_rows).drop("_y")


def tables(words: DataFrame, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """The table that each document's words (doc_id, page, block, paragraph, line, id, text, x, y, width, height) form, if any:
    doc_id, rows, columns, score and its box. Lines of two words at least are rows; columns are as many as the shortest row
    has words, anchored at the mean x of their words; score is the share of words within 0.04 of their anchor, and 0.6 at
    least makes a table of two rows."""
    each = _rows(words, most_rows)
    shape = each.groupBy("doc_id").agg(F.count_distinct("row").alias("rows"), F.least(F.min("n"), F.lit(most_columns)).cast("int").alias("columns"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))
    shape = shape.filter("rows >= 2 AND columns >= 2")
    anchors = table_anchors(each, shape)
    near = each.join(anchors, ["doc_id", "place"]).groupBy("doc_id").agg(F.avg((F.abs(F.col("x") - F.col("anchor")) <= ALIGNED).cast("int")).alias("score"))
    return shape.join(near.filter(F.col("score") >= LEAST_SCORE), "doc_id").select("doc_id", "rows", "columns", F.round("score", 3).alias("score"), "x", "y", "width", "height")


def table_anchors(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """doc_id, place and anchor of the columns of each document in ``shape`` (doc_id, columns)."""
    each = rows.join(shape.select("doc_id", "columns"), "doc_id").filter(F.col("place") < F.col("columns"))
    return each.groupBy("doc_id", "place").agg(F.avg("x").alias("anchor"))


def table_cells(words: DataFrame, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """The cells of ``tables``: doc_id, row, column (from 0), text (words by x, parted by blanks) and n. A word belongs to the
    column whose anchor is nearest, the first of equally near ones; cells without words give no row."""
    found = tables(words, most_rows, most_columns)
    each = _rows(words, most_rows).join(found.select("doc_id"), "doc_id", "left_semi")
    anchors = table_anchors(each, found).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "anchor"))).alias("a"))  # 32 at most
    placed = each.join(anchors, "doc_id").withColumn("column", F.array_min(F.transform("a", lambda s: F.struct(F.abs(F.col("x") - s["anchor"]).alias("d"), s["place"].alias("p"))))["p"])
    cells = placed.groupBy("doc_id", "row", "column").agg(F.sort_array(F.collect_list(F.struct("x", "id", "text"))).alias("w"), F.count("*").alias("n"))
    return cells.select("doc_id", "row", "column", F.array_join(F.transform("w", lambda s: s["text"]), " ").alias("text"), "n")


def words_in_order(words: DataFrame, of: list[str]) -> DataFrame:
    """Words with their place (from 1) in their line by x."""
    return words.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy("x", "id")))
