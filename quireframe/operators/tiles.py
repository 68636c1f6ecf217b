"""Rasters as rows of tiles: raster, width, height (of the whole raster), row and column (of the tile), and pixels, four bytes each
(red, green, blue, alpha), line by line. A tile is ``TILE`` pixels wide and high, or less at the right and bottom edge, so that no row
and no task holds a raster. What is told of a raster is summed from its tiles. A raster without pixels has no tiles and no result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.functions import rasters as W

TILE = 256
KEYS = ["raster", "row", "column"]


def tiles_of_lines(lines: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of scan lines (raster, width, height, y from 0, pixels). Every line has to be there once; a tile collects ``tile`` pieces."""
    of = F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / tile).cast("int") - 1)).alias("column")
    each = lines.filter("width > 0 AND height > 0").select("raster", F.col("width").cast("int"), F.col("height").cast("int"), F.expr(f"int(y div {tile})").alias("row"), F.col("y"), "pixels", of)
    piece = F.substring(F.col("pixels"), F.col("column") * (4 * tile) + 1, F.lit(4 * tile))
    part = F.struct("y", piece.alias("p"))
    found = each.groupBy("raster", "width", "height", "row", "column").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return found.withColumn("pixels", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["p"])), ""))).drop("parts")


def tiles_of_bands(bands: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of bands (raster, width, height, row, pixels), each the scan lines of one row of tiles. A band is cut where it lies:
    nothing is shuffled."""
    of = F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / tile).cast("int") - 1)).alias("column")
    each = bands.filter("width > 0 AND height > 0").select("raster", F.col("width").cast("int"), F.col("height").cast("int"), F.col("row").cast("int"), of, "pixels")
    wide, high = (F.least(F.lit(tile), F.col(n) - F.col(at) * tile) for n, at in (("width", "column"), ("height", "row")))
    piece = lambda i: F.hex(F.substring(F.col("pixels"), (i * F.col("width") + F.col("column") * tile) * 4 + 1, wide * 4))
    return each.withColumn("pixels", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), high - 1), piece), "")))


def lines_of_tiles(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Scan lines of tiles: raster, width, height, y and pixels. The tiles of one row meet, whole, in a window, which spills less than
    an aggregation of pieces of lines."""
    row = F.sort_array(F.collect_list(F.struct("column", "pixels")).over(Window.partitionBy("raster", "width", "height", "row")))
    bands = tiles.select("raster", "width", "height", "row", "column", row.alias("_t")).filter("column = 0")
    piece = lambda t, i: F.hex(F.substring(t["pixels"], i * F.least(F.lit(tile), F.col("width") - t["column"] * tile) * 4 + 1, F.least(F.lit(tile), F.col("width") - t["column"] * tile) * 4))
    high = F.least(F.lit(tile), F.col("height") - F.col("row") * tile)
    lines = F.transform(F.sequence(F.lit(0), high - 1), lambda i: F.struct((F.col("row") * tile + i).alias("y"), F.unhex(F.array_join(F.transform("_t", lambda t: piece(t, i)), "")).alias("pixels")))
    return bands.select("raster", "width", "height", F.explode(lines).alias("l")).select("raster", "width", "height", "l.*")


def _own(tile: int, side: str = ""):
    """A tile as a raster of its own."""
    c = lambda n: F.col(f"{side}{n}")
    return F.struct(F.least(F.lit(tile), c("width") - c("column") * tile).alias("width"), F.least(F.lit(tile), c("height") - c("row") * tile).alias("height"), c("pixels").alias("pixels"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiles of both sides at one place."""
    other = b.select(*KEYS, *[F.col(c).alias(f"o_{c}") for c in ("width", "height", "pixels")], F.col("row").alias("o_row"), F.col("column").alias("o_column"))
    return a.select(*KEYS, "width", "height", "pixels").join(other, KEYS)


def _delta(a: dict, b: dict) -> dict:
    h, w = min(a["height"], b["height"]), min(a["width"], b["width"])
    d = np.abs(W._pixels(a)[:h, :w].astype(np.int16) - W._pixels(b)[:h, :w]).max(axis=2)
    return {"changed": int(np.count_nonzero(d)), "compared": h * w, "total": int(d.sum()), "largest": int(d.max())}


def tile_difference(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each raster of both sides: width and height of what both cover, changed and compared pixels, mismatch (other
    sizes), and mean_delta and max_delta of each pixel's most different channel."""
    d = W._by_row(_delta, "struct<changed:long,compared:long,total:long,largest:int>", _own(tile), _own(tile, "o_"))
    each = _pairs(a, b).select("raster", F.least("width", "o_width").alias("width"), F.least("height", "o_height").alias("height"), ((F.col("width") != F.col("o_width")) | (F.col("height") != F.col("o_height"))).alias("mismatch"), d.alias("d"))
    sums = each.groupBy("raster", "width", "height", "mismatch").agg(F.sum("d.changed").alias("changed"), F.sum("d.compared").alias("compared"), F.sum("d.total").alias("_total"), F.max("d.largest").alias("max_delta"))
    return sums.select("raster", "width", "height", "changed", "compared", "mismatch", (F.col("_total") / F.col("compared")).alias("mean_delta"), "max_delta")


def tile_overlay(a: DataFrame, b: DataFrame, opacity: float, tile: int = TILE) -> DataFrame:
    """Tiles of the rasters that both sides have in one size: the ink of ``a`` in red, that of ``b`` in cyan at ``opacity``."""
    both = _pairs(a, b).filter("width = o_width AND height = o_height")
    return both.select(*KEYS, "width", "height", W.red_cyan_overlay(_own(tile), _own(tile, "o_"), opacity)["pixels"].alias("pixels"))


def _luminance(p: np.ndarray) -> np.ndarray:
    q = p.astype(np.float64)
    return np.floor(q[..., 0] * 0.2126 + q[..., 1] * 0.7152 + q[..., 2] * 0.0722 + 0.5)


def _grey(t: dict) -> dict:
    g = _luminance(W._pixels(t)).astype(np.uint8)
    return {"grey": g.tobytes(), "low": int(g.min()), "high": int(g.max())}


def _stretched(t: dict, bounds: dict) -> dict:
    g, low, high = np.frombuffer(t["grey"], np.uint8).reshape(t["height"], t["width"]).astype(np.float64), bounds["low"], bounds["high"]
    out = np.where(g >= 128, 255, 0) if low == high else np.floor((g - low) / (high - low) * 255 + 0.5)
    return W._raster(np.concatenate([np.repeat(out[..., None], 3, axis=2), np.full((*g.shape, 1), 255)], axis=2))


def tile_cleanup(tiles: DataFrame, preset: str, tile: int = TILE) -> DataFrame:
    """``tiles`` in grey for recognition: bilevel is white from a luminance of 128 on; document stretches the luminances that the
    whole raster has to all of the range. A raster's tiles meet for their bounds as a byte a pixel, in a window that spills."""
    if preset not in ("bilevel", "document"):
        raise ValueError(f"unknown preset {preset}")
    if preset == "bilevel":
        return tiles.select(*KEYS, "width", "height", W.ocr_cleanup(_own(tile), preset)["pixels"].alias("pixels"))
    each = tiles.select(*KEYS, "width", "height", W._by_row(_grey, "struct<grey:binary,low:int,high:int>", _own(tile)).alias("g"))
    w, own = Window.partitionBy("raster"), _own(tile)
    each = each.select(*KEYS, "width", "height", F.col("g.grey").alias("pixels"), F.min("g.low").over(w).alias("low"), F.max("g.high").over(w).alias("high"))
    grey = F.struct(own["width"].alias("width"), own["height"].alias("height"), own["pixels"].alias("grey"))
    return each.select(*KEYS, "width", "height", W._by_row(_stretched, W.RASTER, grey, F.struct("low", "high"))["pixels"].alias("pixels"))


def tile_redactions(before: DataFrame, after: DataFrame, boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """Whether ``after`` is ``before`` with ``boxes`` (raster, left, top, right, bottom in pixels) filled with opaque black and nothing
    else changed: raster, left (pixels in boxes that are not black), touched (pixels outside that differ), both -1 where the sizes
    differ, and verified. A box is cut at the tiles that it meets; equal pieces of one tile count once."""
    sizes = before.filter((F.col("row") == 0) & (F.col("column") == 0)).select("raster", "width", "height")
    inside = boxes.join(sizes, "raster").select("raster", F.greatest("left", F.lit(0)).alias("l"), F.greatest("top", F.lit(0)).alias("t"), F.least("right", "width").alias("r"), F.least("bottom", "height").alias("b")).filter("l < r AND t < b")
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / tile).cast("int"), F.floor((F.col(high) - 1) / tile).cast("int")))
    cut = inside.withColumn("row", span("t", "b")).withColumn("column", span("l", "r"))
    edge = lambda c, n: F.least(F.greatest(F.col(c) - F.col(n) * tile, F.lit(0)), F.lit(tile)).cast("int")
    piece = F.struct(edge("l", "column").alias("left"), edge("t", "row").alias("top"), edge("r", "column").alias("right"), edge("b", "row").alias("bottom"))
    held = cut.groupBy(*KEYS).agg(F.collect_set(piece).alias("boxes"))
    empty = F.expr("cast(array() as array<struct<left:int,top:int,right:int,bottom:int>>)")
    both = _pairs(before, after).join(held, KEYS, "left").withColumn("boxes", F.coalesce("boxes", empty))
    same = (F.col("width") == F.col("o_width")) & (F.col("height") == F.col("o_height"))
    check = W.redaction_check(F.struct(_own(tile).alias("before"), _own(tile, "o_").alias("after")), F.col("boxes"))
    each = both.select("raster", same.alias("same"), F.when(same, check).alias("c"))
    sums = each.groupBy("raster", "same").agg(F.sum("c.left").alias("left"), F.sum("c.touched").alias("touched"))
    n = lambda c: F.when(F.col("same"), F.col(c)).otherwise(-1).alias(c)
    return sums.select("raster", n("left"), n("touched"), (F.col("same") & (F.col("left") == 0) & (F.col("touched") == 0)).alias("verified"))
