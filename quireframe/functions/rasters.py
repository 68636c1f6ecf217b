"""Rasters: pixels as rows of bytes, four a pixel (red, green, blue, alpha), compared, laid over each other and cleaned up by numpy
in Arrow batches; and PNG files read and written. A raster is one row; tasks hold the rasters of a batch."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quireframe.session import ship_to_active

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST_PIXELS = 8_294_400
#: So many pixels are worked on at once, but for a larger raster.
MOST_STACKED = 1_000_000

DIFFERENCE = "struct<width:int,height:int,changed:long,compared:long,mismatch:boolean,mean_delta:double,max_delta:int>"
RASTER = "struct<width:int,height:int,pixels:binary>"


def _pixels(raster: dict) -> np.ndarray:
    return np.frombuffer(raster["pixels"], dtype=np.uint8).reshape(raster["height"], raster["width"], 4)


def _raster(pixels: np.ndarray) -> dict:
    return {"width": pixels.shape[1], "height": pixels.shape[0], "pixels": np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()}


def _by_row(make: Callable[..., dict | None], kind: str, *columns: Column) -> Column:
    """``make`` of each row's values, null where one of them is, as a column of the struct ``kind``."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    ship_to_active()
    spark_type = T._parse_datatype_string(kind)

    def one(arrow: pa.DataType, arrays: tuple) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if any(v is None for v in r) else make(*r) for r in rows], arrow)

    arrow = to_arrow_type(spark_type)
    if len(columns) == 1:

        def run1(a: pa.Array) -> pa.Array:
            return one(arrow, (a,))

        return F.arrow_udf(run1, spark_type)(*columns)

    def run2(a: pa.Array, b: pa.Array) -> pa.Array:
        return one(arrow, (a, b))

    return F.arrow_udf(run2, spark_type)(*columns)


def _by_shape(make: Callable[[np.ndarray, np.ndarray], dict | None], kind: str, a: Column, b: Column) -> Column:
    """``make`` of two stacks of rasters, those of one size each, for all sizes of a batch, as a column of the struct ``kind``; null where
    a raster is, or where ``make`` gives none."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    ship_to_active()
    spark_type = T._parse_datatype_string(kind)
    arrow = to_arrow_type(spark_type)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        there = ~(np.asarray(a.is_null()) | np.asarray(b.is_null()))
        sizes = np.stack([x.field(n).fill_null(0).to_numpy(zero_copy_only=False) for x in (a, b) for n in ("height", "width")], axis=1)
        pixels = [x.field("pixels").to_pylist() for x in (a, b)]
        out: dict[str, list] = {f.name: [None] * len(there) for f in arrow}
        found = np.zeros(len(there), dtype=bool)
        for size in np.unique(sizes[there], axis=0):
            own = np.flatnonzero(there & (sizes == size).all(axis=1))
            step = max(1, MOST_STACKED // max(1, int(size[0] * size[1]), int(size[2] * size[3])))
            for at in range(0, len(own), step):
                rows = own[at : at + step].tolist()
                stacks = [np.frombuffer(b"".join(p[i] for i in rows), np.uint8).reshape(len(rows), *hw, 4) for p, hw in zip(pixels, (size[:2], size[2:]), strict=True)]
                if (made := make(*stacks)) is None:
                    continue
                found[rows] = True
                for name, values in made.items():
                    for i, v in zip(rows, values, strict=True):
                        out[name][i] = v
        return pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in arrow], fields=list(arrow), mask=pa.array(~found))

    return F.arrow_udf(run, spark_type)(a, b)


def _differences(a: np.ndarray, b: np.ndarray) -> dict:
    n, h, w = len(a), min(a.shape[1], b.shape[1]), min(a.shape[2], b.shape[2])
    d = np.abs(a[:, :h, :w].astype(np.int16) - b[:, :h, :w]).max(axis=3, initial=0).reshape(n, -1)
    mean = d.sum(axis=1) / (h * w) if h * w else np.zeros(n)
    return {"width": [w] * n, "height": [h] * n, "changed": (d > 0).sum(axis=1).tolist(), "compared": [h * w] * n, "mismatch": [a.shape != b.shape] * n, "mean_delta": mean.tolist(), "max_delta": d.max(axis=1, initial=0).tolist()}


def difference(a: dict, b: dict) -> dict:
    """How two rasters differ where both have pixels: a pixel's delta is the largest of its four channels'."""
    h, w = min(a["height"], b["height"]), min(a["width"], b["width"])
    d = np.abs(_pixels(a)[:h, :w].astype(np.int16) - _pixels(b)[:h, :w]).max(axis=2, initial=0)
    return {"width": w, "height": h, "changed": int((d > 0).sum()), "compared": h * w, "mismatch": (a["width"], a["height"]) != (b["width"], b["height"]), "mean_delta": float(d.sum()) / (h * w) if h * w else 0.0, "max_delta": int(d.max(initial=0))}


def pixel_difference(a: Column, b: Column) -> Column:
    return _by_shape(_differences, DIFFERENCE, a, b)


def _over(base: np.ndarray, colour: tuple[int, int, int], raster: np.ndarray, opacity: float) -> np.ndarray:
    """``base`` with a colour laid over it as densely as the raster's ink is: by its darkness and alpha."""
    p = raster.astype(np.float64)
    dark = 255 - (p[..., 0] * 299 + p[..., 1] * 587 + p[..., 2] * 114) / 1000
    alpha = np.floor(p[..., 3] * dark * opacity / 255 + 0.5)[..., None]
    base[..., :3] = np.floor((np.array(colour) * alpha + base[..., :3] * (255 - alpha)) / 255 + 0.5)
    return base


def overlay(a: dict, b: dict, opacity: float) -> dict | None:
    """Two rasters of one size on white: the ink of the first in red, that of the second in cyan at ``opacity``; none if
    their sizes differ."""
    if (a["width"], a["height"]) != (b["width"], b["height"]):
        return None
    base = np.full((a["height"], a["width"], 4), 255.0)
    return _raster(_over(_over(base, (255, 0, 0), _pixels(a), 1.0), (0, 255, 255), _pixels(b), opacity))


def red_cyan_overlay(a: Column, b: Column, opacity: float) -> Column:
    if not 0 < opacity < 1:
        raise ValueError("opacity lies between 0 and 1")

    def make(x: np.ndarray, y: np.ndarray) -> dict | None:
        if x.shape != y.shape:
            return None
        n, h, w = x.shape[:3]
        done = _over(_over(np.full(x.shape, 255.0), (255, 0, 0), x, 1.0), (0, 255, 255), y, opacity).astype(np.uint8)
        return {"width": [w] * n, "height": [h] * n, "pixels": [p.tobytes() for p in done]}

    return _by_shape(make, RASTER, a, b)


def cleaned(raster: dict, preset: str) -> dict:
    """A raster in grey for recognition: bilevel is white from a luminance of 128 on, document stretches the luminances that
    there are to the whole range. All is opaque."""
    p = _pixels(raster).astype(np.float64)
    g = np.floor(p[..., 0] * 0.2126 + p[..., 1] * 0.7152 + p[..., 2] * 0.0722 + 0.5)
    low, high = g.min(initial=255), g.max(initial=0)
    out = np.where(g >= 128, 255, 0) if preset == "bilevel" or low == high else np.floor((g - low) / (high - low) * 255 + 0.5)
    return _raster(np.concatenate([np.repeat(out[..., None], 3, axis=2), np.full((*g.shape, 1), 255)], axis=2))


def ocr_cleanup(raster: Column, preset: str) -> Column:
    if preset not in ("bilevel", "document"):
        raise ValueError(f"unknown preset {preset}")
    return _by_row(lambda x: cleaned(x, preset), RASTER, raster)


def blackened(before: dict, after: dict, boxes: list[dict]) -> dict:
    """Whether ``after`` is ``before`` with the boxes (left, top, right, bottom in pixels) filled with opaque black and nothing
    else changed: pixels in boxes that are not black, and pixels outside that differ."""
    if (before["width"], before["height"]) != (after["width"], after["height"]):
        return {"left": -1, "touched": -1, "verified": False}
    a, b = _pixels(before), _pixels(after)
    inside = np.zeros(a.shape[:2], dtype=bool)
    for x in boxes:
        inside[x["top"] : x["bottom"], x["left"] : x["right"]] = True
    left = int((b[inside] != np.array([0, 0, 0, 255])).any(axis=1).sum())
    touched = int((a[~inside] != b[~inside]).any(axis=1).sum())
    return {"left": left, "touched": touched, "verified": left == 0 and touched == 0}


def redaction_check(pair: Column, boxes: Column) -> Column:
    """``blackened`` of a struct of before and after and an array of boxes: left, touched and verified."""
    return _by_row(lambda p, x: blackened(p["before"], p["after"], x), "struct<left:int,touched:int,verified:boolean>", pair, boxes)


def read_png(data: bytes) -> dict | None:
    """The raster of a PNG file of eight-bit RGB or RGBA without interlacing; none if it is another or damaged."""
    try:
        if data[:8] != SIGNATURE:
            return None
        at, head, body = 8, None, []
        while at < len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            part = data[at + 8 : at + 8 + n]
            if len(part) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
                return None
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"IDAT":
                body.append(part)
            at += 12 + n
            if kind == b"IEND":
                break
        w, h, depth, colour, _, _, interlace = head
        if depth != 8 or colour not in (2, 6) or interlace or not 0 < w * h <= MOST_PIXELS or at != len(data):
            return None
        c = 3 if colour == 2 else 4
        raw = zlib.decompressobj().decompress(b"".join(body), h * (w * c + 1) + 1)
        if len(raw) != h * (w * c + 1):
            return None
        rows = np.frombuffer(raw, dtype=np.uint8).reshape(h, w * c + 1)
        out = np.zeros((h, w * c), dtype=np.uint8)
        before = np.zeros(w * c, dtype=np.uint8)
        for y in range(h):
            out[y] = before = _unfiltered(int(rows[y, 0]), rows[y, 1:], before, c)
        pixels = out.reshape(h, w, c)
        return _raster(pixels if c == 4 else np.concatenate([pixels, np.full((h, w, 1), 255, np.uint8)], axis=2))
    except (struct.error, zlib.error, TypeError, ValueError):
        return None


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, c: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, c), axis=0, dtype=np.uint8).reshape(-1)
    if kind not in (3, 4):
        raise ValueError("unknown filter")
    out, up = row.astype(int).tolist(), above.tolist()
    for i in range(len(out)):
        left = out[i - c] if i >= c else 0
        corner = up[i - c] if i >= c else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda v: abs(p - v))
        out[i] = (out[i] + guess) & 255
    return np.array(out, dtype=np.uint8)


def write_png(raster: dict) -> dict:
    """A PNG file of a raster."""
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    p = _pixels(raster).reshape(raster["height"], -1)
    raw = np.concatenate([np.zeros((len(p), 1), np.uint8), p], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", raster["width"], raster["height"], 8, 6, 0, 0, 0)
    return {"png": SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")}


def png_decoded(data: Column) -> Column:
    """A PNG file's raster, null where it is damaged or of another kind."""
    return _by_row(read_png, RASTER, data)


def png_encoded(raster: Column) -> Column:
    return _by_row(write_png, "struct<png:binary>", raster)["png"]
