"""Hard negatives of anchors by bit-sliced integer products (operator 12).

Components are integers. Those of a candidate are taken apart into bit planes, the sign's plane first. After each plane the score
with an anchor lies in an interval: the products so far, and what the planes left can add, by the signs of the anchor's
components and by the lengths of anchor and remainder. Candidates whose interval ends below what an anchor's best are sure to
reach, or outside of the scores asked for, are dropped; those left after the last plane have exact scores.

The anchors are the stated queries; all rows are candidates. Both are dealt into tiles of a bounded number of rows, and each
pair of tiles is a task's group of its own, whatever labels or repeated rows they hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm.shared import written
from quireframe.session import ship_code

#: Fixed values of the digest: components are multiples of 1/256 rounded down.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Rows of a tile of anchors and of candidates, about.
ANCHOR_TILE, CANDIDATE_TILE = 2048, 8192
#: Anchors of a tile that are compared with the tile of candidates at once.
ANCHORS_AT_ONCE = 64


def quantized(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label and q (array of long: floor(scale * component)) of the rows that take part: those with a label and a vector
    without null or non-finite components. A null key takes part as a candidate that comes after others of its score."""
    v = vectors.select(vectors[f"`{key}`"].cast("long").alias("id"), vectors[f"`{label}`"].cast("long").alias("label"), vectors[f"`{embedding}`"].cast("array<double>").alias("v"))
    v = v.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return v.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


def bit_planes(values: np.ndarray) -> tuple[int, list[tuple[int, np.ndarray, float, np.ndarray]]]:
    """What ``values`` (candidates by components) are made of: a number that each component begins with, and the planes to add
    to it, the most significant first. A plane has its weight, its bits (components by candidates), and, of what is left after
    it, the middle of the range of a component and each candidate's length about that middle."""
    bits = (int(np.abs(values).max(initial=0)) + 1).bit_length()
    rest = values + (1 << bits)
    planes = []
    for j in range(bits, -1, -1):
        plane = np.ascontiguousarray(((rest >> j) & 1).T.astype(np.uint8))
        rest = rest & ((1 << j) - 1)
        middle = ((1 << j) - 1) / 2
        planes.append((1 << j, plane, middle, np.sqrt(((rest - middle) ** 2).sum(axis=1))))
    return -(1 << bits), planes


def _search(anchors: np.ndarray, values: np.ndarray, allowed: Callable[[int, np.ndarray], np.ndarray], keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray]):
    """(anchor's place, candidates' places, exact scores) for each anchor, of candidates that ``keep`` leaves.

    ``allowed`` (anchor's place, all False flags) tells the candidates to begin with; ``keep`` (anchor's place, lower ends,
    upper ends) those that can still qualify."""
    d = values.shape[1]
    largest = int(np.abs(anchors).max(initial=0)) * max(d, 1)
    if largest * (2 * int(np.abs(values).max(initial=0)) + 2) >= 1 << 62:
        raise ValueError("components are too large for scores of 64 bits")
    # A product with a plane is a sum of an anchor's components, exact in the first of these that holds it.
    exact = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    begin, planes = bit_planes(values)
    a, sums, ones = anchors.astype(exact), anchors.sum(axis=1).tolist(), np.abs(anchors).sum(axis=1).tolist()
    length = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    for first in range(0, len(a), ANCHORS_AT_ONCE):
        block = a[first : first + ANCHORS_AT_ONCE]
        alive = [np.flatnonzero(allowed(first + i)) for i in range(len(block))]
        score = [np.full(len(c), sums[first + i] * begin, np.int64) for i, c in enumerate(alive)]
        for weight, plane, middle, about in planes:
            # While most candidates are left, one product for all of the block's anchors is cheaper than one for each.
            dense = block @ plane.astype(exact) if sum(map(len, alive)) * 4 > len(block) * plane.shape[1] else None
            for i, c in enumerate(alive):
                if not len(c):
                    continue
                product = dense[i, c] if dense is not None else block[i] @ plane[:, c].astype(exact)
                score[i] += weight * product.astype(np.int64)
                # Both bounds on what is left hold; they are widened by what rounding may take.
                reach = np.minimum(length[first + i] * about[c], middle * ones[first + i])
                centre = score[i] + middle * sums[first + i]
                reach += 1e-9 * (reach + np.abs(centre)) + 1e-6
                low, high = np.ceil(centre - reach).astype(np.int64), np.floor(centre + reach).astype(np.int64)
                stay = keep(first + i, c, low, high)
                alive[i], score[i] = c[stay], score[i][stay]
        for i, c in enumerate(alive):
            yield first + i, c, score[i]


def _matrix(table: pa.Table, d: int) -> np.ndarray:
    """The vectors of a tile, shorter ones filled up with zeros."""
    column = table.column("q").combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if d and (lengths == d).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    for i, row in enumerate(column.to_pylist()):
        out[i, : len(row)] = row
    return out


def _dimension(*tables: pa.Table) -> int:
    return max([0, *(int(np.diff(t.column("q").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables)])


def _kth_best(low: np.ndarray, k: int) -> int:
    return int(np.partition(low, len(low) - k)[len(low) - k])


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, label and id of a tile's candidates, null ids as the greatest number."""
    ids = table.column("id").combine_chunks().fill_null(np.iinfo(np.int64).max)
    return table.column("row").to_numpy(), table.column("label").to_numpy(), ids.to_numpy(zero_copy_only=False)


def best_of_label(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """For each anchor of ``left`` (row, label, q) the ``k`` best rows of its label in ``right`` (row, id, label, q): row, other,
    score."""
    d = _dimension(left, right)
    rows, of = left.column("row").to_numpy(), left.column("label").to_numpy()
    others, labels, ids = _columns(right)

    def keep(i: int, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= _kth_best(low, k) if len(c) > k else np.ones(len(c), bool)

    out: list[list] = [[], [], []]
    for i, c, score in _search(_matrix(left, d), _matrix(right, d), lambda i: (labels == of[i]) & (others != rows[i]), keep):
        first = np.lexsort((others[c], ids[c], -score))[:k]
        out[0] += [rows[i]] * len(first)
        out[1] += others[c[first]].tolist()
        out[2] += score[first].tolist()
    return pa.table([pa.array(x, pa.int64()) for x in out], ["row", "other", "score"])


def best_within(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """For each anchor of ``left`` (row, label, q, windows: array of place, low, high) and each of its windows the ``k`` best rows
    of other labels in ``right`` whose scores lie in the window: row, place, other, score."""
    d = _dimension(left, right)
    rows, of = left.column("row").to_numpy(), left.column("label").to_numpy()
    others, labels, ids = _columns(right)
    windows = [[(w["place"], w["low"], w["high"]) for w in ws] for ws in left.column("windows").to_pylist()]

    def keep(i: int, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(c), bool)
        for _, least, most in windows[i]:
            can = (high >= least) & (low <= most)
            sure = low[(low >= least) & (high <= most)]
            stay |= can & (high >= _kth_best(sure, k)) if len(sure) >= k else can
        return stay

    out: list[list] = [[], [], [], []]
    for i, c, score in _search(_matrix(left, d), _matrix(right, d), lambda i: labels != of[i], keep):
        for place, least, most in windows[i]:
            inside = np.flatnonzero((score >= least) & (score <= most))
            first = inside[np.lexsort((others[c[inside]], ids[c[inside]], -score[inside]))[:k]]
            out[0] += [rows[i]] * len(first)
            out[1] += [place] * len(first)
            out[2] += others[c[first]].tolist()
            out[3] += score[first].tolist()
    return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["row", "place", "other", "score"])


def _tiled(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows`` with the number of its tile, and how many tiles there are."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")), n


def _in_tiles(anchors: DataFrame, candidates: DataFrame, search: Callable, schema: str, k: int, sizes: tuple[int, int]) -> DataFrame:
    """``search`` over every pair of a tile of anchors and one of candidates."""
    a, n_a = _tiled(anchors, sizes[0])
    c, n_c = _tiled(candidates, sizes[1])
    left = a.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    # Both sides come of the same table; columns of their own keep them apart.
    left, c = (t.select(*(F.col(x).alias(x) for x in t.columns)) for t in (left, c))
    right = c.withColumnRenamed("tile", "with").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))
    found = left.groupBy("tile", "with").cogroup(right.groupBy("tile", "with")).applyInArrow(lambda x, y: search(x, y, k), schema)
    return found.join(candidates.select(F.col("row").alias("other"), "id"), "other")


def _first(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The first ``k`` of each group, best first, ties by id, then by row. A group has ``k`` rows of each tile at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, percent: tuple[int, int] = (50, 95), scale: int = SCALE, tiles: tuple[int, int] = (ANCHOR_TILE, CANDIDATE_TILE)) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank (int, from 1), negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition over id. An anchor's positives are the first ``positives`` other rows of its label by integer
    product, ties by smaller id; a positive's negatives the first ``negatives`` rows of other labels whose product is between
    ``percent`` of the positive's, in hundredths. Fewer where there are fewer; a positive without one has no row.

    Rows with a null label, vector or component, or one that is not finite, take no part. A null key is no anchor and comes
    last among ties; rows that repeat are candidates, and anchors, each. Of vectors of several lengths the shorter ones count as
    filled up with zeros; components so large that a product passes 62 bits are an error. An empty table gives no rows. ``tiles``
    bounds memory and changes no result."""
    ship_code(vectors.sparkSession)
    rows = written(quantized(vectors, key, embedding, label, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.filter(is_anchor)
    near = _in_tiles(anchors.select("row", "label", "q"), rows, best_of_label, "row long, other long, score long", positives, tiles)
    best = written(_first(near, ["row"], positives, "place").withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).drop("other"), "positives")
    low, high = (F.lit(p) * F.col("positive_score") for p in percent)
    window = F.struct("place", (-F.floor(-low / 100)).cast("long").alias("low"), F.floor(high / 100).cast("long").alias("high"))
    asked = best.withColumn("window", window).filter("window.low <= window.high").groupBy("row").agg(F.collect_list("window").alias("windows"))
    far = _in_tiles(anchors.join(asked, "row").select("row", "label", "q", "windows"), rows, best_within, "row long, place int, other long, score long", negatives, tiles)
    mined = _first(far, ["row", "place"], negatives, "rank").withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    joined = mined.join(best, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return joined.select("anchor_id", "positive_id", F.col("place").alias("positive_rank"), "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) with the next label of ``labels`` where vec_id is divisible by ``every``."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")).alias("label"))
