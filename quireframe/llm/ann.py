"""Approximate nearest neighbours by adaptive dimension scan (operator 3).

Vectors are turned by a random rotation and dealt to the lists of a coarse quantizer. Each query first reads the few lists
whose bounds are largest, then every list whose bound reaches the k-th best score that these gave. A bound is a test at
``DEVIATIONS``: a list's vectors lie around its centre in all directions, so that their inner products with q spread about
q.centre by |q| * radius / sqrt(d); what certainly is no less, q.centre + |q| * radius and |q| times the longest vector's
norm, bounds it too. Within a list the scan reads column blocks of the rotated vectors: after each block the partial
distance, scaled up to all dimensions, is tested against the query's current k-th best, and candidates that fail the test
are abandoned. What is left gets its exact inner product on the original vectors.

Inner products are searched as distances between directions: for unit q and x, |q - x|^2 = 2 - 2 q.x, so that the norms
set the distance within which a candidate would beat the k-th best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm.shared import written
from quireframe.session import ship_code

K = 20
#: Vectors per list aimed at; the number of lists is bounded, as each task holds their centres.
LIST_SIZE = 32
MAX_LISTS = 4_096
#: The coarse quantizer is fitted on so many vectors at most, drawn by a hash of the id. All vectors are indexed.
SAMPLE = 20_000
ROUNDS = 6
#: Lists of the largest bounds, which are read first; they give the threshold that the others' bounds are compared with and
#: their vectors scanned with.
FIRST_PROBES = 8
#: Deviations from the centre at which a list is given up; more read more lists.
DEVIATIONS = 3.0
#: Candidates and queries in one unit of work at most; longer lists are cut into several units, short ones share one. So
#: that small tables have work for many tasks, UNITS are aimed at, of no fewer than LEAST_UNIT_ROWS candidates.
UNIT_ROWS = 4_096
LEAST_UNIT_ROWS = 512
UNITS = 32
UNIT_QUERIES = 4_096
#: Dimensions of a column block, and the significance of the test: larger abandons less.
BLOCK = 16
EPSILON = 1.2
SEED = 30_011


class Index(NamedTuple):
    """What each task holds: the rotation, the lists' centres and the dimension; for queries, also each list's radius
    around its centre, its largest norm (minus infinity: no vectors) and group, and the parts of each group."""

    rotation: np.ndarray
    centers: np.ndarray
    radii: np.ndarray | None = None
    norms: np.ndarray | None = None
    groups: np.ndarray | None = None
    parts: np.ndarray | None = None

    @property
    def dimension(self) -> int:
        return self.rotation.shape[0]


def usable(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part: not null, not zero, all components finite.

    Of several lengths the most frequent one takes part (the shorter of equals).
    """
    v = vectors.select(vectors[f"`{key}`"].alias("vec_id"), vectors[f"`{embedding}`"].cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(finite & F.exists("v", lambda x: x != 0))
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("v") == (lengths["d"] if lengths else 0))


def fit(vectors: DataFrame, total: int) -> Index:
    """The index's rotation and centres, from a bounded sample of ``vectors``."""
    share = min(1.0, 2.0 * SAMPLE / max(total, 1))
    drawn = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("v").collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64)
    random = np.random.default_rng(SEED)
    d = x.shape[1]
    rotation, r = np.linalg.qr(random.standard_normal((d, d)))
    rotation = rotation * np.sign(np.diag(r))
    apart = np.unique(x, axis=0)
    n = int(min(MAX_LISTS, max(1, total // LIST_SIZE), len(apart)))
    centers = apart[random.choice(len(apart), n, replace=False)]
    for _ in range(ROUNDS):
        nearest = _nearest(x, centers)
        sums, counts = np.zeros_like(centers), np.bincount(nearest, minlength=n)
        np.add.at(sums, nearest, x)
        empty = counts == 0
        centers = sums / np.maximum(counts, 1)[:, None]
        centers[empty] = apart[random.choice(len(apart), int(empty.sum()))]
    return Index(rotation, centers)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; rows are taken a few thousand at a time."""
    half = 0.5 * (centers**2).sum(1)
    return np.concatenate([(half - x[i : i + 4096] @ centers.T).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=int)])


def _bounds(q: np.ndarray, index: Index) -> np.ndarray:
    """What hardly an inner product of a query (row) with a vector of a list (column) exceeds; a hair more for rounding."""
    lengths = np.linalg.norm(q, axis=1)[:, None]
    spread = index.radii * min(1.0, DEVIATIONS / np.sqrt(index.dimension))
    hair = 1e-9 * lengths * (np.linalg.norm(index.centers, axis=1) + np.maximum(index.radii, 0))
    return np.where(index.norms == -np.inf, -np.inf, np.minimum(q @ index.centers.T + lengths * spread, lengths * index.norms) + hair)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _dealt(vectors: DataFrame, index: Index) -> DataFrame:
    """``vectors`` with the list that each belongs to, the distance from its centre and the norm."""
    centers = index.centers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 4096) for x in batches for i in range(0, x.num_rows, 4096)):
            x = _matrix(b.column("v"))
            near = _nearest(x, centers)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(np.linalg.norm(x - centers[near], axis=1)), pa.array(np.linalg.norm(x, axis=1))], ["vec_id", "v", "list", "away", "norm"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, v array<double>, list int, away double, norm double")


def _measured(index: Index, base: DataFrame, total: int) -> Index:
    """``index`` with what queries need; a row for each list comes to the driver. Lists of like norms share a group."""
    n = len(index.centers)
    radii, norms, counts = np.zeros(n), np.full(n, -np.inf), np.zeros(n, dtype=int)
    for r in base.groupBy("list").agg(F.max("away").alias("away"), F.max("norm").alias("norm"), F.count("*").alias("rows")).collect():
        radii[r["list"]], norms[r["list"]], counts[r["list"]] = r["away"], r["norm"], r["rows"]
    most = min(UNIT_ROWS, max(LEAST_UNIT_ROWS, total // UNITS))
    groups, sizes = np.zeros(n, dtype=np.int32), [0]
    for i in np.argsort(-norms, kind="stable"):
        if sizes[-1] and sizes[-1] + counts[i] > most:
            sizes.append(0)
        groups[i] = len(sizes) - 1
        sizes[-1] += int(counts[i])
    return index._replace(radii=radii, norms=norms, groups=groups, parts=np.array([max(1, -(-x // most)) for x in sizes]))


def _reaching(bounds: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Whether a list's bound (column) reaches the k-th best score of a query (row; minus infinity: none)."""
    return (bounds >= kth[:, None]) & (bounds > -np.inf) | np.isnan(bounds)


def _asking(queries: DataFrame, index: Index, first: bool) -> DataFrame:
    """``queries`` with the groups to read: ``first`` those of the foremost lists, which ``lists`` then holds; after that
    those of all other lists that the bounds leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 1024) for x in batches for i in range(0, x.num_rows, 1024)):
            bounds = _bounds(_matrix(b.column("v")), index)
            if first:
                lists = [most[x[most] > -np.inf] for x in bounds for most in [np.argsort(-x, kind="stable")[:FIRST_PROBES]]]
                groups = [np.unique(index.groups[x]) for x in lists]
            else:
                lists = [np.array(x, dtype=int) for x in b.column("lists").to_pylist()]
                reach = _reaching(bounds, b.column("kth").to_numpy()) & ~_chosen(lists, index)
                groups = [np.unique(index.groups[x]) for x in reach]
            lists, groups = (pa.array([y.astype(np.int32) for y in x], pa.list_(pa.int32())) for x in (lists, groups))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("kth"), lists, groups], ["vec_id", "v", "kth", "lists", "groups"])

    kind = queries.schema["vec_id"].dataType.simpleString()
    return queries.mapInArrow(run, f"vec_id {kind}, v array<double>, kth double, lists array<int>, groups array<int>")


def _chosen(lists: list, index: Index) -> np.ndarray:
    """Whether a list (column) is among those named for a query (row)."""
    out = np.zeros((len(lists), len(index.centers)), dtype=bool)
    for row, named in zip(out, lists, strict=True):
        row[named] = True
    return out


def scan(qid: np.ndarray, q: np.ndarray, kth: np.ndarray, xid: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of queries, places of candidates and scores of each query's ``k`` best candidates (its own id aside), and
    how many of all pairs were read to the end.

    ``kth`` is each query's k-th best score so far (minus infinity: none). Column blocks are read for all candidates
    while most are in the race, and only for the pairs that are left once few are.
    """
    d = x.shape[1]
    tiny = np.finfo(float).tiny
    x_norm, q_norm = np.maximum(np.linalg.norm(x, axis=1), tiny), np.maximum(np.linalg.norm(q, axis=1), tiny)
    turned, at_q = (x / x_norm[:, None]) @ rotation, (q / q_norm[:, None]) @ rotation
    blocks = [slice(i, min(i + BLOCK, d)) for i in range(0, d, BLOCK)]
    lengths = [((turned[:, c] ** 2).sum(1), (at_q[:, c] ** 2).sum(1)) for c in blocks]
    # A candidate beats the k-th best if its direction's distance is below this; a hair more keeps ties.
    with np.errstate(all="ignore"):
        limit = 2 * (1 + 1e-9) - 2 * (kth[:, None] / q_norm[:, None] / x_norm[None, :])
    limit[np.isnan(limit)] = np.inf
    partial, racing = np.zeros((len(q), len(x))), qid[:, None] != xid[None, :]
    seen, i, j = 0, None, None
    for c, (own, asked) in zip(blocks, lengths, strict=True):
        seen += c.stop - c.start
        factor = seen / d * (1.0 if seen == d else (1 + EPSILON / np.sqrt(seen)) ** 2)
        if i is None:
            partial += own[None, :] + asked[:, None] - 2 * (at_q[:, c] @ turned[:, c].T)
            racing &= partial <= limit * factor
            if racing.mean() < 0.15:
                i, j = np.nonzero(racing)
                partial, limit = partial[i, j], limit[i, j]
        else:
            partial += own[j] + asked[i] - 2 * np.einsum("nd,nd->n", at_q[i, c], turned[j, c])
            going = partial <= limit * factor
            i, j, partial, limit = i[going], j[going], partial[going], limit[going]
    if i is None:
        i, j = np.nonzero(racing)
    score = (x[j] * q[i]).sum(1)
    order = np.lexsort((xid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], score[rank < k], len(i)


def _units(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Rows by group, with the part they belong to (by hash) and a copy for each part of the other side."""
    per = rows.join(F.broadcast(sizes), "group")
    return per.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(f"n_{own}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_part", "n_turn")


def search(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest found of each row that ``is_query`` (a condition on
    vec_id) holds for, among all other rows; all candidates where there are fewer.

    Score is the inner product in double precision; ties go to the smaller vec_id. A list that holds many vectors (a
    vector repeated at will) or is probed by many queries is cut into units of bounded size. Rows that repeat an id are
    one query, by the vector that comes first in order, and candidates each for the queries of other ids. Rows that take
    no part give no rows; so does an empty table.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    v = written(usable(vectors, key, embedding), "ann-vectors")
    total = v.count()
    kind = v.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index = fit(v, total)
    base = written(_dealt(v, index), "ann-lists")
    index = _measured(index, base, total)
    queries = v.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(_asking(queries.withColumn("kth", F.lit(float("-inf"))), index, True), "ann-probes")
    first = written(_scanned(asked, base, index, k, schema, True), "ann-first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    known = asked.drop("kth").join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), "lists")
    rest = written(_asking(known, index, False), "ann-rest")
    found = first.unionByName(_scanned(rest, base, index, k, schema, False))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanned(asked: DataFrame, base: DataFrame, index: Index, k: int, schema: str, first: bool) -> DataFrame:
    """The ``k`` best of each query within each unit of the groups it reads: query_id, vec_id and score. Of a unit's lists
    the ``first`` time those named for the query are scanned, then the others whose bound reaches kth, which rises with
    what the unit has given."""
    spark = asked.sparkSession
    per = asked.select("vec_id", "v", "kth", "lists", F.explode("groups").alias("group"))
    sizes = [(r["group"], int(index.parts[r["group"]]), -(-r["n"] // UNIT_QUERIES)) for r in per.groupBy("group").agg(F.count("*").alias("n")).collect()]
    sizes = spark.createDataFrame(sizes, "group int, n_part int, n_turn int")
    of = spark.createDataFrame(list(enumerate(index.groups.tolist())), "list int, group int")
    left, right = _units(per, sizes, "turn", "part"), _units(base.select("vec_id", "v", "list").join(F.broadcast(of), "list"), sizes, "part", "turn")

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, xs = queries["vec_id"], rows["vec_id"]
        none = pa.table({"query_id": ids[:0], "vec_id": ids[:0], "score": pa.array([], pa.float64())})
        if not len(ids) or not len(xs):
            return none
        q, x = _matrix(queries["v"].combine_chunks()), _matrix(rows["v"].combine_chunks())
        qid, kth, xid, of = ids.to_numpy(), queries["kth"].to_numpy().copy(), xs.to_numpy(), rows["list"].to_numpy()
        bounds, top, found = _bounds(q, index), np.full((len(q), k), -np.inf), []
        named = _chosen(queries["lists"].to_pylist(), index)
        for one in np.unique(of):
            asks, own = np.nonzero(named[:, one] if first else _reaching(bounds[:, [one]], kth)[:, 0] & ~named[:, one])[0], np.nonzero(of == one)[0]
            if not len(asks):
                continue
            step = max(64, (1 << 18) // len(own))
            for a in range(0, len(asks), step):
                some = asks[a : a + step]
                i, j, score, _ = scan(qid[some], q[some], kth[some], xid[own], x[own], index.rotation, k)
                found.append((some[i], own[j], score))
                new = np.full((len(some), k), -np.inf)
                new[i, np.arange(len(i)) - np.searchsorted(i, i)] = score
                top[some] = np.partition(np.concatenate([top[some], new], 1), k, axis=1)[:, k:]
                kth[some] = np.maximum(kth[some], top[some].min(1))
        if not found:
            return none
        i, j, score = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((xid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pa.table({"query_id": qid[i[best]], "vec_id": xid[j[best]], "score": score[best]})

    keys = ["group", "part", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
