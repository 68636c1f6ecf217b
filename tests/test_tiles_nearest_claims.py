"""Tiles against whole rasters, nearest anchors and claims against brute force."""

import random

import numpy as np
import pytest

from quireframe.functions import rasters as W
from quireframe.operators import graph as G
from quireframe.operators import nearest as N
from quireframe.operators import structure as C
from quireframe.operators import text as X
from quireframe.operators import tiles as P


def brute(points, anchors):
    out = []
    for key, x, i in points:
        found = min(((abs(x - a), p) for k, a, p in anchors if k == key and a is not None and p is not None), default=(None, None)) if x is not None else (None, None)
        out.append((key, x, i, found[1], found[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("of", [["k"], []])
def test_nearest(spark, of):
    r = random.Random(5)
    keys = ["a"] * 6 + ["b", "c", None] if of else [None]
    points = [(r.choice(keys), r.choice([None, *map(float, range(40))]), i) for i in range(600)] + [("lonely" if of else None, 1.0, -1)]
    anchors = [(r.choice(keys), r.choice([None, *[v / 2 for v in range(60)]]), r.choice([None, *range(90)])) for _ in range(120)]
    p, a = spark.createDataFrame(points, "k string, x double, i int"), spark.createDataFrame(anchors, "k string, x double, place int")
    got = N.nearest(p, a, of, "x", "place")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(points, anchors)
    none = N.nearest(p, a.limit(0), of, "x", "place")
    assert none.count() == len(points) and none.filter("nearest IS NOT NULL OR distance IS NOT NULL").count() == 0
    assert N.nearest(p.limit(0), a, of, "x", "place").count() == 0


def test_nearest_of_many_in_one_group_and_names(spark):
    p = spark.range(40_000).selectExpr("id % 1000 / 10D AS x", "id AS _k0", "1 AS _p")
    a = spark.range(3_000).selectExpr("id * 7D AS x", "id AS place")
    got = N.nearest(p, a, [], "x", "place")
    assert got.columns == ["x", "_k0", "_p", "nearest", "distance"]
    assert got.count() == 40_000 and got.filter("abs(x - nearest * 7) <> distance OR distance > 3.5").count() == 0
    with pytest.raises(ValueError):
        N.nearest(p.withColumnRenamed("_p", "nearest"), a, [], "x", "place")


def rasters(spark, arrays, tile):
    lines = [(k, v.shape[1], v.shape[0], y, bytearray(v[y].tobytes())) for k, v in arrays.items() for y in range(v.shape[0])]
    return P.tiles_of_lines(spark.createDataFrame(lines, "raster int, width int, height int, y int, pixels binary"), tile).cache()


def whole(tiles, tile):
    out = {}
    for r in P.lines_of_tiles(tiles, tile).orderBy("raster", "y").collect():
        out.setdefault(r["raster"], []).append(np.frombuffer(r["pixels"], np.uint8).reshape(-1, 4))
    return {k: np.stack(v) for k, v in out.items()}


SIZES = {1: (70, 45), 2: (32, 32), 3: (1, 100), 4: (64, 33)}


@pytest.fixture(scope="module")
def sides(spark):
    g = np.random.default_rng(3)
    a = {k: g.integers(0, 256, (h, w, 4), dtype=np.uint8) for k, (h, w) in SIZES.items()}
    b = {k: v.copy() for k, v in a.items()}
    b[1][50:60, 20:40] = 9
    b[2] = g.integers(0, 256, (40, 20, 4), dtype=np.uint8)
    b[5] = a[1]
    return a, b, rasters(spark, a, 32), rasters(spark, b, 32)


def test_tiles_round_trip(sides):
    a, _, ta, _ = sides
    back = whole(ta, 32)
    assert back.keys() == a.keys() and all((back[k] == a[k]).all() for k in a)


def test_tiles_against_whole_rasters(sides):
    a, b, ta, tb = sides
    got = {r["raster"]: r.asDict() for r in P.tile_difference(ta, tb, 32).collect()}
    assert got.keys() == {1, 2, 3, 4}
    for k, r in got.items():
        want = W.difference(W._raster(a[k]), W._raster(b[k]))
        assert {n: v for n, v in r.items() if n != "raster"} == pytest.approx(want)
    over = whole(P.tile_overlay(ta, tb, 0.5, 32), 32)
    assert over.keys() == {1, 3, 4}
    for k, v in over.items():
        assert (v == W._pixels(W.overlay(W._raster(a[k]), W._raster(b[k]), 0.5))).all()
    for preset in ("bilevel", "document"):
        clean = whole(P.tile_cleanup(ta, preset, 32), 32)
        assert all((clean[k] == W._pixels(W.cleaned(W._raster(a[k]), preset))).all() for k in a)
    with pytest.raises(ValueError):
        P.tile_cleanup(ta, "other")


def test_redacted_tiles(spark, sides):
    a, _, ta, _ = sides
    boxes = {1: [(10, 20, 45, 66), (-5, 60, 12, 900), (10, 20, 45, 66)], 2: [(0, 0, 0, 9)], 3: [(30, 0, 70, 1)], 4: []}
    after = {k: v.copy() for k, v in a.items()}
    for k in (1, 3):
        for left, top, right, bottom in boxes[k]:
            after[k][max(top, 0) : bottom, max(left, 0) : right] = (0, 0, 0, 255)
    after[3][0, 31], after[3][0, 5] = 7, 255 - a[3][0, 5]
    after[2] = after[2][:20]
    rows = spark.createDataFrame([(k, *b) for k, v in boxes.items() for b in v], "raster int, left int, top int, right int, bottom int")
    got = {r["raster"]: tuple(r)[1:] for r in P.tile_redactions(ta, rasters(spark, after, 32), rows, 32).collect()}
    assert got == {1: (0, 0, True), 2: (-1, -1, False), 3: (1, 1, False), 4: (0, 0, True)}


def test_rasters_of_many_tiles(spark):
    """A thousand lines of a thousand pixels, in tiles of 256."""
    lines = spark.range(1000).selectExpr("1 AS raster", "1000 AS width", "1000 AS height", "id AS y", "unhex(repeat(lpad(hex(id % 251), 2, '0') || '0000FF', 1000)) AS pixels")
    other = lines.selectExpr("raster", "width", "height", "y", "CASE WHEN y % 10 = 0 THEN unhex(repeat('000000FF', 1000)) ELSE pixels END AS pixels")
    tiles = P.tiles_of_lines(lines)
    assert tiles.count() == 16 and tiles.selectExpr("max(length(pixels))").first()[0] == 4 * 256 * 256
    d = P.tile_difference(tiles, P.tiles_of_lines(other)).first()
    changed = [y % 251 for y in range(0, 1000, 10) if y % 251]
    assert (d["changed"], d["compared"], d["max_delta"], d["mismatch"]) == (1000 * len(changed), 10**6, max(changed), False)
    assert d["mean_delta"] == pytest.approx(sum(changed) / 1000)


DOCS = [(1, "The pump is red. Pumps fail when valves leak! A valve leak costs money."), (2, "Nothing here."), (3, None), (4, ""), (5, "Valve. Valve leak. Leak valve."), (6, "the of and")]
CLAIMS = [(1, "a valve leak"), (2, "the of"), (3, None), (4, "Nothing, nothing at all here"), (5, "unheard")]


def expected():
    import re

    out = {}
    words = lambda t: [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s.-]", " ", t.lower())) if w]
    for d, text in DOCS:
        sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
        for c, claim in CLAIMS:
            q = {w for w in words(claim or "") if w not in X.STOP_WORDS}
            scores = [(sum(w in q for w in words(s)), -i) for i, s in enumerate(sents)]
            if scores and max(scores)[0]:
                n, i = max(scores)
                out[d, c] = (sents[-i], min(1.0, n / len(q)), n)
    return out


@pytest.mark.parametrize(("in_rows", "listed"), [(64, 1_000), (0, 1_000), (0, 0)])
def test_claims(spark, monkeypatch, in_rows, listed):
    monkeypatch.setattr(C, "IN_ROWS", in_rows)
    monkeypatch.setattr(C, "LISTED_TERMS", listed)
    docs, claims = spark.createDataFrame(DOCS, "doc_id int, text string"), spark.createDataFrame(CLAIMS, "claim_id int, claim string")
    want = expected()
    found = C.citations(docs, claims)
    assert {(r["doc_id"], r["claim_id"]): (r["quote"], r["confidence"]) for r in found.collect()} == {k: v[:2] for k, v in want.items()}
    every = C.unquoted(docs, claims, found).collect()
    assert len(every) == len(DOCS) * len(CLAIMS) and {(r["doc_id"], r["claim_id"]) for r in every if r["quote"]} == want.keys()
    best = {}
    for (d, c), (quote, confidence, n) in sorted(want.items()):
        if c not in best or n > best[c][3]:
            best[c] = (d, quote, confidence, n)
    got = {r["claim_id"]: (r["doc_id"], r["quote"], r["confidence"]) for r in C.best_sources(docs, claims).collect()}
    assert got == {c: v[:3] for c, v in best.items()}
    assert C.best_sources(docs, claims.limit(0)).count() == 0 and C.citations(docs.limit(0), claims).count() == 0


def test_more_claims_than_a_plan_could_hold(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('Word', id, ' is here. Other text follows.') AS text")
    claims = spark.range(2_000).selectExpr("id AS claim_id", "concat('word', id % 100) AS claim")
    rows = C.citations(docs, claims)
    assert rows.count() == 1_000 and rows.filter("quote <> concat('Word', doc_id, ' is here.') OR confidence <> 1").count() == 0


def test_parents_that_come_late(spark):
    rows = [(1, 1, 1, 0), (2, 2, 1, 1), (3, 2, 2, 1), (4, 1, 2, 0), (5, 1, 3, 0), (6, 1, 3, 0), (7, 2, 3, 1), (8, 2, 9, 9)]
    df = spark.createDataFrame(rows, "at int, level int, p int, q int")
    found = lambda **k: sorted((r["at"], r["code"]) for r in G.missing_parents(df, ["p", "q"], "level", **k).collect())
    assert found() == [(5, "repeated"), (6, "repeated"), (8, "orphan")]
    assert found(order="at") == [(3, "late"), *found()]
