"""Registered queries of scalar functions and rule engines, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import values as V
from quireframe.operators import graph as G
from quireframe.operators import inventory as I
from quireframe.operators import records as R
from quireframe.operators import rules as P
from quireframe.plans.queries import _firsts, _t, query

_FT = 0.3048


def _points(*xy: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in xy])


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    for name in tables:
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


@query("SELECT p_partkey, round(sqrt(p_size * p_size + p_retailprice * p_retailprice) + p_size, 6) AS way, round(p_size * 0.3048 / 72, 12) AS scale, CASE WHEN p_size % 2 = 0 THEN round(p_size * 0.0254 / p_retailprice, 12) END AS other FROM part")
def polyline_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, zero = F.col("p_size"), F.col("p_retailprice"), F.lit(0.0)
    unit = F.when(w % 2 == 0, "in").otherwise("mile")
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(V.polyline(_points((zero, zero), (w, h), (zero, h))), 6).alias("way"), F.round(V.metres_per_point(w.cast("double"), F.lit("ft"), F.lit(72.0)), 12).alias("scale"), F.round(V.metres_per_point(w.cast("double"), unit, h), 12).alias("other"))


_QUANTITY = "CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN (2 * p_size + 10) * 0.004 WHEN 2 THEN (2 * p_size + 20) * 0.004 ELSE p_size * 10 * 0.004 * 0.004 END"


@query(f"""SELECT p_partkey, round({_QUANTITY}, 9) AS si, round(CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 3 THEN {_QUANTITY} / {_FT} / {_FT} ELSE {_QUANTITY} / {_FT} END, 9) AS shown FROM part""".replace("AS si,", "::DOUBLE AS si,").replace("AS shown", "::DOUBLE AS shown"))
def measured_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w, h, zero = F.col("p_partkey") % 4, F.col("p_size"), F.lit(10), F.lit(0)
    kind = F.get(F.array(*[F.lit(x) for x in ("count", "distance", "perimeter", "area")]), k)
    unit = F.get(F.array(*[F.lit(x) for x in ("count", "ft", "ft", "ft2")]), k)
    si = V.quantity(kind, _points((zero, zero), (w, zero), (w, h), (zero, h)), F.lit(0.004))
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(si, 9).alias("si"), F.round(V.displayed(si, unit), 9).alias("shown"))


def _turn_sql(a: str, b: str, c: str) -> str:
    return f"sign(({b}y - {a}y) * ({c}x - {b}x) - ({b}x - {a}x) * ({c}y - {b}y))"


def _on_sql(a: str, b: str, c: str) -> str:
    """Whether b, which lies on the line through a and c, lies between them."""
    return f"({_turn_sql(a, c, b)} = 0 AND {b}x BETWEEN least({a}x, {c}x) AND greatest({a}x, {c}x) AND {b}y BETWEEN least({a}y, {c}y) AND greatest({a}y, {c}y))"


_MEET_SQL = f"({_turn_sql('u.p', 'u.q', 'v.p')} <> {_turn_sql('u.p', 'u.q', 'v.q')} AND {_turn_sql('v.p', 'v.q', 'u.p')} <> {_turn_sql('v.p', 'v.q', 'u.q')}) OR {_on_sql('u.p', 'v.p', 'u.q')} OR {_on_sql('u.p', 'v.q', 'u.q')} OR {_on_sql('v.p', 'u.p', 'v.q')} OR {_on_sql('v.p', 'u.q', 'v.q')}"
_CORNER = "floor(l_quantity / 10)::DOUBLE AS x, (l_partkey % 5 * (l_orderkey % 3))::DOUBLE AS y"


@query(f"""WITH p AS (SELECT l_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, x, y, lag(x) OVER w = x AND lag(y) OVER w = y AS again FROM (SELECT l_orderkey, l_linenumber, {_CORNER} FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y)),
s AS (SELECT a.l_orderkey, a.i, a.n, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND b.i = (a.i + 1) % a.n),
c AS (SELECT DISTINCT u.l_orderkey FROM s u JOIN s v ON u.l_orderkey = v.l_orderkey AND v.i > u.i + 1 AND (v.i + 1) % u.n <> u.i WHERE {_MEET_SQL}),
f AS (SELECT l_orderkey, count(DISTINCT (x, y)) < 3 OR coalesce(bool_or(again), false) AS few FROM p GROUP BY 1), a AS (SELECT l_orderkey, abs(sum(px * qy - qx * py)) / 2 AS area FROM s GROUP BY 1)
SELECT f.l_orderkey, CASE WHEN few THEN 'degenerate' WHEN c.l_orderkey IS NOT NULL THEN 'self-intersecting' WHEN area <= 1e-9 THEN 'degenerate' END AS fault FROM f JOIN a USING (l_orderkey) LEFT JOIN c USING (l_orderkey)""")
def polygon_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as polygons with a corner for each line, on a coarse grid, so that corners repeat, lie on a line and sides cross."""
    corner = F.struct("l_linenumber", F.floor(F.col("l_quantity") / 10).cast("double").alias("x"), (F.col("l_partkey") % 5 * (F.col("l_orderkey") % 3)).cast("double").alias("y"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(corner)).alias("p"))
    rows = rows.withColumn("p", F.transform("p", lambda c: F.struct(c["x"], c["y"])))
    return rows.select("l_orderkey", V.polygon_fault(F.col("p")).alias("fault"))


@query("""WITH e AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, a.l_quantity AS ax, 10 - a.l_linenumber AS ay, b.l_quantity AS bx, b.l_linenumber * 2 AS by_ FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, i, j, NOT (ax < bx) AS meet FROM e""")
def segment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments of an order: one from the left edge to its quantity, one upright at its own quantity."""
    a = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("ax"))
    b = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("bx"))
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, y = F.lit(0), F.col("i")
    meet = V.segments_meet(p(zero, y), p(F.col("ax"), y), p(F.col("bx"), zero - 1), p(F.col("bx"), F.lit(100)))
    return a.join(b, "l_orderkey").filter("i < j").select("l_orderkey", "i", "j", meet.alias("meet"))


@query("SELECT p_partkey, (100 - p_size * 2)::DOUBLE AS x, (200 + p_partkey * 2)::DOUBLE AS y FROM part")
def page_to_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.page_to_geo(F.col("p_partkey").cast("double"), F.col("p_size").cast("double"), F.lit(100.0), F.lit(200.0), F.lit(2.0), F.lit(90.0))
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(g["x"], 6).alias("x"), F.round(g["y"], 6).alias("y"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice + p_size WHEN 1 THEN p_retailprice - p_size WHEN 2 THEN p_retailprice * p_size WHEN 3 THEN p_retailprice / nullif(p_size - 7, 0) END AS result FROM part")
def form_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    op = F.get(F.array(*[F.lit(x) for x in ("add", "subtract", "multiply", "divide", "power")]), k)
    b = F.when(k == 3, F.col("p_size") - 7).otherwise(F.col("p_size")).cast("double")
    return _t(spark, sf_dir, "part").select("p_partkey", V.calculated(op, F.col("p_retailprice"), b).alias("result"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 9 AND 25 THEN floor(p_size * 8 + 0.5)::INT WHEN p_size BETWEEN 26 AND 50 THEN p_size * 8 END::INT AS dpi, round(0.1 + p_size / 100.0 * 0.5, 9) AS x, greatest(1, floor(p_size * 0.05 + 0.5))::INT AS crop_width FROM part")
def raster_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    zone = F.struct(F.lit(0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("width"), F.lit(1.0).alias("height"))
    narrow = F.struct(F.lit(0.05).alias("width"), F.lit(1.0).alias("height"))
    box = V.in_zone(s, F.lit(0), s, s, F.lit(100), F.lit(100), zone)
    return _t(spark, sf_dir, "part").select("p_partkey", V.raster_dpi(s * 8, s * 8, F.lit(72.0), F.lit(72.0)).alias("dpi"), F.round(box["x"], 9).alias("x"), V.crop_size(s, s, narrow)["width"].alias("crop_width"))


@query("SELECT p_partkey, p_size % 3 <> 2 AS matching, p_size <= 20 AND p_partkey % 2 = 0 AS held FROM part")
def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda l, r: F.struct(F.lit(0.0).alias("left"), l.alias("bottom"), r.alias("right"), F.lit(9.0).alias("top"))
    s, off = F.col("p_size").cast("double"), F.get(F.array(F.lit(0.0), F.lit(0.005), F.lit(0.02)), F.col("p_size") % 3)
    outer = F.when(F.col("p_partkey") % 2 == 0, box(F.lit(0.0), F.lit(20.0)))
    return _t(spark, sf_dir, "part").select("p_partkey", V.boxes_match(box(s, s), box(s + off, s)).alias("matching"), V.box_holds(outer, box(F.lit(1.0), s)).alias("held"))


@query("SELECT p_partkey, try_cast(t AS DATE) AS day, CASE WHEN p_size % 2 = 0 THEN p_size > 20 ELSE false END AS open, CASE WHEN p_size > 5 THEN DATE '2026-01-01' + (p_size - 5) * 700 END AS until FROM (SELECT *, '2023-' || lpad((p_partkey % 14)::VARCHAR, 2, '0') || '-' || lpad((p_size % 33)::VARCHAR, 2, '0') AS t FROM part)".replace("(p_size - 5) * 700 END", "((p_size - 5) * 700)::INT END"))
def calendar_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("2023-"), F.lpad((F.col("p_partkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("p_size") % 33).cast("string"), 2, "0"))
    moment = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("2026-03-"), F.lit(""), F.lpad(F.least(F.col("p_size"), F.lit(31)).cast("string"), 2, "0"), F.lit("T00:00:00Z"))).otherwise("never")
    until = V.retained_until(F.to_date(F.lit("2026-01-01")), F.when((F.col("p_size") - 5) * 700 <= 36_500, (F.col("p_size") - 5) * 700))
    return _t(spark, sf_dir, "part").select("p_partkey", V.calendar_date(text).alias("day"), V.expires_later(moment, F.to_timestamp(F.lit("2026-03-20T00:00:00Z"))).alias("open"), until.alias("until"))


_HEX = "sha256(p_name)"


@query(f"SELECT p_partkey, substr(sha256(p_partkey || '|' || p_brand), 1, 24) AS id, 'uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT *, {_HEX} AS h FROM part)")
def short_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", V.short_id(F.col("p_partkey").cast("string"), "p_brand").alias("id"), V.recipe_uuid(F.col("p_name")).alias("uuid"))


@query("""SELECT p_partkey, c AS canonical, sha256(c) AS digest FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN '{"a":' || CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size / 2)::VARCHAR END || ',"b":[' || p_partkey || ',null,true],"é":{"x":"' || p_brand || '","y":1e+21}}' END AS c FROM part)""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.col("p_partkey") % 7 == 0, "NaN").otherwise((F.col("p_size") / 2).cast("string"))
    text = F.concat(F.lit('{ "é": {"y": 1000000000000000000000.0, "x": "'), "p_brand", F.lit('"}, "b": ['), F.col("p_partkey").cast("string"), F.lit(', null, true], "a": '), half, F.lit("}"))
    return _t(spark, sf_dir, "part").select("p_partkey", V.canonical(text).alias("canonical"), V.provenance(text).alias("digest"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'malformed' WHEN 1 THEN 'unsafe-key' WHEN 2 THEN 'secret-key' WHEN 3 THEN 'path-value' WHEN 4 THEN 'too-deep' END AS fault FROM part")
def json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = F.concat(F.repeat(F.lit("["), 9), F.lit("1"), F.repeat(F.lit("]"), 9))
    texts = F.array(F.concat(F.lit('{"n": '), "p_name"), F.lit('{"a": {"Prototype": 1}}'), F.concat(F.lit('[{"Api_Key": "'), "p_brand", F.lit('"}]')), F.lit('{"a": "../x"}'), deep, F.lit('{"name": "a/b"}'))
    return _t(spark, sf_dir, "part").select("p_partkey", V.json_fault(F.get(texts, F.col("p_partkey") % 6)).alias("fault"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events WHERE event_type = 'click'")
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return I.selected(_t(spark, sf_dir, "events"), event_type="click").select("event_id", v.alias("k"))


@query("SELECT p_partkey, p_size % 3 = 1 AS dense, CASE WHEN p_partkey % 2 = 0 THEN 'brand=' || p_brand ELSE '' END AS kept, CASE WHEN p_size % 2 = 0 THEN 'Brand_' || substr(p_brand, 7) ELSE 'file' END AS name FROM part")
def array_and_map_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    values = F.when(s % 3 == 0, F.array(s, s)).when(s % 3 == 1, F.array(s, s + 1)).otherwise(F.array(s, F.lit(None).cast("int")))
    props = F.create_map(F.lit("brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.lit("other"), F.col("p_name"), F.lit("long"), F.repeat(F.lit("x"), 99))
    kept = V.allowed_properties(props, ["brand", "long"], 20)
    shown = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    name = V.safe_name(F.when(s % 2 == 0, F.concat(F.lit("##"), "p_brand", F.lit("!"))).otherwise("***"))
    return _t(spark, sf_dir, "part").select("p_partkey", V.dense(values, 1, 3).alias("dense"), shown.alias("kept"), name.alias("name"))


# --- rule engines over documents made of orders and their lines ---

_DOCS = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' END AS encrypted, CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '?' ELSE 'no' END AS javascript, o_orderkey % 4 = 0 AS truncated, o_orderkey % 2 = 0 AS xmp FROM orders"
_LINES = "SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 4 = 0 THEN 'no' ELSE 'yes' END AS embedded, CAST(l_quantity AS INT) - 2 AS width, 5 AS height, 8 AS bits, CASE WHEN l_tax < 0.08 THEN l_quantity * 20 END AS x_ppi, 300.0 AS y_ppi FROM lineitem WHERE l_linenumber <= 2 OR l_linenumber = 4"
_PROFILE = f"""WITH d AS ({_DOCS}), l AS ({_LINES}), g AS (SELECT doc_id, count_if(embedded <> 'yes') AS u, count_if(width < 1) AS bad, count_if(x_ppi IS NOT NULL AND least(x_ppi, y_ppi) < 150) AS low, count_if(x_ppi IS NULL) AS dark, count(DISTINCT width) AS sizes, count_if(width > 30) AS outside, count_if(width <= 30 AND width % 2 = 0) AS lacking FROM l GROUP BY 1),
j AS (SELECT d.*, coalesce(u, 0) AS u, coalesce(bad, 0) AS bad, coalesce(low, 0) AS low, coalesce(dark, 0) AS dark, coalesce(sizes, 0) AS sizes, coalesce(outside, 0) AS outside, coalesce(lacking, 0) AS lacking FROM d LEFT JOIN g USING (doc_id))"""
_FLAG = lambda c, bad: f"CASE lower(trim({c})) WHEN 'no' THEN 'pass' WHEN 'yes' THEN '{bad}' ELSE 'not-checked' END"
_PRINT = {
    "document.encryption": _FLAG("encrypted", "warning"), "document.javascript": _FLAG("javascript", "fail"), "fonts.embedding": "CASE WHEN u > 0 THEN 'fail' ELSE 'pass' END", "pages.geometry-consistency": "CASE WHEN sizes > 1 THEN 'warning' ELSE 'pass' END",
    "pages.production-boxes": "CASE WHEN outside > 0 THEN 'fail' WHEN lacking > 0 THEN 'warning' ELSE 'pass' END", "pages.inspection-range": "CASE WHEN truncated THEN 'not-checked' ELSE 'pass' END", "images.inventory": "CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END",
    "images.effective-resolution": "CASE WHEN low > 0 THEN 'warning' WHEN dark > 0 THEN 'not-checked' ELSE 'pass' END", "color.output-intent": "'not-checked'", "color.spot-and-overprint-semantics": "'not-checked'",
}
_ARCHIVE = {k: _PRINT[k] for k in ("document.javascript", "fonts.embedding", "pages.geometry-consistency", "pages.inspection-range", "color.output-intent")} | {"document.encryption": _FLAG("encrypted", "fail"), "metadata.xmp": "CASE WHEN xmp THEN 'pass' ELSE 'fail' END"}
_AS_ROWS = lambda checks: " UNION ALL ".join(f"SELECT doc_id, '{k}' AS \"check\", {v} AS status FROM j" for k, v in checks.items())


def _profile(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    d, lines = _sql(spark, sf_dir, _DOCS, "orders"), _sql(spark, sf_dir, _LINES, "lineitem")
    box = lambda r: F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("bottom"), r.cast("double").alias("right"), F.lit(9.0).alias("top"))
    w = F.col("width")
    lacks = (w <= 30) & (w % 2 == 0)
    pages = lines.select("doc_id", "width", "height", box(F.lit(100)).alias("media_box"), F.when(~lacks, box(F.lit(50))).alias("bleed_box"), box(F.when(w > 30, 60).otherwise(40)).alias("trim_box"))
    return P.preflight(d, lines, lines, pages, name)


@query(f"{_PROFILE} {_AS_ROWS(_PRINT)}")
def print_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "print-review")


@query(f"{_PROFILE} {_AS_ROWS(_ARCHIVE)}")
def archive_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "archive-review")


@query(f"""{_PROFILE}, c AS ({_AS_ROWS(_PRINT)}), n AS (SELECT doc_id, count_if(status = 'pass')::BIGINT AS pass, count_if(status = 'warning')::BIGINT AS warning, count_if(status = 'fail')::BIGINT AS fail, count_if(status = 'not-checked')::BIGINT AS not_checked FROM c GROUP BY 1)
SELECT *, CASE WHEN fail > 0 THEN 'fail' WHEN warning > 0 OR not_checked > 0 THEN 'review-required' ELSE 'pass' END AS verdict FROM n""")
def print_review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rolled_up(_profile(spark, sf_dir, "print-review"))


#: Tag lines of a document: its lines in order, roles and depths by what they hold.
_TAGS = "SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 6 WHEN 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN 3 ELSE 2 END ELSE 2 END AS depth, CASE l_linenumber WHEN 1 THEN 'Document' WHEN 2 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'Table (x)' ELSE 'L' END WHEN 3 THEN 'LI' WHEN 4 THEN 'LBody \"a\"' WHEN 5 THEN 'H' || (l_suppkey % 3 + 1) WHEN 6 THEN 'H2' ELSE 'My-Role' END AS value FROM lineitem"


#: The same rule in SQL: the table's rows are numbered as they come, by file and by row, and the first of those that share document and place counts.
_FIRST_TAGS = _TAGS.replace("FROM lineitem", "FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER () AS place FROM lineitem) ORDER BY l_orderkey, l_linenumber, place)")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines that share document and place the first of the table counts, by file and by row."""
    _firsts(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"], "l_suppkey").createOrReplaceTempView("tagged_lines")
    return spark.sql(_TAGS.replace("FROM lineitem", "FROM tagged_lines"))


_SUMMARY = f"""WITH t AS ({_FIRST_TAGS}), r AS (SELECT *, regexp_extract(value, '^([A-Za-z][A-Za-z0-9]*)(?:\\s|\\(|$)', 1) AS raw, CASE WHEN depth % 2 = 0 THEN depth ELSE 0 END AS d FROM t),
k AS (SELECT *, CASE WHEN raw IN ({", ".join(f"'{x}'" for x in P.TAG_ROLES)}) THEN raw END AS role, lag(d) OVER w AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
h AS (SELECT *, CASE WHEN regexp_matches(role, '^H[1-6]$') THEN substr(role, 2)::INT END AS lv, depth % 2 <> 0 OR CASE WHEN b IS NULL THEN d <> 0 ELSE d > b AND d <> b + 2 END AS fault FROM k),
p AS (SELECT h.*, (SELECT arg_max(coalesce(q.role, '?'), q.seq) FROM k q WHERE q.doc_id = h.doc_id AND q.seq < h.seq AND q.d < h.d) AS above, last_value(lv IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT doc_id, count(*) AS records, count_if(role IS NULL)::BIGINT AS unknown_roles, count_if(fault)::BIGINT AS bad_steps, count_if(lv IS NOT NULL)::BIGINT AS headings, bool_or(coalesce(CASE WHEN before IS NULL THEN lv <> 1 ELSE lv > before + 1 END, false)) AS skips,
count_if(coalesce(role = 'LI' AND above NOT IN ('L', '?') OR role IN ('Lbl', 'LBody') AND above NOT IN ('LI', '?'), false))::BIGINT AS list_parents, count_if(coalesce(role IN ('LI', 'Lbl', 'LBody') AND coalesce(above, '?') = '?', false))::BIGINT AS list_unknown, count_if(role IS NULL) = 0 AND count_if(fault) = 0 AS complete FROM p GROUP BY 1"""


@query(_SUMMARY)
def tag_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tag_summary(_tags(spark, sf_dir)).select("doc_id", "records", "unknown_roles", "bad_steps", "headings", "skips", "list_parents", "list_unknown", "complete")


@query(f"""WITH t AS ({_FIRST_TAGS}), r AS (SELECT doc_id, regexp_extract(value, '^([A-Za-z][A-Za-z0-9]*)(?:\\s|\\(|$)', 1) AS raw FROM t)
SELECT doc_id, CASE WHEN raw IN ({", ".join(f"'{x}'" for x in P.TAG_ROLES)}) THEN raw END AS role, count(*) AS n FROM r GROUP BY 1, 2""")
def tag_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tag_roles(_tags(spark, sf_dir))


@query(f"""WITH t AS ({_FIRST_TAGS}), k AS (SELECT *, lag(CASE WHEN depth % 2 = 0 THEN depth ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM t)
SELECT doc_id, seq FROM k WHERE depth % 2 <> 0 OR CASE WHEN b IS NULL THEN depth <> 0 ELSE depth > b AND depth <> b + 2 END""")
def depth_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.depth_faults(_tags(spark, sf_dir), "doc_id", "seq", "depth").select("doc_id", "seq")


_ACCESS = {
    "tagged-indicator": "CASE WHEN tagged THEN 'pass' ELSE 'fail' END", "tag-structure-listing": "CASE WHEN records > 0 THEN 'pass' ELSE 'fail' END",
    "tag-role-inventory": "CASE WHEN NOT tagged OR records = 0 THEN 'not-checked' WHEN complete THEN 'pass' ELSE 'warning' END",
    "heading-role-sequence": "CASE WHEN headings = 0 THEN 'not-checked' WHEN skips THEN 'warning' WHEN complete THEN 'pass' ELSE 'not-checked' END",
    "document-title": "CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'pass' END", "document-language": "CASE WHEN doc_id % 7 = 0 THEN 'warning' ELSE 'pass' END",
    "font-embedding": "CASE WHEN u > 0 THEN 'fail' WHEN fonts > 0 THEN 'pass' ELSE 'not-checked' END", "font-tounicode": "CASE WHEN fonts > 0 THEN 'pass' ELSE 'not-checked' END",
    "empty-extracted-text-pages": "CASE WHEN empty > 0 THEN 'warning' ELSE 'pass' END", "form-semantics": "CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'not-checked' END", "screen-reader-permissions": "CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'not-checked' END",
    **{k: "'not-checked'" for k in ("image-alt-text", "artifact-classification", "reading-order", "link-bookmark-semantics", "contrast", "pdf-ua-conformance")},
}


@query(f"""WITH s AS ({_SUMMARY}), l AS (SELECT l_orderkey AS doc_id, count(*) AS fonts, count_if(l_linenumber % 4 = 0) AS u, count_if(l_linenumber = 6) AS empty FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 <> 0 AS tagged, coalesce(records, 0) AS records, coalesce(complete, false) AS complete, coalesce(headings, 0) AS headings, coalesce(skips, false) AS skips, coalesce(fonts, 0) AS fonts, coalesce(u, 0) AS u, coalesce(empty, 0) AS empty FROM orders LEFT JOIN s ON s.doc_id = o_orderkey LEFT JOIN l ON l.doc_id = o_orderkey)
{_AS_ROWS(_ACCESS)}""")
def accessibility_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks but the shapes of lists and tables, which ``tag_summaries`` counts."""
    k = F.col("o_orderkey")
    d = _t(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(k % 5 != 0, "yes").alias("tagged"), F.when(k % 3 != 0, "T").otherwise(" ").alias("title"), F.when(k % 7 != 0, "en").alias("language"), F.when(k % 2 == 0, " None").alias("form"), F.when(k % 3 != 2, k % 3 == 0).alias("content_accessible"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 4 == 0, "no").otherwise("yes").alias("embedded"), F.lit("yes").alias("unicode"), F.when(F.col("l_linenumber") != 6, "x").otherwise(" \n").alias("text"))
    return P.accessibility(d, P.tag_summary(_tags(spark, sf_dir)), lines, lines).filter(~F.col("check").isin("list-role-shape", "table-role-shape"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'de-AT' WHEN 1 THEN 'fr' WHEN 2 THEN 'es' WHEN 3 THEN 'en-GB' END AS language FROM part")
def declared_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    custom = F.when(k == 0, F.array(F.struct(F.lit("Lang").alias("name"), F.lit("not one").alias("value")), F.struct(F.lit("dc:Language").alias("name"), F.lit(" de-AT ").alias("value")))).otherwise(F.array(F.struct(F.lit("title").alias("name"), F.lit("en").alias("value"))))
    xml = F.when(k == 1, F.lit("<dc:language><rdf:Bag>\n<rdf:li> fr </rdf:li></rdf:Bag></dc:language> xml:lang='it'")).when(k == 2, F.lit("<pdf:Lang>es</pdf:Lang>")).when(k == 3, F.lit("<x xml:lang=\"en-GB\">"))
    return _t(spark, sf_dir, "part").select("p_partkey", P.declared_language(custom, xml).alias("language"))


@query("""WITH r AS (SELECT o_orderkey AS doc_id, 0 AS k, 'tagged-pdf' AS rule, 'error' AS severity, NULL::INT AS page, 0 AS ord FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1, 'document-title', 'warning', NULL, 0 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 3, 'unicode-mapping', 'error', NULL, 0 FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT l_orderkey, 5, 'empty-page', 'warning', l_linenumber, l_linenumber FROM lineitem WHERE l_tax = 0 UNION ALL SELECT l_orderkey, 6, 'image-alt-text', 'error', l_linenumber, l_linenumber FROM lineitem WHERE l_discount = 0 UNION ALL SELECT l_orderkey, 7, 'form-label', 'error', l_linenumber, l_linenumber FROM lineitem WHERE l_quantity = 1)
SELECT doc_id, 'a11y-' || row_number() OVER (PARTITION BY doc_id ORDER BY k, page NULLS FIRST, ord) AS id, rule, severity, page FROM r""")
def accessibility_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = _t(spark, sf_dir, "orders").select(k.alias("doc_id"), (k % 2 != 0).alias("tagged"), F.when(k % 3 != 0, "T").alias("title"), F.lit("en").alias("language"), F.when(k % 5 == 0, False).alias("unicode_mapped"), F.lit(True).alias("fonts_embedded"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_linenumber").alias("at"), (F.col("l_tax") == 0).alias("empty"), F.when(F.col("l_discount") != 0, "alt").alias("alt_text"), F.when(F.col("l_quantity") != 1, "label").otherwise("").alias("label"))
    return P.issues(d, lines, lines, lines)


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN true WHEN 2 THEN p_size % 3 = 0 WHEN 3 THEN true ELSE false END AS valid FROM part")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size")
    kind = F.get(F.array(*[F.lit(x) for x in ("checkbox", "number", "select", "text", "number")]), k)
    value = F.when(k == 0, F.when(s % 2 == 0, "true").otherwise("yes")).when(k == 1, F.concat(s.cast("string"), F.lit(".50"))).when(k == 2, F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), s % 3)).when(k == 3, F.col("p_name")).otherwise("NaN")
    rows = _t(spark, sf_dir, "part").select("p_partkey", kind.alias("type"), F.array(F.lit("a")).alias("options"), value.alias("value"))
    return P.field_values(rows).select("p_partkey", "valid")


@query("SELECT o_orderkey, coalesce(l_returnflag, '') AS value FROM (SELECT o_orderkey, o_orderkey AS id FROM orders) LEFT JOIN (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber = 4) ON o_orderkey = l_orderkey")
def fields_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("id"))
    values = _t(spark, sf_dir, "lineitem").filter("l_linenumber = 4").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("value"))
    return P.with_values(fields, values).select("o_orderkey", "value")


@query("SELECT DISTINCT l_orderkey + 3 AS id FROM lineitem WHERE l_orderkey + 3 NOT IN (SELECT o_orderkey FROM orders)")
def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 3).alias("id")).distinct()
    return P.unknown_values(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), values)


_PATTERNS = ("^[Pp]art[ -]?#?[0-9]*[02468]$", "a|al|almond s", "(o|on|ona){1,2} ", "^([a-e]|[c-m])[a-z]+ ")
_RULED = "SELECT p_partkey, 'name' AS field, CASE WHEN p_partkey % 6 = 0 THEN '  ' WHEN p_partkey % 10 = 5 THEN 'true' ELSE p_name END AS value, CASE WHEN p_partkey % 10 = 5 THEN 'boolean' END AS value_type, p_partkey % 12 <> 0 AS required, CASE WHEN p_partkey % 7 = 1 THEN 'boolean' WHEN p_partkey % 7 = 2 THEN 'string' END AS type, p_size % 20 AS min_length, p_size % 15 + 3 AS max_length, CASE p_size % 5 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATTERNS)) + " END AS pattern FROM part"


@query(f"""WITH v AS ({_RULED}), b AS (SELECT *, value_type IS NULL AND required AND trim(value) = '' AS blank, coalesce(type <> coalesce(value_type, 'string'), false) AS other FROM v), t AS (SELECT * FROM b WHERE NOT blank AND NOT other AND value_type IS NULL)
SELECT p_partkey, 'name' AS field, 'REQUIRED' AS code FROM b WHERE blank UNION ALL SELECT p_partkey, 'name', 'TYPE' FROM b WHERE other AND NOT blank UNION ALL SELECT p_partkey, 'name', 'MIN_LENGTH' FROM t WHERE length(value) < min_length UNION ALL SELECT p_partkey, 'name', 'MAX_LENGTH' FROM t WHERE length(value) > max_length
UNION ALL SELECT p_partkey, 'name', 'PATTERN' FROM t WHERE """ + " OR ".join(f"(pattern = '{p}' AND NOT regexp_matches(value, '{p}'))" for p in _PATTERNS))
def value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "part").createOrReplaceTempView("part")
    return P.value_errors(spark.sql(_RULED), "p_partkey")


_STEPS = [{"field": "pages", "operator": "gte", "value": 20, "then": 2, "otherwise": 0}, {"field": "previousStatus", "operator": "eq", "value": "queued", "then": 1, "otherwise": 3}, {"field": "queuedCount", "operator": "lte", "value": 3, "then": 0, "otherwise": 1}, {"field": "tagged", "operator": "eq", "value": False, "then": 1, "otherwise": 0}]


@query("""WITH a AS (SELECT p_partkey, p_size >= 20 AS m1, p_partkey % 3 AS t FROM part), s AS (SELECT p_partkey, unnest([1, 2, 3, 4])::INT AS step, unnest([m1, m1, true, coalesce(CASE WHEN t < 2 THEN t = 0 END = false, false)]) AS matched, unnest([CASE WHEN m1 THEN 2 ELSE 0 END, CASE WHEN m1 THEN 1 ELSE 3 END, 0, CASE WHEN t = 1 THEN 1 ELSE 0 END])::INT AS jobs FROM a)
SELECT p_partkey, step, matched, CASE WHEN jobs > 0 THEN 'queued' ELSE 'skipped' END AS status, jobs, (sum(jobs) OVER (PARTITION BY p_partkey ORDER BY step))::INT AS queued FROM s""")
def conditional_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_partkey") % 3
    facts = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("pages"), F.when(t < 2, t == 0).alias("tagged"))
    return P.workflow(facts, _STEPS, "p_partkey")


@query("SELECT o_orderkey, CASE WHEN l = i OR p = 'keep-local' THEN l WHEN p = 'keep-incoming' THEN i END AS value, CASE WHEN l = i OR p <> 'manual' THEN 'settled' ELSE 'open' END AS status FROM (SELECT o_orderkey, o_orderstatus AS l, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'X' END AS i, CASE o_orderkey % 3 WHEN 0 THEN 'keep-local' WHEN 1 THEN 'keep-incoming' ELSE 'manual' END AS p FROM orders)")
def resolved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("local"), F.when(k % 5 == 0, F.col("o_orderstatus")).otherwise("X").alias("incoming"), F.get(F.array(F.lit("keep-local"), F.lit("keep-incoming"), F.lit("manual")), k % 3).alias("policy"))
    return P.resolved(rows).select("o_orderkey", "value", "status")


_INTENT_BODY = {1: '{"data":{"consent":1},"id":"1","intentHash":"i","previousHash":"%s","type":"consent"}', 2: '{"data":{"route":[]},"id":"2","intentHash":"i","previousHash":"%s","type":"routed-signature"}', 3: '{"data":{},"id":"3","intentHash":"i","previousHash":"%s","type":"visible-appearance"}', 4: '{"id":"4","intentHash":"i","previousHash":"%s","type":"audit"}'}


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 3 ELSE 4 END::BIGINT AS records, p_partkey % 5 = 0 AS valid FROM part")
def signing_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of four records: whole ones, one with a wrong link, one with other content, one out of order, one cut short."""
    import hashlib

    rows, before = [], "genesis"
    for i, body in _INTENT_BODY.items():
        digest = hashlib.sha256((body % before).encode()).hexdigest()
        rows.append((i, P.INTENT[i - 1], str(i), before, digest, "i", {1: '{"consent":1}', 2: '{"route":[]}', 3: "{}"}.get(i)))
        before = digest
    chain = F.broadcast(spark.createDataFrame(rows, "n int, type string, id string, previous string, digest string, intent string, data string"))  # four rows
    k, n = F.col("p_partkey") % 5, F.col("n")
    r = _t(spark, sf_dir, "part").select("p_partkey").crossJoin(chain)
    r = r.withColumn("previous", F.when((k == 1) & (n == 3), "x").otherwise(F.col("previous"))).withColumn("data", F.when((k == 2) & (n == 1), "{}").otherwise(F.col("data"))).withColumn("n", F.when((k == 3) & (n <= 2), 3 - n).otherwise(n))
    return P.intents(r.filter(~((k == 4) & (n == 4))), "p_partkey", "n")


# --- trees ---

_TREE = "SELECT p_partkey AS node, CASE WHEN p_partkey > 3 THEN p_partkey // 4 END AS parent, CASE WHEN p_partkey <= 3 THEN 'A4' WHEN p_partkey % 7 = 0 THEN p_brand END AS media_box, CASE WHEN p_partkey % 11 = 0 THEN 90 END AS rotate, p_partkey % 9 AS declared FROM part"


@query(f"""WITH RECURSIVE n AS ({_TREE}), t(node, parent, media_box, rotate, depth, root) AS (SELECT node, parent, media_box, rotate, 0, node FROM n WHERE parent IS NULL UNION ALL SELECT n.node, n.parent, coalesce(n.media_box, t.media_box), coalesce(n.rotate, t.rotate), t.depth + 1, t.root FROM t JOIN n ON n.parent = t.node)
SELECT node, parent, media_box, rotate::INT AS rotate, depth::INT AS depth, root, node NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL) AS leaf FROM t""")
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _sql(spark, sf_dir, _TREE.replace("p_partkey // 4", "p_partkey div 4"), "part").drop("declared")
    return G.inherited(tree, ["media_box", "rotate"])


@query(f"""WITH RECURSIVE n AS ({_TREE}), t(node, top) AS (SELECT node, node FROM n UNION ALL SELECT n.node, t.top FROM t JOIN n ON n.parent = t.node), l AS (SELECT top, count_if(node NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL))::BIGINT AS leaves FROM t GROUP BY 1)
SELECT node, leaves, node NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL) OR declared = leaves AS declared FROM n JOIN l ON node = top""")
def declared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _sql(spark, sf_dir, _TREE.replace("p_partkey // 4", "p_partkey div 4"), "part").withColumnRenamed("declared", "n")
    return G.inherited(tree, [], total="n").select("node", "leaves", "declared")


_NEEDS = "SELECT p_partkey AS node, p_partkey * 3 % (SELECT max(p_partkey) FROM part) + 1 AS needed FROM part WHERE p_partkey % 12 = 5 UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_partkey % 50 = 9"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_NEEDS}), n AS MATERIALIZED (SELECT p_partkey AS node FROM part), r(node, needed) AS (SELECT node, needed FROM e UNION SELECT r.node, e.needed FROM r JOIN e ON e.node = r.needed),
bad AS (SELECT DISTINCT node FROM r WHERE needed NOT IN (SELECT node FROM n)), loops AS (SELECT node FROM r WHERE node = needed), cyc AS (SELECT node FROM loops UNION SELECT node FROM r WHERE needed IN (SELECT node FROM loops)),
good AS (SELECT node FROM n WHERE node NOT IN (SELECT node FROM bad) AND node NOT IN (SELECT node FROM cyc)), lv(node, level) AS (SELECT node, 0 FROM good UNION SELECT e.node, lv.level + 1 FROM lv JOIN e ON e.needed = lv.node WHERE e.node IN (SELECT node FROM good))
SELECT n.node, CASE WHEN n.node IN (SELECT node FROM good) THEN (SELECT max(level) FROM lv WHERE lv.node = n.node) END::INT AS level, CASE WHEN n.node IN (SELECT node FROM bad) THEN 'missing' WHEN n.node IN (SELECT node FROM cyc) THEN 'cycle' ELSE 'resolved' END AS status FROM n""")
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return G.dependency_order(part, _sql(spark, sf_dir, _NEEDS, "part"))


@query("SELECT a.user_id, a.event_id, a.level, (SELECT max(b.event_id) FROM e b WHERE b.user_id = a.user_id AND b.event_id < a.event_id AND b.level < a.level) AS parent FROM e a".replace("FROM e ", "FROM (SELECT user_id, event_id, floor(value)::BIGINT % 4 + 1 AS level FROM events) "))
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 4 + 1).alias("level"))
    return R.tree_parents(rows, "user_id", "event_id", "level")
