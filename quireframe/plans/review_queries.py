"""Registered queries of the review operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import records as R
from quireframe.operators import review as V
from quireframe.operators import text as X
from quireframe.plans.queries import _PAGES, _t, query


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of documents with even and odd numbers, as the two sides of a pair."""
    p = X.pages_of(_t(spark, sf_dir, "documents")).withColumn("pair", F.expr("doc_id div 2"))
    return p.filter("doc_id % 2 = 0"), p.filter("doc_id % 2 = 1")


_BOTH = f"""{_PAGES}, a AS (SELECT doc_id // 2 AS pair, page, text FROM pages_ WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS pair, page, text FROM pages_ WHERE doc_id % 2 = 1),
pp AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.page, b.page)::INT AS page, a.pair IS NOT NULL AS left_present, b.pair IS NOT NULL AS right_present,
CASE WHEN a.pair IS NULL OR b.pair IS NULL THEN 'unpaired-page' WHEN a.text IS NOT DISTINCT FROM b.text THEN 'unchanged' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.pair = b.pair AND a.page = b.page)"""


@query(f"WITH {_BOTH} SELECT * FROM pp")
def paired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.paired_pages(*_two(spark, sf_dir), "pair")


@query(f"WITH {_BOTH} SELECT pair, count(*) AS pages, count_if(left_present)::BIGINT AS left_pages, count_if(right_present)::BIGINT AS right_pages, count_if(status = 'changed')::BIGINT AS changed FROM pp GROUP BY pair")
def pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pair_totals(V.paired_pages(*_two(spark, sf_dir), "pair"), "pair")


_PLACED = "SELECT pair, page::INT AS page, source, row_number() OVER (PARTITION BY pair ORDER BY k, page)::INT AS position FROM u"


@query(f"WITH {_BOTH}, u AS (SELECT pair, page, 'a' AS source, CASE WHEN page <= 2 THEN 0 ELSE 2 END AS k FROM a UNION ALL SELECT pair, page, 'b', 1 FROM b) {_PLACED}")
def insert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.inserted(*_two(spark, sf_dir), 2, "pair")


@query(f"WITH {_BOTH}, u AS (SELECT pair, page, 'a' AS source, CASE WHEN page < 2 THEN 0 ELSE 2 END AS k FROM a WHERE page NOT BETWEEN 2 AND 3 UNION ALL SELECT pair, page, 'b', 1 FROM b) {_PLACED}")
def replace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.replaced(*_two(spark, sf_dir), 2, 3, "pair")


@query(f"WITH {_PAGES} SELECT doc_id, page::INT AS page, o.position::INT AS position FROM pages_ JOIN (VALUES (3, 1), (1, 2), (3, 3), (2, 4)) AS o(p, position) ON page = o.p")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extracted(X.pages_of(_t(spark, sf_dir, "documents")), [3, 1, 3, 2], "doc_id")


@query(f"WITH {_PAGES} SELECT doc_id, page::INT AS page, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC)::INT AS position FROM pages_")
def reverse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reverse(X.pages_of(_t(spark, sf_dir, "documents")).select("doc_id", "page"), "doc_id")


@query(
    """WITH o AS (SELECT l_orderkey, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END AS v FROM lineitem)
SELECT l_orderkey, round(CASE WHEN w THEN s END, 6) AS total, round(CASE WHEN w THEN a END, 6) AS average, CASE WHEN w THEN lo END AS least, CASE WHEN w THEN hi END AS greatest, round(log10(CASE WHEN w THEN p END), 9) AS product_log10
FROM (SELECT l_orderkey, bool_and(v IS NOT NULL) AS w, sum(v) AS s, avg(v) AS a, min(v) AS lo, max(v) AS hi, product(v) AS p FROM o GROUP BY l_orderkey)"""
)
def form_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 6, F.col("l_quantity")).alias("v"))
    # A product of many numbers is exact only relative to its size, as the order of factors is open.
    return V.calculated(rows, "l_orderkey", "v").withColumn("product_log10", F.round(F.log10("product"), 9)).drop("product")


_FORM_VALUES = "SELECT p_partkey, unnest(['kind', 'brand', 'size']) AS field, unnest([CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 9 > 1 THEN p_type END, p_brand, CASE WHEN p_partkey % 11 = 0 THEN 'NaN' ELSE p_size::VARCHAR END]) AS value FROM part"


# The rules come of the parts too: a field's pattern and bounds are what brands and sizes of the first parts tell.
@query(
    f"""WITH v AS ({_FORM_VALUES}), r AS (SELECT min(p_size) + 4 AS low, max(p_size) - 10 AS high, min(p_brand) AS least FROM part WHERE p_partkey <= 100)
SELECT p_partkey, field, 'required' AS code FROM v WHERE field = 'kind' AND (value IS NULL OR value = '') UNION ALL SELECT p_partkey, field, 'pattern' FROM v, r WHERE field = 'brand' AND NOT regexp_matches(value, '^Brand#[1-3][0-9]?$|' || r.least)
UNION ALL SELECT p_partkey, field, 'min' FROM v, r WHERE field = 'size' AND value <> 'NaN' AND TRY_CAST(value AS INT) < low UNION ALL SELECT p_partkey, field, 'max' FROM v, r WHERE field = 'size' AND value <> 'NaN' AND TRY_CAST(value AS INT) > high"""
)
def form_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 9 == 0, "").when(F.col("p_partkey") % 9 != 1, F.col("p_type"))
    size = F.when(F.col("p_partkey") % 11 == 0, "NaN").otherwise(F.col("p_size").cast("string"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("kind", kind), ("brand", F.col("p_brand")), ("size", size))])
    values = part.select("p_partkey", F.explode(each).alias("v")).select("p_partkey", "v.*")
    told = part.filter("p_partkey <= 100").agg(F.concat(F.lit("^Brand#[1-3][0-9]?$|"), F.min("p_brand")).alias("pattern"), (F.min("p_size") + 4).alias("low"), (F.max("p_size") - 10).alias("high"))
    rules = told.select(F.expr("inline(array(named_struct('field', 'kind', 'type', 'text', 'required', true, 'pattern', '', 'low', cast(null as int), 'high', cast(null as int)), named_struct('field', 'brand', 'type', 'text', 'required', false, 'pattern', pattern, 'low', cast(null as int), 'high', cast(null as int)), named_struct('field', 'size', 'type', 'number', 'required', true, 'pattern', '', 'low', low, 'high', high)))"))
    return V.form_errors(values, rules, "p_partkey")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 6) AS total, count(*) AS n, sum(('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT)::VARCHAR AS members FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) GROUP BY 1")
def takeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _t(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.takeoff(_t(spark, sf_dir, "orders"), chosen, "o_orderkey", "o_orderpriority", "o_totalprice")


@query("WITH c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1), j AS (SELECT c.*, o_orderstatus AS s, o_orderkey FROM c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 97 <> 0) ON k = o_orderkey) SELECT count(*) AS chosen, count_if(n > 1)::BIGINT AS repeated, count_if(o_orderkey IS NULL)::BIGINT AS unknown, count(DISTINCT s) AS sources, count_if(n > 1) = 0 AND count_if(o_orderkey IS NULL) = 0 AND count(DISTINCT s) = 1 AS valid FROM j")
def takeoff_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _t(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.takeoff_checks(_t(spark, sf_dir, "orders").filter("o_orderkey % 97 <> 0"), chosen, "o_orderkey", "o_orderstatus")


@query("SELECT user_id, count(*) AS jobs, count_if(event_type = 'purchase')::BIGINT AS completed, count_if(event_type = 'error')::BIGINT AS failed, round(count_if(event_type = 'purchase') / count(*), 6) AS success_rate FROM events GROUP BY 1")
def processing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.processing_report(_t(spark, sf_dir, "events"), "user_id", "event_type", "purchase", "error")


@query("WITH a AS (SELECT l_returnflag, l_linenumber, round(avg(l_tax), 6) AS anchor FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linenumber, anchor, round(avg((round(abs(l_tax - anchor), 6) <= 0.04)::INT), 6) AS score FROM lineitem JOIN a USING (l_returnflag, l_linenumber) GROUP BY 1, 2, 3")
def column_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_tax")
    return V.column_alignment(words, "l_returnflag", "l_linenumber", "l_tax")


@query("WITH d AS (SELECT l_orderkey, l_linenumber, abs(l_quantity - 5) AS a, abs(l_quantity - 15) AS b, abs(l_quantity - 40) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS col FROM d")
def nearest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.nearest_anchor(F.col("l_quantity"), [5.0, 15.0, 40.0]).alias("col"))


@query("SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN value END >= 100, false) AS passed FROM events")
def workflow_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") != "view", F.col("value"))
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(value >= 100, F.lit(False)).alias("passed"))


@query("WITH i AS (SELECT p_partkey, p_size * 10 AS x, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 40 * 10 END AS y FROM part) SELECT p_partkey, CASE WHEN x IS NULL OR y IS NULL THEN 'unknown' WHEN least(x, y) <= 0 THEN 'invalid' WHEN least(x, y) < 150 THEN 'low' ELSE 'fine' END AS resolution FROM i")
def image_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 40 * 10)
    return _t(spark, sf_dir, "part").select("p_partkey", V.image_resolution(F.col("p_size") * 10, y).alias("resolution"))


@query(
    """WITH l AS (SELECT user_id, event_id, floor(value)::BIGINT % 4 + 1 AS level FROM events), h AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM l)
SELECT user_id, event_id, CASE WHEN b IS NULL THEN 'first-not-top' ELSE 'level-skipped' END AS code FROM h WHERE (b IS NULL AND level <> 1) OR level > b + 1"""
)
def heading_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 4 + 1).alias("level"))
    return V.heading_violations(rows, "user_id", "event_id", "level")


@query("WITH r AS (SELECT user_id, event_type, CASE WHEN row_number() OVER o = 1 THEN v IS NOT NULL ELSE coalesce(v > lag(v) OVER o, false) END AS r FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events) WINDOW o AS (PARTITION BY user_id, event_type ORDER BY event_id)) SELECT user_id || event_type AS series, bool_and(r) AS ascending FROM r GROUP BY 1")
def ascending_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("series"), "event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    return V.ascending(rows, "series", "event_id", "value")


_CHAIN = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
log(user_id, event_id, event_type, seq, previous, digest) AS (
  SELECT user_id, event_id, event_type, seq, 'GENESIS', sha256('GENESIS|' || event_id || '|' || event_type) FROM e WHERE seq = 1
  UNION ALL SELECT e.user_id, e.event_id, e.event_type, e.seq, log.digest, sha256(log.digest || '|' || e.event_id || '|' || e.event_type) FROM log JOIN e ON e.user_id = log.user_id AND e.seq = log.seq + 1)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return R.chained_log(events, "user_id", "event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))


@query(f"{_CHAIN} SELECT user_id, event_id, event_type, seq AS sequence, previous, digest FROM log")
def chained_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


@query(
    f"""{_CHAIN}, d AS (SELECT user_id, seq, CASE WHEN event_id % 500 = 40 THEN seq + 1 ELSE seq END AS sequence, CASE event_id % 500 WHEN 499 THEN 'x' WHEN 250 THEN NULL ELSE previous END AS previous,
CASE WHEN event_id % 500 = 333 THEN NULL ELSE digest END AS digest, event_id, CASE WHEN event_id % 500 = 120 THEN 'other' ELSE event_type END AS event_type FROM log),
c AS (SELECT a.user_id, coalesce(a.sequence = a.seq AND a.previous = CASE WHEN a.seq = 1 THEN 'GENESIS' ELSE b.digest END AND a.digest = sha256(a.previous || '|' || a.event_id || '|' || a.event_type), false) AS ok FROM d a LEFT JOIN d b ON a.user_id = b.user_id AND b.seq = a.seq - 1)
SELECT user_id, bool_and(ok) AS intact, count(*) AS n FROM c GROUP BY 1"""
)
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose records are damaged in five ways: sequence, previous digest (wrong, null), digest and content."""
    k = F.col("event_id") % 500
    damaged = _log(spark, sf_dir).withColumns({
        "sequence": F.col("sequence") + (k == 40).cast("long"),
        "previous": F.when(k == 499, "x").when(k != 250, F.col("previous")),
        "digest": F.when(k != 333, F.col("digest")),
        "event_type": F.when(k == 120, "other").otherwise(F.col("event_type")),
    })
    content = F.concat(F.col("previous"), F.lit("|"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))
    return R.verified_chain(damaged, "sequence", "previous", "digest", "user_id", content)


@query("SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS ordinal, count(*) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) > 5 AS truncated FROM events) WHERE ordinal <= 5")
def capped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.capped(_t(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def last_audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("SELECT user_id, min(event_id) AS job FROM events WHERE event_type = 'signup' GROUP BY 1")
def first_eligible_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy("user_id").agg(F.min_by("event_id", "event_id").alias("job"))


@query(
    """WITH f AS (SELECT user_id, event_id, event_type, first_value(event_type) OVER w AS one, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN k = 1 THEN 'new' WHEN event_type = one THEN 'same' ELSE 'conflict' END AS status FROM f"""
)
def idempotent_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.submissions(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


_STATE = "CASE event_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'issued' ELSE 'superseded' END"


@query(
    f"""WITH s AS (SELECT user_id, event_id, {_STATE} AS state FROM events), b AS (SELECT user_id, event_id, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before, state FROM s)
SELECT *, (before = 'draft' AND state = 'issued') OR (before = 'issued' AND state = 'superseded') AS allowed FROM b WHERE before IS NOT NULL"""
)
def revision_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_STATE).alias("state"))
    return V.transitions(rows, "user_id", "event_id", "state", [("draft", "issued"), ("issued", "superseded")])


@query(
    """WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0), d AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)
SELECT count(s.o_orderkey) FILTER (d.o_orderkey IS NOT NULL) AS decided, count(*) FILTER (d.o_orderkey IS NULL) AS missing, count(*) FILTER (s.o_orderkey IS NULL) AS unexpected,
count(*) FILTER (d.o_orderkey IS NULL) = 0 AND count(*) FILTER (s.o_orderkey IS NULL) = 0 AS exact FROM s FULL JOIN d ON s.o_orderkey = d.o_orderkey"""
)
def review_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return V.cover(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 5 <> 0"), "o_orderkey", "o_orderstatus")


@query("""WITH l AS (SELECT l_orderkey AS form, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, l_quantity AS q FROM lineitem), s AS (SELECT form, max(q) FILTER (n = 1) AS a, max(q) FILTER (n = 2) AS b FROM l GROUP BY 1)
SELECT form, 'total' AS name, a + b AS value FROM s UNION ALL SELECT form, 'mean', round((a + b + a) / 2, 6) FROM s UNION ALL SELECT form, 'early', NULL FROM s UNION ALL SELECT form, 'odd', 1.0 FROM s""")
def calculated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total of two lines, a mean of it and a line, a product that comes before the total, and no calculation at all."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("form"), n.alias("at"), F.col("l_quantity").alias("value")).filter("at <= 2")
    lines = lines.select("form", "at", F.concat(F.lit("line"), F.col("at").cast("string")).alias("name"), "value", F.lit(None).cast("string").alias("calculation"))
    made = [(10, "total", None, "sum(line1,line2)"), (11, "mean", None, "average(total,line1)"), (0, "early", None, "product(total,line1)"), (12, "odd", 1.0, "sum(line1;line2)")]
    extra = F.broadcast(spark.createDataFrame(made, "at int, name string, value double, calculation string"))  # four fields
    fields = lines.unionByName(lines.select("form").distinct().crossJoin(extra))
    out = V.calculated_fields(fields, "form").filter("name NOT LIKE 'line%'")
    return out.select("form", "name", F.round("value", 6).alias("value"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'uncalibrated' WHEN p_partkey % 4 = 1 THEN 'missing' WHEN p_size % 2 = 0 THEN 'bound' ELSE 'other-source' END AS status, CASE WHEN p_partkey % 4 > 1 AND p_size % 2 = 0 THEN 0.5 + p_partkey % 10 END::DOUBLE AS scale FROM part")
def bound_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    m = _t(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 == 1, -1).when(k % 4 > 1, k % 10).alias("calibration"), F.when(F.col("p_size") % 2 == 0, "a").alias("sha256"), F.lit(1).alias("page"))
    c = spark.range(10).select("id", (F.col("id") + 0.5).alias("scale"), F.lit("a").alias("sha256"), F.lit(1).alias("page"))
    return V.bound_measurements(m, c, ["sha256", "page"]).select("id", "status", "scale")


@query("SELECT id, CASE WHEN id > (SELECT max(p_partkey) FROM part) THEN 'stray' WHEN id % 2 = 0 AND id % 3 = 0 THEN 'proven' WHEN id % 2 = 0 THEN 'covered' ELSE 'bare' END AS status FROM (SELECT p_partkey AS id FROM part UNION SELECT p_partkey * 2 FROM part WHERE p_partkey * 2 > (SELECT max(p_partkey) FROM part))")
def capability_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return V.closure(p, p.select(F.col("id") * 2).toDF("id"), p.filter("id % 3 = 0"))


@query("SELECT event_type AS type, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1")
def markup_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireframe.operators import inventory as I

    h = R.histograms(I.selected(_t(spark, sf_dir, "events"), user_id=7), ["event_type"])
    return h.filter("facet = 'event_type'").select(F.col("value").alias("type"), "n")
