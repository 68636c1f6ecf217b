"""Registered queries of selections, counts and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import inventory as I
from quireframe.operators import text as X
from quireframe.plans.queries import _PAGES, _t, query


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' AND user_id = 7")
def markup_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.selected(_t(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), event_type="error", user_id=7, status=None)


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = 'Brand#13' AND p_type = 'STANDARD'")
def namespace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.selected(_t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), p_brand="Brand#13", p_type="STANDARD")


@query("SELECT k AS o_orderkey, o_orderkey IS NOT NULL AS found, o_orderstatus FROM (SELECT DISTINCT l_orderkey * 2 AS k FROM lineitem) LEFT JOIN orders ON k = o_orderkey")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey"))
    return I.lookup(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), wanted, "o_orderkey")


@query("SELECT p_partkey, p_size >= 20 AS at_least, p_size <> 7 AS other, false AS none FROM part")
def page_count_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", I.page_count_condition("pageCount >= 20", n).alias("at_least"), I.page_count_condition(" pageCount!=7 ", n).alias("other"), I.page_count_condition("always", n).alias("none"))


_FONTS = "SELECT p_partkey, p_size AS doc, CASE p_partkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN NULL ELSE 'yes' END AS embedded, CASE p_partkey % 7 WHEN 0 THEN 'NO' WHEN 1 THEN '?' ELSE 'yes' END AS unicode FROM part"


def _fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_FONTS)


@query(f"SELECT * FROM ({_FONTS}) WHERE lower(trim(embedded)) IS DISTINCT FROM 'yes'")
def unembedded_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unembedded(_fonts(spark, sf_dir))


@query(f"SELECT p_partkey, unicode FROM ({_FONTS}) WHERE lower(trim(unicode)) = 'no'")
def fonts_without_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fonts(spark, sf_dir).filter(I.said_no(F.col("unicode"))).select("p_partkey", "unicode")


@query(f"""SELECT doc, count(*) AS fonts, count_if(e = 'yes')::BIGINT AS embedded, count_if(e = 'no')::BIGINT AS not_embedded, count_if(e NOT IN ('yes', 'no'))::BIGINT AS unknown_embedded, count_if(u = 'yes')::BIGINT AS unicode, count_if(u = 'no')::BIGINT AS not_unicode, count_if(u NOT IN ('yes', 'no'))::BIGINT AS unknown_unicode
FROM (SELECT doc, coalesce(lower(trim(embedded)), '') AS e, coalesce(lower(trim(unicode)), '') AS u FROM ({_FONTS})) GROUP BY doc""")
def font_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.font_evidence(_fonts(spark, sf_dir), "doc")


@query(f"WITH {_PAGES} SELECT doc_id, page::INT AS page FROM pages_ WHERE (doc_id + page) % 9 < 2 OR NOT regexp_matches(text, '\\S')")
def empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") + F.col("page")) % 9
    pages = X.pages_of(_t(spark, sf_dir, "documents")).withColumn("text", F.when(k == 0, " \t").when(k != 1, F.col("text")))
    return I.empty_pages(pages).select("doc_id", "page")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def capabilities_of_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = _t(spark, sf_dir, "region").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    n = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # regions are five
    return I.chosen(n, families, "r_name").select("n_name", "r_name")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%17%' OR lower(p_brand) LIKE '%17%'")
def portfolio_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.named_like(_t(spark, sf_dir, "part"), "17", ["p_name", "p_brand"]).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND event_id % 9 <> 0 AND event_id * 60000 <= 30000000")
def due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "paused").otherwise("enabled").alias("status"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") * 60_000).alias("next_at"))
    return I.due(e, F.lit(30_000_000)).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 4 NOT IN (0, 1) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def zones_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(F.lit("image"), F.lit("exclude"), F.lit("text"), F.lit("table")), F.col("l_linenumber") % 4)
    zones = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).alias("page"), kind.alias("type"))
    pages = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("page"))
    return I.zones_to_read(zones, pages, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0")
def capable_printers(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.filter(F.transform(F.array(F.lit(2), F.lit(3), F.lit(5)), lambda d: F.when(F.col("s_suppkey") % d == 0, F.concat(F.lit("by"), d.cast("string")))), lambda x: x.isNotNull())
    return I.capable(_t(spark, sf_dir, "supplier"), options, ["by2", "by3"]).select("s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09)")
def chosen_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _t(spark, sf_dir, "lineitem").filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.chosen(_t(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 4, 9, 99)")
def chosen_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(1,), (4,), (9,), (99,)], "n_nationkey int")
    return I.chosen(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ids, "n_nationkey")


@query("SELECT user_id, CASE WHEN count(v) = count(*) THEN round(avg(v), 6) END AS result FROM (SELECT user_id, CASE WHEN event_id % 97 <> 0 THEN value END AS v FROM events) GROUP BY 1")
def column_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("v"))
    return I.column_formula(e, "user_id", "v", "mean")


@query("SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_quantity END), 6) AS total FROM lineitem GROUP BY 1")
def line_item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("l_linenumber") == 3, "many").otherwise(F.col("l_quantity").cast("string"))
    return I.totals(_t(spark, sf_dir, "lineitem").select("l_returnflag", q.alias("q")), "l_returnflag", "q")


@query("SELECT p_brand, count(*) AS n, round(sum(p_size * 1.5)::DOUBLE, 6) AS total FROM part GROUP BY 1")
def region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.totals(_t(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 1.5).cast("string").alias("area")), "p_brand", "area")


@query("SELECT c_mktsegment, count(*) AS n, sum(c_nationkey)::DOUBLE AS total FROM customer GROUP BY 1")
def drawing_set_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.totals(_t(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("sheets")), "c_mktsegment", "sheets")


@query("SELECT l_orderkey, count(*) AS pages, count(DISTINCT (l_quantity, l_tax)) AS geometries FROM lineitem GROUP BY 1")
def page_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.distinct_geometries(_t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("width"), F.col("l_tax").alias("height")), "l_orderkey")


@query("WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS page, CASE WHEN l_tax < 0.02 THEN 'warning' WHEN l_tax > 0.07 THEN 'not-checked' ELSE 'pass' END AS st FROM lineitem) SELECT l_orderkey, count(*) AS findings, count_if(st = 'warning')::BIGINT AS warnings, count_if(st = 'not-checked')::BIGINT AS not_checked, count(DISTINCT CASE WHEN st = 'warning' THEN page END) AS pages_with_warnings FROM s GROUP BY 1")
def contrast_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.when(F.col("l_tax") < 0.02, "warning").when(F.col("l_tax") > 0.07, "not-checked").otherwise("pass")
    return I.contrast_totals(_t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("page"), st.alias("status")), "l_orderkey")


@query("SELECT user_id, count(*) AS attempted, count_if(event_type <> 'error')::BIGINT AS ok, count_if(event_type = 'error')::BIGINT AS failed, coalesce(sum(CASE WHEN event_type <> 'error' THEN event_id % 9 END), 0)::BIGINT AS pages, coalesce(sum(CASE WHEN event_type <> 'error' THEN event_id END), 0)::BIGINT AS bytes, count_if(event_type = 'error') = 0 AND count(*) = 10 AS complete FROM events GROUP BY 1")
def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 9).alias("pages"), F.col("event_id").alias("bytes"), F.when(F.col("event_type") == "error", "E").alias("error"))
    return I.manifest(e, "user_id", F.lit(10))


@query("SELECT count(*) AS \"all\", count_if(event_type = 'signup')::BIGINT AS signup, count_if(event_type = 'purchase')::BIGINT AS purchase, 0::BIGINT AS no_such FROM events")
def capability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.state_counts(_t(spark, sf_dir, "events"), "event_type", ["signup", "purchase", "no-such"])


@query("SELECT p_partkey, (p_size + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END)::BIGINT AS total FROM part")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _t(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("opened"), F.lit(-5).alias("lost"))
    return I.usage_total(u, ["p_size", "opened", "lost"]).select("p_partkey", "total")


@query("SELECT l_orderkey, count(*) AS n, min(l_discount) AS x, min(l_tax) AS y, round(max(l_discount + l_quantity) - min(l_discount), 9) AS width, round(max(l_tax + l_quantity) - min(l_tax), 9) AS height FROM lineitem GROUP BY 1")
def row_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.col("l_quantity").alias("width"), F.col("l_quantity").alias("height"))
    return I.extents(words, ["l_orderkey"]).withColumns({"width": F.round("width", 9), "height": F.round("height", 9)})


@query("WITH m AS (SELECT l_orderkey, l_linenumber AS revision, l_suppkey % 5 AS object FROM lineitem), n AS (SELECT l_orderkey, max(revision) AS r FROM m GROUP BY 1) SELECT DISTINCT l_orderkey, object FROM m JOIN n USING (l_orderkey) WHERE revision < r AND (l_orderkey, object) NOT IN (SELECT (m.l_orderkey, m.object) FROM m JOIN n ON m.l_orderkey = n.l_orderkey AND m.revision = n.r)")
def revision_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("revision"), (F.col("l_suppkey") % 5).alias("object"))
    return I.residue(rows, "l_orderkey", "revision", "object")


@query("SELECT l_orderkey, count(*) AS headings, " + ", ".join(f"count_if(least(greatest(l_linenumber - 1, 1), 6) = {i})::BIGINT AS h{i}" for i in range(1, 7)) + " FROM lineitem GROUP BY 1")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.level_counts(_t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("level")), "l_orderkey", "level")


@query("WITH k AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, kind, n, row_number() OVER (PARTITION BY user_id ORDER BY f)::INT AS place FROM k")
def artifact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.kinds_in_order(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ["click", "view"], "other")


@query("SELECT event_id, user_id::VARCHAR AS \"group\", row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS place FROM events")
def presented_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.presented(_t(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id").drop("user_id")


@query("SELECT * FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)::INT AS place, count(*) OVER (PARTITION BY p_brand) AS total, greatest(count(*) OVER (PARTITION BY p_brand) - 3, 0)::BIGINT AS omitted FROM part) WHERE place <= 3")
def truncated_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.listed(_t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), "p_partkey"], 3).drop("p_size")


@query("SELECT n_name FROM nation")
def names_in_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.in_collation(_t(spark, sf_dir, "nation").select("n_name"), "n_name")


@query(f"WITH {_PAGES}, u AS (SELECT doc_id // 2 AS pair, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, page FROM pages_) SELECT pair, source, page::INT AS page, row_number() OVER (PARTITION BY pair ORDER BY source, page)::INT AS position FROM u")
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pages_of(_t(spark, sf_dir, "documents")).withColumn("pair", F.expr("doc_id div 2"))
    return I.merged(p.filter("doc_id % 2 = 0"), p.filter("doc_id % 2 = 1"), "pair")


@query(f"""WITH {_PAGES}, n AS (SELECT doc_id, count(*) AS c FROM pages_ GROUP BY 1), s AS (SELECT doc_id, g.i AS position, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE c + 1 - g.i + (doc_id % 4 = 1)::INT END AS page, c FROM n, (SELECT unnest([1, 2]) AS i) g WHERE g.i <= c)
SELECT doc_id, position::INT AS position, page::INT AS page, NOT bool_or(page > c OR n > 1) OVER (PARTITION BY doc_id) AS valid FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n FROM s)""")
def arranged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two pages of each document swapped; a quarter of the selections repeat a page, a quarter ask for one too many."""
    p = X.pages_of(_t(spark, sf_dir, "documents")).select("doc_id", "page")
    n = p.groupBy("doc_id").agg(F.count("*").cast("int").alias("c"))
    k = F.col("doc_id") % 4
    page = F.when(k == 0, 1).otherwise(F.col("c") + 1 - F.col("position") + (k == 1).cast("int"))
    s = n.withColumn("position", F.explode(F.sequence(F.lit(1), F.least("c", F.lit(2))))).select("doc_id", "position", page.cast("int").alias("page"))
    return I.arranged(p, s, "doc_id")


@query(f"WITH {_PAGES}, u AS (SELECT doc_id // 2 AS pair, 'target' AS source, page, page AS p, 0 AS k FROM pages_ WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id // 2, 'source', page, 1, 1 FROM pages_ WHERE doc_id % 2 = 1 AND page = 2) SELECT pair, source, page::INT AS page, row_number() OVER (PARTITION BY pair ORDER BY p, k)::INT AS position FROM u")
def copied_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pages_of(_t(spark, sf_dir, "documents")).withColumn("pair", F.expr("doc_id div 2"))
    return I.copied_page(p.filter("doc_id % 2 = 1"), p.filter("doc_id % 2 = 0"), 2, 1, "pair")


@query(f"WITH {_PAGES}, n AS (SELECT doc_id, count(*) AS c FROM pages_ GROUP BY 1), s AS (SELECT doc_id, g.s AS start, least(g.e, c) AS e FROM n, (VALUES (1, 3), (4, 8), (9, 1000000000)) g(s, e) WHERE g.s <= c) SELECT p.doc_id, p.page::INT AS page, s.start, (p.page - s.start + 1)::INT AS place FROM pages_ p JOIN s ON p.doc_id = s.doc_id AND p.page BETWEEN s.start AND s.e")
def split_by_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireframe.operators import records as R

    p = X.pages_of(_t(spark, sf_dir, "documents")).select("doc_id", "page")
    n = p.groupBy("doc_id").agg(F.count("*").cast("int").alias("c"))
    starts = p.filter(F.col("page").isin(1, 4, 9)).withColumnRenamed("page", "start").join(n, "doc_id")
    return I.sections_of_pages(p, R.section_ends(starts, "doc_id", "start", F.col("c")), "doc_id")


@query("SELECT p_partkey, lower(p_brand) || CASE WHEN lower(p_type) <> lower(p_brand) THEN ',' || lower(p_type) ELSE '' END AS tags FROM part")
def unique_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(I.unique_tags(F.array("p_brand", F.upper("p_brand"), "p_type", "p_brand")), ",").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x,b,x' ELSE 'b' END AS conflicts, true AS has FROM part")
def capability_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.lit("x"), F.lit("b"), F.lit("q"), F.lit("x"))
    b = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("x"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    c = I.conflicts(a, b)
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(c, ",").alias("conflicts"), (F.size(c) > 0).alias("has"))


@query("""WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0), d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'false-positive' ELSE 'confirmed-low-confidence' END AS st FROM orders WHERE o_orderkey % 5 <> 0)
SELECT count(s.o_orderkey) AS suspects, count_if(s.o_orderkey IS NOT NULL AND st = 'unreviewed')::BIGINT AS unreviewed, count_if(s.o_orderkey IS NOT NULL AND st = 'confirmed-low-confidence')::BIGINT AS confirmed_low_confidence, count_if(s.o_orderkey IS NOT NULL AND st = 'false-positive')::BIGINT AS false_positive, count_if(s.o_orderkey IS NULL OR st IS NULL) = 0 AS exact FROM s FULL JOIN d ON s.o_orderkey = d.o_orderkey""")
def suspect_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    d = o.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.when(k == 0, "unreviewed").when(k == 1, "false-positive").otherwise("confirmed-low-confidence").alias("st"))
    return I.cover_states(o.filter("o_orderkey % 3 <> 0"), d, "o_orderkey", "st", ["unreviewed", "confirmed-low-confidence", "false-positive"])
