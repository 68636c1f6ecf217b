"""Registered queries of exports, interchange and layout, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import exports as E
from quireframe.operators import layout as L
from quireframe.operators import text as X
from quireframe.plans.queries import _PAGES, _TRIM, _firsts, _t, digest_sum_sql, query  # noqa: F401
from quireframe.plans.value_queries import _sql


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


_END = lambda c: f"regexp_replace({c}, '{X.SPACES}+$', '')"


@query(f"""WITH {_PAGES} SELECT doc_id, '<!doctype html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><title>PDF text export</title></head><body>' || chr(10) || string_agg('<section data-page="' || page || '"><h2>Page ' || page || '</h2><pre>' || {_esc(_END('text'))} || '</pre></section>', chr(10) ORDER BY page) || chr(10) || '</body></html>' || chr(10) AS data FROM pages_ GROUP BY doc_id""")
def html_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.structured_export(X.pages_of(_t(spark, sf_dir, "documents")), "html")


@query(f"""WITH {_PAGES}, b AS (SELECT doc_id, page, CASE WHEN doc_id % 7 = 0 AND page = 1 THEN chr(7) || text ELSE text END AS text FROM pages_)
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<document title="PDF text export">' || chr(10) || string_agg('  <page number="' || page || '">' || replace({_esc(_END('text'))}, chr(13), '&#13;') || '</page>', chr(10) ORDER BY page) || chr(10) || '</document>' || chr(10) END AS data FROM b GROUP BY doc_id""")
def xml_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character that XML forbids is put into a seventh of the documents."""
    odd = (F.col("doc_id") % 7 == 0) & (F.col("page") == 1)
    pages = X.pages_of(_t(spark, sf_dir, "documents"))
    return E.structured_export(pages.withColumn("text", F.when(odd, F.concat(F.lit("\x07"), "text")).otherwise(F.col("text"))), "xml")


_U16 = "list_transform(range(1, length(t) + 1), lambda i: CASE WHEN substr(t, i, 1) IN (chr(92), '{', '}') THEN chr(92) || substr(t, i, 1) WHEN substr(t, i, 1) = chr(10) THEN chr(92) || 'line' || chr(10) WHEN unicode(substr(t, i, 1)) BETWEEN 32 AND 126 THEN substr(t, i, 1) WHEN unicode(substr(t, i, 1)) < 32768 THEN chr(92) || 'u' || unicode(substr(t, i, 1)) || '?' WHEN unicode(substr(t, i, 1)) < 65536 THEN chr(92) || 'u' || (unicode(substr(t, i, 1)) - 65536) || '?' ELSE chr(92) || 'u' || (55296 + (unicode(substr(t, i, 1)) - 65536) // 1024 - 65536) || '?' || chr(92) || 'u' || (56320 + (unicode(substr(t, i, 1)) - 65536) % 1024 - 65536) || '?' END)"


@query(f"""SELECT n_nationkey AS doc_id, '{{' || chr(92) || 'rtf1' || chr(92) || 'ansi' || chr(92) || 'deff0' || chr(10) || chr(92) || 'b Page 1' || chr(92) || 'b0' || chr(92) || 'line' || chr(10) || array_to_string({_U16}, '') || chr(10) || '}}' AS data FROM (SELECT *, n_name || chr(10) || '{{a}}' || chr(92) || 'é' || chr(9999) || chr(128512) || '.' AS t FROM nation)""")
def rtf_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit(1).alias("page"), F.concat("n_name", F.lit("\n{a}\\é✏\U0001f600.  ")).alias("text"))
    return E.structured_export(n, "rtf")


_CELL = lambda c: f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_ANNOTATIONS = "SELECT CAST(p_partkey AS STRING) AS id, 'note' AS type, CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'custom' END AS status, CASE WHEN p_size % 2 = 1 THEN 'mine' ELSE '' END AS custom_status, p_size AS page, p_brand AS author, CASE WHEN p_size % 3 = 0 THEN 'say \"' || p_name || '\", <b>' ELSE p_name END AS text FROM part"


@query(f"""SELECT id, concat_ws(',', id, type, CASE WHEN custom_status <> '' THEN custom_status ELSE status END, page, {_CELL('author')}, {_CELL('text')}) AS line, '<text name="' || id || '" page="' || (page - 1) || '" title="' || {_esc('author')} || '" contents="' || {_esc('text')} || '" subject="note"/>' AS xfdf FROM ({_ANNOTATIONS})""")
def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.review_lines(_sql(spark, sf_dir, _ANNOTATIONS, "part"))


@query("""SELECT p_partkey, p_size > 3 AND p_partkey % 5 <> 0 AS valid, CASE WHEN p_size > 3 AND p_partkey % 5 <> 0 THEN p_size END AS page, CASE WHEN p_size > 3 AND p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS "right", CASE WHEN p_size > 3 AND p_partkey % 5 <> 0 AND p_size % 2 = 0 THEN p_brand END AS name, CASE WHEN p_size > 3 AND p_partkey % 5 <> 0 THEN '<' || p_name || '> & "co"' END AS contents FROM part""")
def text_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again; a fifth hold CDATA, and boxes of sizes up to 3 have no area."""
    made = E.annotation_xfdf(F.col("p_size"), [F.lit(3), F.lit(0), F.col("p_size"), F.lit(9)], F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.concat(F.lit("<"), "p_name", F.lit('> & "co"')))
    odd = F.when(F.col("p_partkey") % 5 == 0, F.replace(made, F.lit("<contents>"), F.lit("<contents><![CDATA[x]]>"))).otherwise(made)
    return E.text_annotations(_t(spark, sf_dir, "part").select("p_partkey", odd.alias("xfdf"))).select("p_partkey", "valid", "page", "right", "name", "contents")


@query("""WITH a AS (SELECT p_partkey AS doc_id, unnest(['x', 'y', CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'z' END]) AS id, unnest(['note', CASE WHEN p_size % 3 = 0 THEN 'Note' ELSE 'stamp' END, 'stamp']) AS type, unnest([p_size, p_size, 0])::INT AS page, unnest([1, 2, 3]) AS n, p_partkey % 6 AS f FROM part)
SELECT doc_id, id, type, page, CASE WHEN n = 3 AND id = 'x' THEN 'duplicate-id' WHEN type = 'Note' THEN 'unknown-type' WHEN page = 0 THEN 'bad-page' END AS code FROM a WHERE f <> 0 UNION ALL SELECT DISTINCT doc_id, NULL, NULL, NULL::INT, 'bad-format' FROM a WHERE f = 0""")
def imported_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    item = lambda i, kind, page: F.concat(F.lit('{"id":"'), i, F.lit('","type":"'), kind, F.lit('","page":'), page.cast("string"), F.lit(',"text":"t"}'))
    text = F.concat(F.lit('{"format":"'), F.when(F.col("p_partkey") % 6 == 0, "other").otherwise("review-v1"), F.lit('","annotations":['), F.concat_ws(",", item(F.lit("x"), F.lit("note"), s), item(F.lit("y"), F.when(s % 3 == 0, "Note").otherwise("stamp"), s), item(F.when(s % 2 == 0, "x").otherwise("z"), F.lit("stamp"), F.lit(0))), F.lit("]}"))
    return E.imported_reviews(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("json")), "review-v1").drop("text")


@query(f"SELECT p_partkey::VARCHAR AS id, concat_ws(',', p_partkey, {_CELL('n')}, coalesce(v, '')) AS line FROM (SELECT p_partkey, p_name || CASE WHEN p_size % 4 = 0 THEN ', x' ELSE '' END AS n, CASE WHEN p_size % 2 = 0 THEN p_brand END AS v FROM part)")
def forms_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    fields = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.when(F.col("p_size") % 4 == 0, ", x").otherwise("")).alias("name"))
    return E.forms_lines(fields, p.filter("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("value")))


@query("SELECT p_partkey, p_partkey % 4 NOT IN (1, 2) AS valid, CASE WHEN p_partkey % 4 NOT IN (1, 2) THEN p_brand END AS field_name, CASE WHEN p_partkey % 4 NOT IN (1, 2) THEN 'a \"' || p_name || '\"' END AS value FROM part")
def form_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that could be formulas are not written, and a text with a second row is not read."""
    k = F.col("p_partkey") % 4
    value = F.concat(F.when(k == 1, " =").otherwise("a "), F.lit('"'), "p_name", F.lit('"'))
    made = E.form_csv(F.col("p_brand"), value)
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.when(k == 2, F.concat(made, F.lit('"x","y"\r\n'))).otherwise(made).alias("csv"))
    return E.parsed_form_csv(rows).select("p_partkey", "valid", "field_name", "value")


_TALK = "SELECT conv_id AS doc_id, turn AS at, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as annotations, each with two replies but for those of users."""
    _firsts(spark, sf_dir, "conversations", ["conv_id", "turn"], "role", "text").createOrReplaceTempView("first_turns")
    t = spark.sql(_TALK.replace("FROM conversations", "FROM first_turns"))
    name = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("at").cast("string"))
    reply = lambda i: F.struct(F.concat(name, F.lit(f".{i}")).alias("id"), F.lit("r").alias("author"), F.lit(f"reply {i}").alias("text"))
    replies = F.when(F.col("role") == "user", F.slice(F.array(reply(1)), 1, 0)).otherwise(F.array(reply(1), reply(2)))
    return t.select("doc_id", "at", name.alias("id"), F.lit(1).alias("page"), F.col("role").alias("author"), F.substring("role", 1, 3).alias("text"), replies.alias("replies"))


_COMMENTS = f"""WITH t AS (SELECT DISTINCT ON (doc_id, "at") doc_id, "at", role FROM ({_TALK}) ORDER BY doc_id, "at"), c AS (SELECT doc_id, "at", 0 AS k, doc_id || '-' || "at" AS id, 'annotation' AS kind, role AS author, substr(role, 1, 3) AS text FROM t UNION ALL SELECT doc_id, "at", k, doc_id || '-' || "at" || '.' || k, 'comment', 'r', 'reply ' || k FROM t, (SELECT unnest([1, 2]) AS k) WHERE role IS DISTINCT FROM 'user')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "at", k)::INT AS "order", id, kind, doc_id || '-' || "at" AS annotation_id, 1 AS page, author, text FROM c"""


@query(_COMMENTS)
def comment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.comments(_annotations(spark, sf_dir))


@query(f"SELECT * FROM ({_COMMENTS}) WHERE kind = 'comment' AND id LIKE '%.2'")
def chosen_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annotations(spark, sf_dir)
    ids = a.select("doc_id", F.concat("id", F.lit(".2")).alias("id"))
    return E.comments(a, ids)


@query(f"SELECT doc_id, annotation_id || '.2' AS id, 'unknown' AS code FROM ({_COMMENTS}) c WHERE kind = 'annotation' AND annotation_id || '.2' NOT IN (SELECT id FROM ({_COMMENTS}))")
def forged_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annotations(spark, sf_dir)
    return E.forged(a, a.select("doc_id", F.concat("id", F.lit(".2")).alias("id")))


@query("SELECT page_id AS doc_id, 1 AS page, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS text FROM (SELECT page_id, string_split(replace(html, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM pages)")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.page_lines(_t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.col("html").alias("text")))


@query("""SELECT p_partkey AS doc_id, p_brand AS id, CASE WHEN p_size <= 40 THEN '<span data-ocr-id="' || p_brand || '" data-confidence="' || p_size || '" style="left:' || format('{:.4f}', p_size / 50 * 100) || '%;top:0.0000%;width:20.0000%;height:12.5000%">&lt;' || p_name || '&#39;</span>' END AS element FROM part""")
def positioned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("id"), F.concat(F.lit("<"), "p_name", F.lit("'")).alias("text"), F.col("p_size").alias("confidence"), (F.col("p_size") / 50).alias("x"), F.lit(0.0).alias("y"), F.lit(0.2).alias("width"), F.lit(0.125).alias("height"))
    return E.positioned_words(w)


@query("""SELECT p_partkey AS doc_id, 'fonts.embedding' AS "check", '<check id="fonts.embedding" status="pass"><evidence>{&quot;count&quot;:' || p_size || ',&quot;names&quot;:[&quot;' || p_name || '&quot;]}</evidence></check>' AS element FROM part""")
def check_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.concat(F.lit('{"names": ["'), "p_name", F.lit('"], "count": '), F.col("p_size").cast("string"), F.lit(".0}"))
    return E.check_elements(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("fonts.embedding").alias("check"), F.lit("pass").alias("status"), evidence.alias("evidence")))


_SUSPECT = """'{"confidence":' || CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size / 2)::VARCHAR END || ',"height":9,"left":' || p_partkey || ',"page":1,"text":"' || p_name || '","top":2,"width":3}'"""


@query(f"SELECT 'ocr-suspect-' || d AS id, d AS digest, 1 AS page, p_name AS text, CASE WHEN p_partkey % 3 = 0 THEN 'false-positive' END AS state FROM (SELECT *, sha256({_SUSPECT}) AS d FROM part)")
def suspect_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    s = p.select("p_partkey", F.lit(1).alias("page"), F.col("p_name").alias("text"), (F.col("p_size") / 2).alias("confidence"), F.col("p_partkey").alias("left"), F.lit(2).alias("top"), F.lit(3).alias("width"), F.lit(9).alias("height"))
    none = spark.createDataFrame([], "digest string, state string")
    decided = E.suspect_entries(s.filter("p_partkey % 3 = 0"), none).select("digest", F.lit("false-positive").alias("state"))
    return E.suspect_entries(s, decided)


@query("SELECT s_suppkey, '\"' || s_name || '\",\"''=' || s_suppkey || '\"' AS line FROM supplier")
def spreadsheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spreadsheet_lines(_t(spark, sf_dir, "supplier").withColumn("f", F.concat(F.lit("="), F.col("s_suppkey").cast("string"))), "s_suppkey", ["s_name", "f"])


# --- words of orders as tables: a row for each line of an order, three words at places near 0.1, 0.4 and 0.7 ---

_WORDS = "SELECT o_custkey % 500 AS doc_id, 1 AS page, 1 AS block, 1 AS paragraph, o_orderkey AS line, k AS id, 'w' || k || '-' || o_orderkey AS text, 0.1 + 0.3 * k + CASE WHEN k = 1 THEN 0.0001 * (o_orderkey % 700) ELSE 0 END AS x, o_orderkey / 1000000.0 AS y, 0.05 AS width, 0.01 AS height FROM orders, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks WHERE k < 2 OR o_orderkey % 3 = 0"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _sql(spark, sf_dir, _WORDS, "orders")
    return w.select(*[F.col(c).cast("double").alias(c) if c in ("x", "y", "width", "height") else F.col(c) for c in w.columns])


_TABLE = f"""WITH w AS (SELECT doc_id, line, id, text, x::DOUBLE AS x, y::DOUBLE AS y, count(*) OVER (PARTITION BY doc_id, line) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY x, id) - 1 AS place FROM ({_WORDS})),
r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY ry, line) - 1 AS row FROM (SELECT *, first_value(y) OVER (PARTITION BY doc_id, line ORDER BY x, id) AS ry FROM w WHERE n >= 2)), f AS (SELECT * FROM r WHERE row < 200),
s AS (SELECT doc_id, count(DISTINCT row) AS rows, least(min(n), 32)::INT AS columns, min(x) AS x, min(y) AS y, max(x + 0.05) - min(x) AS width, max(y + 0.01) - min(y) AS height FROM f GROUP BY 1 HAVING count(DISTINCT row) >= 2),
a AS (SELECT f.doc_id, place, avg(f.x) AS anchor FROM f JOIN s ON f.doc_id = s.doc_id AND place < columns GROUP BY 1, 2),
g AS (SELECT f.doc_id, avg((abs(f.x - anchor) <= 0.04)::INT) AS score FROM f JOIN a ON f.doc_id = a.doc_id AND f.place = a.place GROUP BY 1)"""


@query(f"{_TABLE} SELECT s.doc_id, rows, columns, round(score, 3) AS score, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM s JOIN g ON s.doc_id = g.doc_id WHERE score >= 0.6")
def word_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tables(_words(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("x", "y", "width", "height")})


@query(f"""{_TABLE}, p AS (SELECT f.doc_id, f.row, f.x, f.id, f.text, arg_min(a.place, (abs(f.x - anchor), a.place)) AS "column" FROM f JOIN g ON f.doc_id = g.doc_id AND score >= 0.6 JOIN a ON a.doc_id = f.doc_id GROUP BY ALL)
SELECT doc_id, row::INT AS row, "column"::INT AS "column", string_agg(text, ' ' ORDER BY x, id) AS text, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_cells(_words(spark, sf_dir)).withColumn("row", F.col("row").cast("int")).withColumn("column", F.col("column").cast("int"))


@query(f"SELECT doc_id, line, id, row_number() OVER (PARTITION BY doc_id, line ORDER BY x, id)::INT AS place FROM ({_WORDS})")
def words_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.words_in_order(_words(spark, sf_dir), ["doc_id", "line"]).select("doc_id", "line", "id", "place")
