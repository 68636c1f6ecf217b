"""Registered queries of whole files of interchange, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import interchange as I
from quireframe.plans.export_queries import _TABLE, _words
from quireframe.plans.queries import _t, query
from quireframe.plans.value_queries import _sql

_esc = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_discount"


# The lines of an order are the fields of a form, and each gives a value to a field that a part names.
@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) - 1 AS "at" FROM lineitem),
f AS (SELECT l_orderkey AS doc_id, "at", 'f' || l_linenumber AS id, 'n' || l_partkey AS name, CASE l_returnflag WHEN 'N' THEN 'number' WHEN 'R' THEN 'select' ELSE 'text' END AS type, l_linestatus AS option, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "at") AS nth, CASE WHEN l_linenumber > l_quantity THEN 'bad-range' WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "at") > 1 THEN 'duplicate-id' WHEN row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY "at") > 1 THEN 'duplicate-name' END AS code FROM l),
v AS (SELECT l_orderkey AS doc_id, l."at", 'f' || (1 + l_partkey % 8) AS id, f.name, f.type, CASE WHEN l_discount >= 0.05 THEN l_quantity::INT::VARCHAR ELSE l_linestatus END AS value, CASE WHEN f.id IS NULL THEN 'unknown-field' WHEN CASE f.type WHEN 'number' THEN l_discount < 0.05 WHEN 'select' THEN l_discount >= 0.05 OR l_linestatus <> option ELSE l_discount >= 0.05 END THEN 'bad-value' END AS code FROM l LEFT JOIN f ON f.doc_id = l_orderkey AND f.id = 'f' || (1 + l_partkey % 8) AND nth = 1),
r AS (SELECT doc_id, 'field' AS kind, "at", id, name, type, NULL AS value, code FROM f UNION ALL SELECT doc_id, 'value', * EXCLUDE (doc_id) FROM v)
SELECT doc_id, kind, "at"::INT AS "at", id, name, type, value, code, max(code) OVER (PARTITION BY doc_id) IS NULL AS accepted FROM r WHERE doc_id % 11 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 'file', NULL::INT, NULL, NULL, NULL, NULL, 'bad-format', false FROM l WHERE l_orderkey % 11 = 0""")
def forms_interchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eleventh of the forms is of another format."""
    q, number = F.col("l_quantity").cast("int"), F.col("l_discount") >= 0.05
    kind = F.when(F.col("l_returnflag") == "N", "number").when(F.col("l_returnflag") == "R", "select").otherwise("text")
    field = F.struct(
        F.concat(F.lit("f"), "l_linenumber").alias("id"), F.concat(F.lit("n"), "l_partkey").alias("name"), kind.alias("type"), F.lit(1).alias("page"), F.array(F.lit(0), F.lit(0), q, q).alias("rectangle"),
        F.when(kind == "select", F.array("l_linestatus", F.lit("X"))).alias("options"), F.struct(F.col("l_linenumber").alias("min"), q.alias("max")).alias("validation"),
    )
    value = F.concat(F.lit('{"id":"f'), (1 + F.col("l_partkey") % 8).cast("string"), F.lit('","value":'), F.when(number, q.cast("string")).otherwise(F.concat(F.lit('"'), "l_linestatus", F.lit('"'))), F.lit("}"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_LINE_ORDER.split(", "), F.to_json(field).alias("f"), value.alias("v")).alias("s"))
    forms = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s"))
    form = F.when(F.col("l_orderkey") % 11 == 0, "forms-v0").otherwise("forms-v1")
    text = F.concat(F.lit('{"format":"'), form, F.lit('","fields":['), F.array_join("s.f", ","), F.lit('],"values":['), F.array_join("s.v", ","), F.lit("]}"))
    return I.imported_forms(forms.select(F.col("l_orderkey").alias("doc_id"), text.alias("json")), "forms-v1")


_TURNS = "SELECT conv_id AS doc_id, turn AS at, min(role) AS role, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn"


@query(f"""WITH t AS ({_TURNS.replace("AS at", 'AS "at"')}), c AS (SELECT doc_id, "at", 0 AS k, doc_id || '-' || "at" AS id, 'annotation' AS kind, coalesce(role, '') AS author, coalesce(text, '') AS text FROM t UNION ALL SELECT doc_id, "at", 1, doc_id || '-' || CASE WHEN "at" % 40 = 39 THEN '0' ELSE "at" || '.r' END, 'comment', 'r', 'to "' || role || '"' FROM t WHERE role <> 'user'),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "at", k) AS o FROM c),
g AS (SELECT doc_id, count(*) AS n_comments, count(DISTINCT id) < count(*) AS forged, '[' || string_agg('{{"annotationId":"' || doc_id || '-' || "at" || '","author":' || to_json(author)::VARCHAR || ',"id":"' || id || '","kind":"' || kind || '","order":' || o || ',"page":1,"text":' || to_json(text)::VARCHAR || '}}', ',' ORDER BY o) || ']' AS l FROM n GROUP BY doc_id),
s AS (SELECT doc_id, sha256('source ' || doc_id) AS sha, count(*) AS revision FROM t GROUP BY doc_id)
SELECT g.doc_id, n_comments, sha256(l) AS digest, CASE WHEN NOT forged THEN '{{"commentCount":' || n_comments || ',"commentSha256":"' || sha256(l) || '","comments":' || l || ',"revision":' || revision || ',"sourceSha256":"' || sha || '"}}' END AS envelope, CASE WHEN forged THEN 'forged-id' END AS code FROM g JOIN s ON g.doc_id = s.doc_id""")
def comment_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as annotations, those of others than users with a reply; some late replies bear a used name."""
    t = _sql(spark, sf_dir, _TURNS, "conversations")
    name = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("at").cast("string"))
    reply = F.struct(F.when(F.col("at") % 40 == 39, F.concat(F.col("doc_id").cast("string"), F.lit("-0"))).otherwise(F.concat(name, F.lit(".r"))).alias("id"), F.lit("r").alias("author"), F.concat(F.lit('to "'), "role", F.lit('"')).alias("text"))
    replies = F.filter(F.array(reply), lambda r: F.col("role") != "user")
    notes = t.select("doc_id", "at", name.alias("id"), F.lit(1).alias("page"), F.col("role").alias("author"), "text", replies.alias("replies"))
    sources = t.groupBy("doc_id").agg(F.count("*").alias("revision")).withColumn("sha256", F.sha2(F.concat(F.lit("source "), F.col("doc_id").cast("string")), 256))
    return I.comment_envelopes(notes, sources)


_LIMITS = ["Local review only.", 'Not "certified" & not signed.']
_CHECKS = """SELECT l_orderkey AS doc_id, l_linenumber AS at, concat('line.', l_partkey) AS check, CASE WHEN l_returnflag = 'N' THEN 'pass' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'fail' WHEN l_linestatus = 'F' THEN 'warning' ELSE 'not-checked' END AS status, concat('Part <', l_partkey, '> & "', l_suppkey, '"') AS summary, concat('{"tax": ', CAST(round(l_tax * 100) AS INT), ', "line": [', l_linenumber, ', "', l_returnflag, '"]}') AS evidence FROM lineitem"""
_E = """'{"line":[' || "at" || ',"' || flag || '"],"tax":' || tax || '}'"""


@query(f"""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS "at", 'line.' || l_partkey AS "check", CASE WHEN l_returnflag = 'N' THEN 'pass' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'fail' WHEN l_linestatus = 'F' THEN 'warning' ELSE 'not-checked' END AS status, 'Part <' || l_partkey || '> & "' || l_suppkey || '"' AS summary, l_returnflag AS flag, round(l_tax * 100)::INT AS tax FROM lineitem),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'warning') AS w, count(*) FILTER (status = 'fail') AS f, count(*) FILTER (status = 'not-checked') AS u,
 string_agg('{{"evidence":' || {_E} || ',"id":"' || "check" || '","status":"' || status || '","summary":' || to_json(summary)::VARCHAR || '}}', ',' ORDER BY "at", "check", status, {_E}, summary) AS j,
 string_agg('    <check id="' || "check" || '" status="' || status || '">' || chr(10) || '      <summary>' || {_esc("summary")} || '</summary>' || chr(10) || '      <evidence encoding="canonical-json">' || {_esc(_E)} || '</evidence>' || chr(10) || '    </check>' || chr(10), '' ORDER BY "at", "check", status, {_E}, summary) AS x FROM c GROUP BY doc_id),
d AS (SELECT o_orderkey AS doc_id, sha256(o_orderpriority || o_orderkey) AS sha, count(*) AS pages FROM orders GROUP BY o_orderkey, o_orderpriority),
b AS (SELECT d.doc_id, sha, pages, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(w, 0) AS w, coalesce(f, 0) AS f, coalesce(u, 0) AS u, coalesce(j, '') AS j, coalesce(x, '') AS x, CASE WHEN f > 0 THEN 'fail' WHEN w > 0 OR u > 0 THEN 'review-required' ELSE 'pass' END AS status FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
h AS (SELECT *, sha256('{{"authoritative":false,"checks":[' || j || '],"counts":{{"fail":' || f || ',"not-checked":' || u || ',"pass":' || p || ',"warning":' || w || '}},"document":{{"pageCount":' || pages || ',"sha256":"' || sha || '"}},"kind":"preflight-review","limitations":["Local review only.","Not \\"certified\\" & not signed."],"localOnly":true,"profile":{{"fixed":true,"id":"print-review"}},"schemaVersion":1,"status":"' || status || '"}}') AS digest FROM b)
SELECT doc_id, status, digest, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<preflight-review schema-version="1" local-only="true" authoritative="false" report-sha256="' || digest || '">' || chr(10) || '  <profile id="print-review" fixed="true"/>' || chr(10) || '  <document sha256="' || sha || '" page-count="' || pages || '"/>' || chr(10) || '  <result status="' || status || '">' || chr(10) || '    <counts pass="' || p || '" warning="' || w || '" fail="' || f || '" not-checked="' || u || '"/>' || chr(10) || '  </result>' || chr(10) || '  <checks count="' || n || '">' || chr(10) || x || '  </checks>' || chr(10) || '  <limitations count="2">' || chr(10) || '    <limitation>Local review only.</limitation>' || chr(10) || '    <limitation>Not &quot;certified&quot; &amp; not signed.</limitation>' || chr(10) || '  </limitations>' || chr(10) || '</preflight-review>' || chr(10) AS xml, NULL::VARCHAR AS code FROM h""")
def check_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as checks of a document for each order."""
    documents = _t(spark, sf_dir, "orders").groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("pages")).select(F.col("o_orderkey").alias("doc_id"), F.sha2(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")), 256).alias("sha256"), "pages")
    return I.check_reports(_sql(spark, sf_dir, _CHECKS, "lineitem"), documents, "print-review", _LIMITS)


@query("""WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, 'w' || l_partkey AS id, '<' || l_returnflag || '>' AS text, l_suppkey AS confidence, l_discount AS x, l_quantity / 64 AS y, l_tax AS width, 0.25::DOUBLE AS height FROM lineitem),
e AS (SELECT *, '{"id":"' || id || '","text":"' || text || '","confidence":' || confidence || ',"bounds":{"x":' || x || ',"y":' || y || ',"width":' || width || ',"height":0.25}}' AS j, '<span data-confidence="' || confidence || '" style="left:' || format('{:.4f}', x * 100) || '%;top:' || format('{:.4f}', y * 100) || '%;width:' || format('{:.4f}', width * 100) || '%;height:25.0000%">&lt;' || substr(text, 2, 1) || '&gt;</span>' AS s FROM w),
p AS (SELECT doc_id, page, 792 - 132 * (page - 1) AS high, count(*) AS n, CASE WHEN page = 7 THEN 'bad-size' WHEN max(y) > 0.75 THEN 'bad-word' END AS code, string_agg(j, ',' ORDER BY y, x, id, j) AS j, string_agg(s, '' ORDER BY y, x, id, j) AS s FROM e GROUP BY doc_id, page),
d AS (SELECT doc_id, count(*) AS n_pages, sum(n)::BIGINT AS n_words, arg_min(code, page) FILTER (code IS NOT NULL) AS code, string_agg('{"page":' || page || ',"width":612,"height":' || high || ',"words":[' || j || ']}', ',' ORDER BY page) AS j, string_agg('<section><h2>Page ' || page || '</h2><div class="ocr-page" style="aspect-ratio:612/' || high || '">' || s || '</div></section>', '' ORDER BY page) AS s FROM p GROUP BY doc_id)
SELECT doc_id, n_pages, n_words, CASE WHEN code IS NULL THEN '{"schemaVersion":1,"pages":[' || j || ']}' END AS json, CASE WHEN code IS NULL THEN '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Lines &amp; pages</title><style>.ocr-page{position:relative}.ocr-page span{position:absolute}</style></head><body><h1>Lines &amp; pages</h1>' || s || '</body></html>' END AS html, code FROM d""")
def layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as words on pages that get lower and lower; a seventh page has no height, and large quantities reach
    beyond their page."""
    lines = _t(spark, sf_dir, "lineitem")
    n, k = F.col("l_linenumber"), F.col("l_orderkey").alias("doc_id")
    words = lines.select(k, n.alias("page"), F.concat(F.lit("w"), "l_partkey").alias("id"), F.concat(F.lit("<"), "l_returnflag", F.lit(">")).alias("text"), F.col("l_suppkey").alias("confidence"), F.col("l_discount").alias("x"), (F.col("l_quantity") / 64).alias("y"), F.col("l_tax").alias("width"), F.lit(0.25).alias("height"))
    sizes = lines.select(k, n.alias("page")).distinct().select("*", F.lit(612).alias("points_wide"), (792 - 132 * (F.col("page") - 1)).alias("points_high"))
    return I.layout_documents(words, sizes, "Lines & pages")


@query(f"""{_TABLE}, p AS (SELECT f.doc_id, f.row, f.x, f.id, f.text, arg_min(a.place, (abs(f.x - anchor), a.place)) AS k FROM f JOIN g ON f.doc_id = g.doc_id AND score >= 0.6 JOIN a ON a.doc_id = f.doc_id GROUP BY ALL),
c AS (SELECT doc_id, row, k, string_agg(text, ' ' ORDER BY x, id) AS text FROM p GROUP BY 1, 2, 3), q AS (SELECT s.doc_id, rows, columns, row, unnest(range(columns)) AS k FROM s JOIN (SELECT DISTINCT doc_id, row FROM c) r ON r.doc_id = s.doc_id),
l AS (SELECT q.doc_id, rows, columns, q.row, string_agg('"' || replace(coalesce(text, ''), '"', '""') || '"', ',' ORDER BY q.k) || chr(13) || chr(10) AS line FROM q LEFT JOIN c ON c.doc_id = q.doc_id AND c.row = q.row AND c.k = q.k GROUP BY 1, 2, 3, 4)
SELECT doc_id, rows, columns, string_agg(line, '' ORDER BY row) AS csv FROM l GROUP BY 1, 2, 3""")
def layout_table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table_csv(_words(spark, sf_dir))
