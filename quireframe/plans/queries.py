"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import measures as M
from quireframe.operators import graph as G
from quireframe.operators import records as R
from quireframe.operators import sensitive as S
from quireframe.operators import text as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _firsts(spark: SparkSession, sf_dir: str, name: str, keys: list[str], *columns: str) -> DataFrame:
    """Of a table's rows that share ``keys`` the first, by file and by row in it, whatever the number of tasks."""
    at = F.struct("_metadata.file_path", "_metadata.row_index")
    return _t(spark, sf_dir, name).groupBy(*keys).agg(F.min_by(F.struct(*columns), at).alias("_first")).select(*keys, "_first.*")


_TOKENS = r"""list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s.-]', ' ', 'g'), '\s+'), lambda t: t <> '')"""
_STOP = "(" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_TERMS = f"""terms AS (SELECT doc_id, p - 1 AS pos, toks[p] AS term FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS p FROM (SELECT doc_id, {_TOKENS} AS toks FROM documents)) WHERE length(toks[p]) >= 3 AND toks[p] NOT IN {_STOP})"""
_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^{X.SPACES}+', ''), '{X.SPACES}+$', '')"
_SENT = rf"""sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, text FROM (SELECT doc_id, i, {_TRIM("s[i]")} AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){X.SPACES}+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents))) WHERE text <> '')"""
_PAGES = "pages_ AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS page, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


_KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'distance' WHEN 2 THEN 'perimeter' ELSE 'area' END"
_MEASURED = f"""SELECT l_returnflag AS tool, l_linestatus AS style, kind, CASE WHEN kind = 'count' THEN 'uncalibrated' ELSE 'cal-' || l_suppkey % 3 END AS calibration,
CASE kind WHEN 'count' THEN 'count' WHEN 'area' THEN 'area' ELSE 'length' END AS dimension, CASE kind WHEN 'count' THEN 'count' WHEN 'area' THEN 'm2' ELSE 'm' END AS si_unit,
CASE kind WHEN 'count' THEN 'count' WHEN 'area' THEN 'ft2' ELSE 'ft' END AS display_unit, l_quantity AS value, l_orderkey || ':' || l_linenumber AS member FROM (SELECT *, {_KIND} AS kind FROM lineitem)"""
_LEGEND = ["tool", "style", "kind", "calibration", "dimension", "si_unit", "display_unit"]


def digest_sum_sql(member: str) -> str:
    return f"sum(('0x' || substr(sha256({member}), 1, 15))::BIGINT)::VARCHAR"


@query(f"SELECT {', '.join(_LEGEND)}, count(*) AS n, round(sum(value), 6) AS total, {digest_sum_sql('member')} AS provenance FROM ({_MEASURED}) GROUP BY ALL")
def measurement_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return R.legend(spark.sql(_MEASURED), _LEGEND, "value", "member")


@query(f"SELECT *, row_number() OVER (PARTITION BY {', '.join(_LEGEND)} ORDER BY member, value)::INT AS place FROM ({_MEASURED})")
def legend_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return R.legend_members(spark.sql(_MEASURED), _LEGEND, "value", "member")


@query(f"WITH {_PAGES} SELECT doc_id, page::INT AS page, text FROM pages_")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pages_of(_t(spark, sf_dir, "documents"))


def _located_sql(pattern: str) -> str:
    return rf"""WITH {_PAGES}, m AS (
  SELECT doc_id, page, regexp_extract_all(text, '{pattern}') AS f, regexp_split_to_array(text, '{pattern}') AS g FROM pages_ WHERE regexp_matches(text, '{pattern}')
), e AS (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM m)
SELECT doc_id, page::INT AS page, k::INT AS match_no,
  (list_sum([length(x) for x in g[1:k]]) + coalesce(list_sum([length(x) for x in f[1:k-1]]), 0))::INT AS start,
  (list_sum([length(x) for x in g[1:k]]) + list_sum([length(x) for x in f[1:k]]))::INT AS "end", f[k] AS "match" FROM e"""


@query(_located_sql(r"(?i)tion"))
def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_rows(X.pages_of(_t(spark, sf_dir, "documents")), X.literal_pattern("tion"))


@query(_located_sql(r"(?is)the.{0,256}?on."))
def wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_rows(X.pages_of(_t(spark, sf_dir, "documents")), X.wildcard_pattern("the*on?"))


@query(
    rf"""WITH {_PAGES}, b AS (SELECT doc_id, page, text, lower(text) AS t, unnest(range(1, length(text))) AS s FROM pages_ WHERE regexp_matches(text, '(?is)th.*n')),
e AS (SELECT *, instr(substr(t, s + 2, 257), 'n') AS k FROM b WHERE substr(t, s, 2) = 'th'),
c AS (SELECT doc_id, page, text, s - 1 AS start, s + 1 + k AS "end" FROM e WHERE k > 0),
w AS (SELECT doc_id, page, min(start) AS start, "end", first(text) AS text FROM c WHERE NOT regexp_matches(substr(text, start, (start > 0)::INT), '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(substr(text, "end" + 1, 1), '[\p{{L}}\p{{N}}_]') GROUP BY doc_id, page, "end")
SELECT doc_id, page::INT AS page, row_number() OVER (PARTITION BY doc_id, page ORDER BY start)::INT AS match_no, start::INT AS start, "end"::INT AS "end", substr(text, start + 1, "end" - start) AS "match" FROM w"""
)
def whole_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_rows(X.pages_of(_t(spark, sf_dir, "documents")), X.wildcard_pattern("th*n", whole_word=True))


@query(_located_sql(r"\b" + X.EMAIL + r"\b"))
def email_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_rows(X.pages_of(_t(spark, sf_dir, "documents")), S.EMAIL)


@query(f"WITH {_TERMS} SELECT doc_id, term, count(*) AS tf, min(pos)::INT AS first_pos FROM terms GROUP BY 1, 2")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.term_frequency(_t(spark, sf_dir, "documents"))


@query(f"WITH {_TERMS} SELECT term, count(DISTINCT doc_id) AS df FROM terms WHERE length(term) > 3 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.document_frequency(_t(spark, sf_dir, "documents"))


@query(f"WITH {_TERMS}, f AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS p FROM terms GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, p) AS rank FROM f) SELECT doc_id, rank::INT AS rank, term, tf FROM r WHERE rank <= 12")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_terms(_t(spark, sf_dir, "documents"), 12)


@query(f"WITH {_SENT} SELECT doc_id, idx::INT AS idx, text AS sentence FROM sent")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sentences(_t(spark, sf_dir, "documents"))


@query(
    f"""WITH {_TERMS}, {_SENT}, tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
w AS (SELECT doc_id, idx, unnest({_TOKENS}) AS term FROM sent),
sc AS (SELECT w.doc_id, idx, sum(coalesce(tf, 0)) / count(*) AS score FROM w LEFT JOIN tf USING (doc_id, term) WHERE term NOT IN {_STOP} GROUP BY 1, 2),
r AS (SELECT s.doc_id, s.idx, s.text, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, s.idx) AS k FROM sent s LEFT JOIN sc ON s.doc_id = sc.doc_id AND s.idx = sc.idx)
SELECT doc_id, idx::INT AS idx, text AS sentence FROM r WHERE k <= 2"""
)
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.summary(_t(spark, sf_dir, "documents"), 2)


_QUESTION = "What is the value of the contract tion?"


@query(
    f"""WITH {_SENT}, s AS (SELECT *, len(list_filter({_TOKENS}, lambda t: t IN ('what', 'value', 'contract', 'tion'))) AS score FROM sent),
b AS (SELECT doc_id, arg_max(text, (score, -idx)) AS answer, least(1.0, max(score) / 4.0)::DOUBLE AS confidence FROM s WHERE score > 0 GROUP BY doc_id)
SELECT doc_id, answer, coalesce(confidence, 0) AS confidence FROM documents LEFT JOIN b USING (doc_id)"""
)
def ask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ask(_t(spark, sf_dir, "documents"), _QUESTION)


def _distinct_in_order(pattern: str) -> str:
    return rf"array_to_string([x for x, i in regexp_extract_all(text, '{pattern}') if list_position(regexp_extract_all(text, '{pattern}'), x) = i][1:50], '|')"


_EXTRACTED = f"""WITH {_TERMS}, f AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS p FROM terms GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, p) AS rank FROM f),
k AS (SELECT doc_id, string_agg(term || ':' || tf, '|' ORDER BY rank) AS keywords FROM r WHERE rank <= 20 GROUP BY 1)
SELECT doc_id, {_distinct_in_order(X.EMAIL)} AS emails, {_distinct_in_order("\\b" + X.DATE + "\\b")} AS dates, {_distinct_in_order(X.AMOUNT)} AS amounts, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN k USING (doc_id)"""


@query(_EXTRACTED)
def structured_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extracted(_t(spark, sf_dir, "documents"))


_PROOFREAD = rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '{X.SPACES}+', ' ', 'g'), ' ([,.!?;:])', '\1', 'g'), '\bi\b', 'I', 'g')) AS clean FROM documents"


@query(_PROOFREAD)
def proofread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every language, and those without one."""
    return _t(spark, sf_dir, "documents").select("doc_id", X.proofread(F.col("text")).alias("clean"))


_WORD = X.WORD.replace("'", "''")


@query(
    rf"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word FROM benchmark),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word FROM documents)
SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN (SELECT word FROM d) GROUP BY 1, 2"""
)
def spell_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.unknown_words(_t(spark, sf_dir, "documents"), _dictionary(spark, sf_dir))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0))).alias("word")).distinct()


@query(
    f"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word FROM benchmark), m AS ({_located_sql(_WORD)})
SELECT doc_id, page, start AS "offset", length("match")::INT AS length, sha256("match") AS digest FROM m WHERE lower("match") NOT IN (SELECT word FROM d)"""
)
def spelling_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.spelling_findings(X.pages_of(_t(spark, sf_dir, "documents")), _dictionary(spark, sf_dir))


_HTML = "html"
for _p, _r in X.MARKUP:
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_r}', 'g')"
for _e, _c in X.ENTITIES:
    _HTML = f"replace({_HTML}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
_HTML = rf"regexp_replace(regexp_replace(replace({_HTML}, chr(13), ''), '\n[\t ]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, {_TRIM(_HTML)} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query(f"WITH {_PAGES} SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || regexp_replace(text, '{X.SPACES}+$', ''), chr(10) || chr(10) ORDER BY page) AS export FROM pages_ GROUP BY doc_id")
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.export_text(X.pages_of(_t(spark, sf_dir, "documents")))


@query(r"SELECT event_id, CASE WHEN regexp_matches(cell, '^(?:[\t\r\n]|\s*[=+@-])') THEN '''' || cell ELSE cell END AS cell FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '=' WHEN 1 THEN ' -' ELSE '' END || event_type AS cell FROM events)")
def safe_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    cell = F.concat(F.when(k == 0, "=").when(k == 1, " -").otherwise(""), F.col("event_type"))
    return _t(spark, sf_dir, "events").select("event_id", X.spreadsheet_safe(cell).alias("cell"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND lower(concat_ws(' ', o_orderpriority, o_orderstatus)) LIKE '%urg%'")
def annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return R.matching(o, "URG", ["o_orderpriority", "o_orderstatus"], o_orderstatus="F")


@query("SELECT event_id, event_type, user_id FROM events")
def annotation_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sorted_as_text(_t(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "user_id", "event_id", descending=True)


@query(
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted'
WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_custkey IS NOT DISTINCT FROM b.o_custkey THEN 'unchanged' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    later = o.filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return R.keyed_diff(o.filter("o_orderkey % 7 <> 0"), later, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query(
    """SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(user_id) = 0 THEN 'user_id' ELSE 'all' END AS facet,
coalesce(event_type, user_id::VARCHAR, '') AS value, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())"""
)
def facet_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histograms(_t(spark, sf_dir, "events"), ["event_type", "user_id"])


_STATUS = "CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'click' THEN 'warning' WHEN event_type = 'view' THEN 'not-checked' ELSE 'pass' END"


@query(f"WITH s AS (SELECT {_STATUS} AS st FROM events) SELECT count(*) FILTER (st = 'pass') AS pass, count(*) FILTER (st = 'warning') AS warning, count(*) FILTER (st = 'fail') AS fail, count(*) FILTER (st = 'not-checked') AS not_checked, CASE WHEN count(*) FILTER (st = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (st IN ('warning', 'not-checked')) > 0 THEN 'review-required' ELSE 'pass' END AS overall FROM s")
def preflight_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.expr(_STATUS).alias("st"))
    return R.status_counts(e, "st", ["pass", "warning", "fail", "not-checked"])


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS start FROM lineitem WHERE l_linenumber % 2 = 1 AND (l_orderkey % 3 <> 0 OR l_linenumber > 1)), w AS (SELECT *, lag(start) OVER o AS b, lead(start) OVER o AS a FROM s WINDOW o AS (PARTITION BY l_orderkey ORDER BY start))
SELECT l_orderkey, start, coalesce(a - 1, 7)::INT AS "end", bool_and(CASE WHEN b IS NULL THEN start = 1 ELSE start > b END AND start <= 7) OVER (PARTITION BY l_orderkey) AS valid FROM w""")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "lineitem").filter("l_linenumber % 2 = 1 AND (l_orderkey % 3 <> 0 OR l_linenumber > 1)").select("l_orderkey", F.col("l_linenumber").alias("start"))
    return R.section_ends(s, "l_orderkey", "start", F.lit(7))


@query(
    """WITH n AS (SELECT user_id, event_id, event_type, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 1) AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n)
SELECT user_id, run::BIGINT AS run, first(event_type) AS event_type, min(event_id) AS begins, count(*) AS n FROM r GROUP BY user_id, run"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runs(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, 'A-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || '/x' AS label FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 996 AS n FROM lineitem)")
def bates_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbered(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", "A-", 997, 3, "/x")


_LABELS = "(VALUES (1, 'r', 'i-', 1), (4, 'D', 'p', 5), (6, 'A', '', 25), (9, 'none', 'cover', NULL), (12, 'R', NULL, 1998)) AS v(start, style, prefix, first)"
_UNITS = {d: "(CASE n // {d} % 10 " + "".join(f"WHEN {i} THEN '{x}' " for i, x in enumerate(of)) + "END)" for d, of in ((100, ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")), (10, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), (1, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))}
_ROMAN = "repeat('M', (n // 1000)::INT) || " + " || ".join(x.replace("{d}", str(d)) for d, x in _UNITS.items())


@query(
    f"""WITH {_PAGES}, rg AS (SELECT * FROM (SELECT DISTINCT doc_id FROM pages_), {_LABELS}),
j AS (SELECT p.doc_id, p.page, r.style, coalesce(r.prefix, '') AS prefix, r.first + p.page - r.start AS n FROM pages_ p ASOF JOIN rg r ON p.doc_id = r.doc_id AND p.page >= r.start)
SELECT doc_id, page::INT AS page, prefix || CASE style WHEN 'D' THEN n::VARCHAR WHEN 'A' THEN repeat(chr((65 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT) WHEN 'R' THEN {_ROMAN} WHEN 'r' THEN lower({_ROMAN}) ELSE '' END AS label FROM j"""
)
def page_label_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pages_of(_t(spark, sf_dir, "documents")).select("doc_id", "page")
    ranges = p.select("doc_id").distinct().crossJoin(F.broadcast(spark.sql(f"SELECT * FROM {_LABELS}")))  # five ranges for each document
    return R.page_labels(p, ranges)


@query(
    f"""WITH {_PAGES}, b AS (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN 'b' ELSE 'a' END AS source FROM pages_),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source ORDER BY page) AS k FROM b)
SELECT doc_id, page::INT AS page, source, row_number() OVER (PARTITION BY doc_id ORDER BY k, source)::INT AS position FROM n"""
)
def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pages_of(_t(spark, sf_dir, "documents")).select("doc_id", "page")
    return R.interleave(p.filter("page % 3 <> 0"), p.filter("page % 3 = 0"))


@query(f"WITH {_PAGES} SELECT doc_id, page::INT AS page, ((page - 1) // 3 + 1)::INT AS part, ((page - 1) // 4)::INT AS sheet, (((page - 1) % 4) // 2)::INT AS row, ((page - 1) % 2)::INT AS col FROM pages_")
def split_and_impose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.imposed(R.split_every(X.pages_of(_t(spark, sf_dir, "documents")).select("doc_id", "page"), 3), 2, 2)


@query(f"WITH {_PAGES} SELECT doc_id, page::INT AS page, unnest(CASE WHEN page % 2 = 0 THEN [1, 2] ELSE [1] END)::INT AS copy FROM pages_")
def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicated(X.pages_of(_t(spark, sf_dir, "documents")).select("doc_id", "page"), F.col("page") % 2 == 0)


@query(f"WITH {_PAGES}, g AS (SELECT doc_id, page, page % 5 = 0 OR page = 1 AS gone FROM pages_), k AS (SELECT *, NOT bool_and(gone) OVER (PARTITION BY doc_id) AS kept FROM g) SELECT doc_id, page::INT AS page, kept FROM k WHERE NOT gone OR NOT kept")
def delete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pages_of(_t(spark, sf_dir, "documents")).select("doc_id", "page")
    return R.retained(p, (F.col("page") % 5 == 0) | (F.col("page") == 1), "doc_id")


_ZONES = "SELECT l_orderkey AS page, l_linenumber AS id, l_discount * 100 AS x, l_tax * 100 AS y, l_quantity / 10 AS w, l_quantity / 10 AS h FROM lineitem"


@query(f"WITH z AS ({_ZONES}) SELECT a.page, a.id AS left_id, b.id AS right_id FROM z a JOIN z b ON a.page = b.page AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def zone_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS id", "l_discount * 100 AS x", "l_tax * 100 AS y", "l_quantity / 10 AS w", "l_quantity / 10 AS h")
    return R.overlapping(z, "page")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS depth FROM lineitem) SELECT a.l_orderkey, a.l_linenumber, a.depth, (SELECT max(b.l_linenumber) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.depth < a.depth) AS parent FROM r a")
def tag_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("depth"))
    return R.tree_parents(rows, "l_orderkey", "l_linenumber", "depth")


_REFERENCES = "SELECT p_partkey AS dst, p_partkey // 4 AS src FROM part WHERE p_partkey > 3 AND p_partkey % 50 <> 7 UNION ALL SELECT p_partkey // 8, p_partkey FROM part WHERE p_partkey % 8 = 0"


@query(
    f"""WITH RECURSIVE e AS ({_REFERENCES}), t(node) AS (SELECT p_partkey FROM part WHERE p_partkey <= 2 UNION SELECT e.dst FROM t JOIN e ON e.src = t.node WHERE e.dst > 0)
SELECT p_partkey AS node, p_partkey IN (SELECT node FROM t) AS reachable FROM part"""
)
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    down = part.filter("node > 3 AND node % 50 <> 7").select(F.expr("node div 4").alias("src"), F.col("node").alias("dst"))
    up = part.filter("node % 8 = 0").select(F.col("node").alias("src"), F.expr("node div 8").alias("dst"))  # so that there are cycles
    return G.reachability(part, down.unionByName(up), part.filter("node <= 2"))


@query("SELECT p_partkey, p_size, round(abs((0 * 0 - p_size * 0) + (p_size * p_retailprice - p_size * 0) + (p_size * p_retailprice - 0 * p_retailprice) + (0 * 0 - 0 * p_retailprice)) / 2, 6) AS area, round(2 * (p_size + p_retailprice), 6) AS perimeter, round(p_retailprice * 0.3048, 6) AS metres FROM part")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice")
    zero = F.lit(0.0)
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))])
    return _t(spark, sf_dir, "part").select("p_partkey", "p_size", F.round(M.area(points), 6).alias("area"), F.round(M.perimeter(points), 6).alias("perimeter"), F.round(h * M.METRES["ft"], 6).alias("metres"))


def _lum(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


@query(f"WITH l AS (SELECT p_partkey, {_lum('(p_partkey % 256)')} AS a FROM part) SELECT p_partkey, round(1.05 / (a + 0.05), 6) AS ratio, CASE WHEN 1.05 / (a + 0.05) < 4.5 THEN 'warning' ELSE 'pass' END AS status FROM l")
def contrast_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey, white = F.col("p_partkey") % 256, F.lit(255)
    ratio = M.contrast(M.luminance(white, white, white), M.luminance(grey, grey, grey))
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(ratio, 6).alias("ratio"), F.when(ratio < 4.5, "warning").otherwise("pass").alias("status"))


@query("SELECT l_orderkey, l_linenumber, round(-(l_quantity + 2) * l_extendedprice / nullif(l_discount * 100 - 5, 0) + l_tax, 4) AS v FROM lineitem")
def formula_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.formula("-(l_quantity+2)*l_extendedprice/(l_discount*100-5)+l_tax")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(f, 4).alias("v"))


@query("SELECT event_id, (minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 18 AND dayofweek(ts) IN (0, 2, 4, 5)) AS due FROM events")
def cron_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", M.cron_matches("*/15 8-18 * * 2-4/2,5,7", F.col("ts")).alias("due"))


@query("WITH s AS (SELECT event_id, event_id * 1000 AS n, 60000 AS i, 7230000 AS now FROM events) SELECT event_id, (CASE WHEN now - n > 3600000 THEN n + (now - n) // i * i ELSE n END)::BIGINT AS next_at FROM s")
def schedule_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", M.catch_up(F.col("event_id") * 1000, F.lit(60_000), F.lit(7_230_000)).alias("next_at"))


#: A card's digits and a character after them, or else a whole group of digits, so that no match begins within one. Pages get
#: a letter at their end, so that there always is one.
_CARD = "(?:[0-9][ -]?){13,19}[^0-9]|[0-9]+"
_CARD_RUNS = _located_sql(_CARD).replace("unnest(p) AS text", "unnest(p) || 'x' AS text")
_CARDS = f"""SELECT doc_id, page, start, (start + length(body))::INT AS "end" FROM (SELECT *, regexp_replace(body, '[ -]', '', 'g') AS d FROM (SELECT doc_id, page, start, regexp_replace("match", '[^0-9]$', '') AS body FROM ({_CARD_RUNS}))) WHERE length(d) BETWEEN 13 AND 19
AND list_sum([CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END ELSE x::INT END for x, i in string_split(d, '')]) % 10 = 0"""


@query(_CARDS)
def payment_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.payment_cards(X.pages_of(_t(spark, sf_dir, "documents"))).select("doc_id", "page", "start", "end")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireframe.streaming.events import hourly

    return hourly(_t(spark, sf_dir, "events"))


from quireframe.plans import export_queries, file_queries, interchange_queries, inventory_queries, job_queries, raster_queries, review_queries, source_queries, structure_queries, value_queries  # noqa: E402, F401 (they register their queries here)
