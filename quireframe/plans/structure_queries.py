"""Registered queries of differences and of the structure that a text's lines tell, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import bounded as B
from quireframe.operators import diff as D
from quireframe.operators import sensitive as S
from quireframe.operators import structure as C
from quireframe.operators import text as X
from quireframe.plans.queries import _CARDS, _PAGES, _SENT, _STOP, _TERMS, _TOKENS, _TRIM, _located_sql, _t, query
from quireframe.plans.review_queries import _two


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents")


# The longest common subsequence is beyond SQL on whole tables; tests compare with a plain table of lengths.
@query()
def token_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_rows(D.page_diffs(*_two(spark, sf_dir), "pair"), "pair")


@query()
def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_totals(D.page_diffs(*_two(spark, sf_dir), "pair"), "pair")


@query()
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.page_diffs(*_two(spark, sf_dir), "pair")
    return D.comparison_report(p, F.sha2((F.col("pair") * 2).cast("string"), 256), F.sha2((F.col("pair") * 2 + 1).cast("string"), 256), "pair")


# A page against itself with two words swapped: what comes out is known without a table.
_SWAP = "SELECT p_partkey AS pair, 1 AS page, 'alpha ' || p_brand || ' gamma' AS a, CASE WHEN p_partkey % 3 = 0 THEN 'alpha delta gamma' WHEN p_partkey % 3 = 1 THEN 'alpha ' || p_brand || '  gamma' END AS b FROM part"


@query("""SELECT p_partkey AS pair, 1 AS page, unnest(CASE WHEN p_partkey % 3 = 0 THEN [1, 2, 3, 4] ELSE [1] END)::INT AS ordinal, unnest(CASE p_partkey % 3 WHEN 0 THEN ['unchanged', 'added', 'deleted', 'unchanged'] WHEN 1 THEN ['unchanged'] ELSE ['deleted'] END) AS kind,
unnest(CASE WHEN p_partkey % 3 = 0 THEN ['alpha', 'delta', p_brand, 'gamma'] ELSE ['alpha ' || p_brand || ' gamma'] END) AS text, unnest(CASE WHEN p_partkey % 3 = 0 THEN [1, 1, 1, 1] ELSE [3] END)::INT AS count FROM part""")
def swapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(_SWAP)
    left = rows.select("pair", "page", F.col("a").alias("text"))
    right = rows.filter("b IS NOT NULL").select("pair", "page", F.col("b").alias("text"))
    return D.diff_rows(D.page_diffs(left, right, "pair"), "pair")


_EMAILS = f"""SELECT doc_id, page, start, "end", 'email' AS kind, 'Email' AS label FROM ({_located_sql(chr(92) + "b" + X.EMAIL + chr(92) + "b")})"""
_LITERAL = f"""SELECT doc_id, page, start, "end", 'custom-literal' AS kind, 'The' AS label FROM ({_located_sql("The")})"""
_REGEX = f"""SELECT doc_id, page, start, "end", 'custom-regex' AS kind, 'Code' AS label FROM ({_located_sql("(?i)abl|[a-c][0-9][0-9]|ab|a")})"""

def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kinds(X.pages_of(_docs(spark, sf_dir)), [("The", "The", False), ("Code", "a|ab|[a-c][0-9][0-9]|abl", True)])


@query(f"""WITH a AS ({_EMAILS}), b AS ({_LITERAL}), c AS ({_REGEX}), d AS (SELECT *, 'payment-card' AS kind, 'Payment card' AS label FROM ({_CARDS})) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""")
def sensitive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds but telephone numbers, whose bounds SQL cannot look at; these are ``phone_matches``."""
    return _kinds(spark, sf_dir).filter("kind != 'phone'")


@query()
def phone_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).filter("kind = 'phone'")


@query(f"""WITH a AS ({_EMAILS} UNION ALL {_LITERAL}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, start, "end", kind, label) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM a) SELECT doc_id, 'match-' || k AS id, page, start, "end", kind, label, c >= 500 AS truncated FROM n WHERE k <= 500""")
def sensitive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report(_kinds(spark, sf_dir).filter("kind IN ('email', 'custom-literal')"))


_FINDING = lambda label, p: f"SELECT doc_id, '{label}' AS label, unnest(range(1, len(m) + 1))::INT AS ordinal, unnest(m) AS v FROM (SELECT doc_id, regexp_extract_all(text, '{p}')[1:50] AS m FROM documents)"


@query(rf"SELECT doc_id, label, ordinal, substr(sha256(v), 1, 16) AS hash, length(v)::INT AS length FROM ({_FINDING('email', X.EMAIL)} UNION ALL {_FINDING('ssn', chr(92) + 'b[0-9]{3}-[0-9]{2}-[0-9]{4}' + chr(92) + 'b')} UNION ALL {_FINDING('phone', chr(92) + 'b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}' + chr(92) + 'b')})")
def redaction_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.findings(_docs(spark, sf_dir))


@query(rf"""WITH {_PAGES}, m AS ({_located_sql("(?i)tion")}), j AS (SELECT m.*, p.text, greatest(m.start - 20, 0) AS a, least(m."end" + 20, length(p.text)) AS b FROM m JOIN pages_ p ON m.doc_id = p.doc_id AND m.page = p.page)
SELECT doc_id, page, match_no, start, "end", "match", substr(text, a + 1, b - a) AS snippet, a::INT AS snippet_start, b::INT AS snippet_end, ltrim(regexp_replace(substr(text, a + 1, start - a), '{X.SPACES}+', ' ', 'g')) AS before, rtrim(regexp_replace(substr(text, "end" + 1, b - "end"), '{X.SPACES}+', ' ', 'g')) AS after FROM j""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.pages_of(_docs(spark, sf_dir))
    return C.snippets(X.match_rows(pages, X.literal_pattern("tion")), pages, 20)


_LINES = r"l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\n+'), lambda t: t <> '') AS x FROM documents)))"
_TRIMMED = rf"l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, list_filter([{_TRIM('t')} for t in string_split_regex(text, '\n+')], lambda t: t <> '') AS x FROM documents)))"
_ROLES = rf"""WITH {_LINES} SELECT doc_id, i::INT AS "order", CASE WHEN i = 1 AND regexp_matches(line, '(?i)^(?:#{{1,6}}\s|(?:chapter|section|part)\b)') THEN 'H1' WHEN regexp_matches(line, '^\s*[-*•]\s') OR regexp_matches(line, '^[0-9]+[.)]\s') THEN 'LBody'
WHEN length(line) < 48 AND regexp_matches(line, '^[A-Z]') AND NOT regexp_matches(line, '[.!?]$') THEN 'H2' ELSE 'P' END AS role, substr(line, 1, 200) AS text FROM l WHERE i <= 100"""


@query(_ROLES)
def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_roles(_docs(spark, sf_dir))


@query(f"""SELECT doc_id, count(*) AS n, sha256(string_agg("order" || ':' || role || ':' || text, chr(10) ORDER BY "order")) AS digest FROM ({_ROLES}) GROUP BY 1""")
def role_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.role_digest(C.line_roles(_docs(spark, sf_dir)))


@query(rf"""WITH {_TERMS}, {_SENT}, {_TRIMMED}, tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), w AS (SELECT doc_id, idx, unnest({_TOKENS}) AS term FROM sent),
sc AS (SELECT w.doc_id, idx, sum(coalesce(tf, 0)) / count(*) AS score FROM w LEFT JOIN tf USING (doc_id, term) WHERE term NOT IN {_STOP} GROUP BY 1, 2),
r AS (SELECT s.doc_id, s.text, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, s.idx) AS k FROM sent s LEFT JOIN sc ON s.doc_id = sc.doc_id AND s.idx = sc.idx),
h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, line AS title FROM l WHERE regexp_matches(line, '(?i)^(?:chapter\b|section\b|#{{1,6}}\s|[A-Z][A-Z0-9 ]{{0,40}}$)'))
SELECT doc_id, ordinal::INT AS ordinal, title FROM h WHERE ordinal <= 50 UNION ALL SELECT doc_id, 1, substr(text, 1, 80) FROM r WHERE k = 1 AND doc_id NOT IN (SELECT doc_id FROM h)""")
def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bookmarks(_docs(spark, sf_dir))


_FORM = r"^([A-Za-z][A-Za-z0-9 /_-]{1,40})\s*[:_]\s*(.*)$"
#: Pages as forms: the region's lines, a label for each nation.
_FORMS = "SELECT n_nationkey AS doc_id, 'Name: ' || n_name || chr(10) || chr(10) || '  Date_ 2026-07-01 ' || chr(10) || 'Amount due :' || chr(10) || 'no value' || chr(10) || 'Total number' || chr(10) || 'Date of birth*' || chr(10) || 'I agree:' || chr(10) || 'E-mail address:*' || chr(10) || '*** date' AS text FROM nation"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _t(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql(_FORMS)


@query(rf"""WITH {_TRIMMED}, h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, line FROM l WHERE i <= 200 AND regexp_matches(line, '{_FORM}'))
SELECT doc_id, ordinal::INT AS ordinal, {_TRIM(f"regexp_extract(line, '{_FORM}', 1)")} AS name, substr(regexp_extract(line, '{_FORM}', 2), 1, 80) AS value FROM h WHERE ordinal <= 50""")
def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.form_values(_docs(spark, sf_dir))


@query("SELECT n_nationkey AS doc_id, unnest([1, 2, 3, 4])::INT AS ordinal, unnest(['Name', 'Date', 'Amount due', 'I agree']) AS name, unnest([n_name, '2026-07-01', '', '']) AS value FROM nation UNION ALL SELECT n_nationkey, 5, 'E-mail address', '*' FROM nation")
def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.form_values(_forms(spark, sf_dir))


@query("SELECT n_nationkey AS doc_id, unnest([1, 2])::INT AS ordinal, unnest(['Amount due', 'I agree']) AS name FROM nation")
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_candidates(_forms(spark, sf_dir))


@query("""SELECT n_nationkey AS doc_id, unnest([0, 1, 2, 4, 5, 6, 7, 8])::INT AS tab_order, unnest(['Name__' || replace(n_name, ' ', '_'), 'Date__2026-07-01', 'Amount_due', 'Total_number', 'Date_of_birth', 'I_agree', 'E-mail_address', 'date']) AS name,
unnest(['Name: ' || n_name, 'Date_ 2026-07-01', 'Amount due', 'Total number', 'Date of birth', 'I agree', 'E-mail address', '*** date']) AS tooltip, unnest(['text', 'date', 'number', 'number', 'date', 'checkbox', 'text', 'date']) AS type,
unnest([false, false, false, false, true, false, true, false]) AS required, unnest(['', '', '', '', '', 'false', '', '']) AS default_value, unnest([714 - 18 * i for i in [0, 1, 2, 4, 5, 6, 7, 8]])::INT AS top FROM nation""")
def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.field_types(_forms(spark, sf_dir))


@query(r"""SELECT doc_id, unnest(list_filter([CASE WHEN NOT regexp_matches(text, '(?i)\blang(?:uage)?\b') THEN 'missing-language-cue' END, CASE WHEN NOT regexp_matches(text, '(?im)^#|\bheading\b|\btitle\b') THEN 'missing-heading-cue' END, CASE WHEN regexp_matches(text, '(?i)\[image\]|\[figure\]') THEN 'image-placeholders' END], lambda x: x IS NOT NULL)) AS cue FROM documents""")
def accessibility_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accessibility_cues(_docs(spark, sf_dir))


@query(rf"SELECT doc_id, unnest(range(1, len(x) + 1))::INT AS \"order\", unnest([substr(t, 1, 500) for t in x]) AS text FROM (SELECT doc_id, list_filter(string_split_regex(text, '\.{X.SPACES}+'), lambda t: t <> '') AS x FROM documents)".replace('\\"', '"'))
def reflow_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reflow_blocks(_docs(spark, sf_dir))


@query(f"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '{X.SPACES}+', ' ', 'g')) AS text FROM documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", C.normalized(F.col("text")).alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped, true AS restored FROM pages")
def markup_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.markup_escaped(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", e.alias("escaped"), (C.markup_unescaped(e) == F.col("html")).alias("restored"))


_CLAIMS = {1: ("what is the contract value", ("what", "contract", "value")), 2: ("Safety of the system", ("safety", "system"))}


@query(
    f"WITH {_SENT}, s AS (" + " UNION ALL ".join(f"SELECT doc_id, idx, text, {k} AS claim_id, {len(t)} AS q, len(list_filter({_TOKENS}, lambda t: t IN {t})) AS score FROM sent" for k, (_, t) in _CLAIMS.items()) + """),
b AS (SELECT doc_id, claim_id, arg_max(text, (score, -idx)) AS quote, least(1.0, max(score) / any_value(q))::DOUBLE AS confidence FROM s WHERE score > 0 GROUP BY 1, 2)
SELECT d.doc_id, c.claim_id::INT AS claim_id, quote, coalesce(confidence, 0) AS confidence FROM documents d CROSS JOIN (VALUES (1), (2)) c(claim_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.claim_id = c.claim_id"""
)
def claim_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.createDataFrame([(k, c) for k, (c, _) in _CLAIMS.items()], "claim_id int, claim string")
    docs = _docs(spark, sf_dir)
    return C.unquoted(docs, claims, C.citations(docs, claims))


# Documents are put to every item of the benchmark at once.
@query(f"""WITH {_SENT}, q AS (SELECT item_id, unnest(t) AS term, len(t) AS n FROM (SELECT item_id, list_distinct(list_filter({_TOKENS}, lambda x: x NOT IN {_STOP})) AS t FROM benchmark)),
w AS (SELECT doc_id, idx, text, unnest({_TOKENS}) AS term FROM sent), s AS (SELECT doc_id, idx, item_id, count(*) AS score, any_value(text) AS quote, any_value(n) AS n FROM w JOIN q USING (term) GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, idx) AS r FROM s)
SELECT item_id AS claim_id, doc_id, quote, least(1.0, score / n)::DOUBLE AS confidence FROM b WHERE r = 1""")
def benchmark_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_sources(_docs(spark, sf_dir), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim")))


# A term's first place is that of its first occurrence among all tokens of the first document that has it.
@query(f"WITH {_TERMS}, g AS (SELECT term, doc_id, min(pos) AS pos FROM terms WHERE length(term) > 3 GROUP BY 1, 2), f AS (SELECT term, count(*) AS documents, min(doc_id) AS doc, arg_min(pos, doc_id) AS pos FROM g GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY documents DESC, doc, pos, term) AS rank FROM f) SELECT rank::INT AS rank, term, documents FROM r WHERE rank <= 30")
def common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.common_terms(_docs(spark, sf_dir))


_GLOSSARY = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.GLOSSARY.items()) + "}"


@query(f"SELECT doc_id, array_to_string([coalesce(element_at({_GLOSSARY}, t)[1], t) for t in {_TOKENS}], ' ') AS translated FROM documents")
def translated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.translated(F.col("text")).alias("translated"))


@query("SELECT doc_id, replace(text, 'tion', 'TION') AS text FROM documents")
def replaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", C.replaced(F.col("text"), "tion", "TION").alias("text"))


_REGION = "CASE WHEN page % 3 = 0 THEN 'x' || substr(text, 3, 40) WHEN page % 7 = 0 THEN ' ' ELSE replace(substr(text, 3, 40), ' ', '  ') END"
_FLAT = lambda c: f"trim(regexp_replace({c}, '{X.SPACES}+', ' ', 'g'))"


@query(f"WITH {_PAGES}, r AS (SELECT doc_id, page, text, {_REGION} AS region FROM pages_) SELECT doc_id, page::INT AS page, region, {_FLAT('region')} <> '' AND contains({_FLAT('text')}, {_FLAT('region')}) AS present FROM r")
def redacted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.pages_of(_docs(spark, sf_dir))
    return C.regions_present(pages.select("doc_id", "page", F.expr(_REGION).alias("region")), pages, "doc_id")


# Of a leftmost-first engine the longest alternatives come first.
@query(_located_sql(r"(?i)(?:[a-c][0-9]{2,4}|tion[as]l|tions?|the(?:rein|re)|the)"))
def bounded_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a bounded expression whose alternatives overlap."""
    pages = X.pages_of(_docs(spark, sf_dir))
    each = pages.select("doc_id", "page", "text", F.posexplode(B.bounded_matches(F.col("text"), "([a-c][0-9]{2,4}|th(e|ere|erein)|tion|tion(s|(a|s)l))", ignore_case=True)).alias("i", "m"))
    return each.select("doc_id", "page", (F.col("i") + 1).alias("match_no"), "m.start", "m.end", F.substring("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("match"))


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-3][0-9]?$') AS whole, regexp_matches(p_name, 'bl(ue|ack)|w.d') AS part FROM part")
def bounded_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", B.bounded_test(F.col("p_brand"), "^Brand#[1-3][0-9]?$").alias("whole"), B.bounded_test(F.col("p_name"), "bl(ue|ack)|w.d").alias("part"))


@query(rf"""WITH m AS ({_located_sql("[0-9]+")}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, start, "end") AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM m) SELECT doc_id, 'match-' || k AS id, page, start, "end", 'number' AS kind, 'Number' AS label, c >= 500 AS truncated FROM n WHERE k <= 500""")
def own_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireframe.registry import detected

    find = lambda p: X.match_rows(p, "[0-9]+").select("doc_id", "page", "start", "end", F.lit("number").alias("kind"), F.lit("Number").alias("label"))
    return detected(X.pages_of(_docs(spark, sf_dir)), find)


@query(_located_sql("ment"))
def delivered_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireframe.registry import deliver

    return deliver("text.match_rows", deliver("text.pages_of", _docs(spark, sf_dir)), "ment")
