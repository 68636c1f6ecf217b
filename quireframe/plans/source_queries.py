"""Registered queries of the readers and writers. A table's rows are printed as a tool would print them, with lines that are to
be refused among them, and read again; the SQL says from the table what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import graph as G
from quireframe.plans.queries import _t, query
from quireframe.sources import tool_output as O

NL, TAB = "chr(10)", "chr(9)"


def printed(spark: SparkSession, sf_dir: str, parts: list[str], table: str = "part", key: str = "p_partkey", where: str = "true") -> DataFrame:
    """doc_id and output, the lines ``parts`` (expressions) of each row of a table."""
    return _t(spark, sf_dir, table).filter(where).select(F.col(key).alias("doc_id"), F.expr(f" || {NL} || ".join(parts)).alias("output"))


@query("SELECT p_partkey AS doc_id, g.i::INT AS page, CASE g.i WHEN 1 THEN p_name WHEN 2 THEN p_brand || chr(10) || p_type ELSE '' END AS text FROM part, (SELECT unnest([1, 2, 3]) AS i) g WHERE g.i <= p_partkey % 3 + 1")
def tool_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parted by form feeds, cut and filled up to the number expected."""
    out = printed(spark, sf_dir, [f"p_name || ' ' || {NL} || chr(12) || p_brand || chr(13)", f"p_type || '  ' || {NL} || chr(12)"])
    return O.text_pages(out, F.col("doc_id") % 3 + 1)


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS page_count, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title, p_brand AS author, NULL::VARCHAR AS subject, NULL::VARCHAR AS keywords, 'b: ' || p_type AS creator, NULL::VARCHAR AS producer,
'612 x 792 pts (letter)' AS page_size, NULL::VARCHAR AS page_rotation, NULL::VARCHAR AS file_size, '1.' || p_partkey % 8 AS pdf_version, CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'no' END AS tagged, 'unknown' AS suspects, 'unknown' AS form, 'unknown' AS javascript, 'no' AS encrypted, 'unknown' AS optimized, p_partkey % 7 <> 0 AS valid FROM part""")
def document_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ["'Title:    ' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END", "'Author: nobody'", "'Author:  ' || p_brand", "'Creator: b: ' || p_type", "'no separator'", "': no key'", "'Tagged: ' || CASE WHEN p_partkey % 2 = 0 THEN 'yes' ELSE 'no' END || chr(13)", "'Pages:   ' || CASE WHEN p_partkey % 7 = 0 THEN 'many' ELSE CAST(p_size AS STRING) END", "'Encrypted: no'", "'Page size: 612 x 792 pts (letter)'", "'PDF version: 1.' || p_partkey % 8"]
    return O.document_info(printed(spark, sf_dir, lines))


@query("""SELECT p_partkey AS doc_id, g.i::INT AS page, (100 + p_size)::DOUBLE AS width, 200.5::DOUBLE AS height, CASE WHEN p_partkey % 4 = 0 THEN 270 WHEN p_partkey % 4 = 1 THEN 90 WHEN p_partkey % 4 = 2 THEN 45 ELSE 0 END::INT AS rotation, p_size::DOUBLE AS crop_right, g.i = 2 AS bleed, p_partkey % 4 <> 2 AND p_size > 3 AS valid
FROM part, (SELECT unnest([1, 2]) AS i) g""")
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = "CASE WHEN p_partkey % 4 = 0 THEN '-90' WHEN p_partkey % 4 = 1 THEN '90' WHEN p_partkey % 4 = 2 THEN '45' ELSE '360' END"
    lines = []
    for i in (1, 2):
        lines += [f"'Page    {i} size: 1 x 1 pts'", f"'Page    {i} size: ' || (100 + p_size) || ' x 200.5 pts (A9)'", f"'Page    {i} rot:  ' || {turn}", f"'Page    {i} MediaBox:     0.00   0.00  612.00  792.00'", f"'Page    {i} CropBox:  3 0 ' || p_size || ' 10'"]
    out = O.page_geometry(printed(spark, sf_dir, [*lines, "'Page    2 BleedBox: 0 0 1 1'", "'Title: none'"]))
    return out.select("doc_id", "page", "width", "height", "rotation", F.col("crop_box.right").alias("crop_right"), F.col("bleed_box").isNotNull().alias("bleed"), "valid")


@query("SELECT p_partkey AS doc_id, p_partkey % 4 <> 0 AS present, CASE WHEN p_partkey % 4 <> 0 THEN '<x>' || p_name || '</x>' END AS xml FROM part")
def metadata_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.metadata_packet(printed(spark, sf_dir, ["' '", "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '<x>' || p_name || '</x>' END", "''"]))


@query("SELECT p_partkey AS doc_id, g.i::INT AS at, CASE g.i WHEN 0 THEN 'Kind' ELSE 'dc:x' END AS name, CASE g.i WHEN 0 THEN p_type || ': x' ELSE '' END AS value FROM part, (SELECT unnest([0]) AS i) g UNION ALL SELECT p_partkey, 3, 'dc', 'language: en' FROM part")
def custom_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.custom_metadata(printed(spark, sf_dir, ["'  Kind :  ' || p_type || ': x '", "'nothing'", "':' || p_name", "'dc:language: en'", "'  : empty'"]))


@query("SELECT p_partkey AS doc_id, g.seq::INT AS seq, CASE g.seq WHEN 1 THEN 0 WHEN 2 THEN 2 * (p_partkey % 3) ELSE 5 END::INT AS depth, CASE g.seq WHEN 1 THEN 'Document' WHEN 2 THEN 'P ' || p_brand ELSE 'Span' END AS value FROM part, (SELECT unnest([1, 2, 3]) AS seq) g")
def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tag_lines(printed(spark, sf_dir, ["'Document'", "'   '", f"repeat({TAB}, CAST(p_partkey % 3 AS INT)) || 'P ' || p_brand || ' '", f"{TAB} || '   Span'"]))


_FONT = "p_brand || '+X   ' || 'CID TrueType' || '      ' || 'Identity-H' || '   ' || CASE WHEN p_partkey % 3 = 0 THEN 'no ' ELSE 'yes' END || '   yes   ' || CASE WHEN p_partkey % 4 = 0 THEN 'maybe' ELSE 'no' END || '   ' || p_size || '  0'"


@query("SELECT p_partkey AS doc_id, 0 AS at, p_brand || '+X' AS name, 'CID TrueType' AS type, 'Identity-H' AS encoding, CASE WHEN p_partkey % 3 = 0 THEN 'no' ELSE 'yes' END AS embedded, 'yes' AS subset, CASE WHEN p_partkey % 4 = 0 THEN 'maybe' ELSE 'no' END AS unicode, p_partkey % 4 <> 0 AS valid FROM part WHERE p_partkey % 6 <> 5")
def font_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fonts(printed(spark, sf_dir, ["'a notice'", "CASE WHEN p_partkey % 6 = 5 THEN 'no header' ELSE 'name      type   encoding   emb sub uni object ID' END", "'--------  ----'", _FONT]))


@query("""SELECT p_partkey AS doc_id, 0 AS at, 1 AS page, p_size AS number, 'image' AS type, CASE WHEN p_partkey % 9 <> 0 THEN p_size * 10 END::INT AS width, 50 AS height, 'rgb' AS color, 8 AS bits, 'jpeg' AS encoding, 7 AS object_id, 0 AS generation,
CASE WHEN p_partkey % 4 <> 0 THEN p_size * 4.5 END::DOUBLE AS x_ppi, 72.0::DOUBLE AS y_ppi, p_partkey % 9 <> 0 AND p_partkey % 5 <> 0 AS valid FROM part""")
def image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = "'   1 ' || p_size || ' image ' || CASE WHEN p_partkey % 9 = 0 THEN '0' ELSE CAST(p_size * 10 AS STRING) END || ' 50 rgb 3 8 jpeg no 7 0 ' || CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE CAST(CAST(p_size * 4.5 AS DOUBLE) AS STRING) END || ' 72 10K 1.0%' || CASE WHEN p_partkey % 5 = 0 THEN ' more' ELSE '' END"
    return O.images(printed(spark, sf_dir, ["'page   num  type   width height color comp bpc  enc interp  object ID x-ppi y-ppi size ratio'", "'-----'", row]))


@query("SELECT p_partkey AS doc_id, 1 AS at, p_size AS number, p_name || ' : x' AS name FROM part")
def attachment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.attachments(printed(spark, sf_dir, ["'1 embedded files'", "'  ' || p_size || ':  ' || p_name || ' : x  '"]))


@query("SELECT p_partkey AS doc_id, 1 AS at, p_size AS page, '[ Fit ]' AS destination, p_brand AS name FROM part")
def named_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.destinations(printed(spark, sf_dir, ["'Page  Destination                 Name'", "'   ' || p_size || ' [ Fit ]          \"' || p_brand || '\"'", "'  0 [ Fit ] \"zero\"'", "'  2 [ Fit ] \"\"'"]))


@query("SELECT p_partkey AS doc_id, 1 AS at, p_size AS page, 'Annotation' AS type, 'http://x/' || replace(p_brand, '#', '-') || '?q=a b' AS url FROM part")
def document_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.urls(printed(spark, sf_dir, ["'9  Type  URL of the header'", "' ' || p_size || '  Annotation    http://x/' || replace(p_brand, '#', '-') || '?q=a b '", "'no page'"]))


_SIGNED = ["'Digital Signature Info of: x.pdf'"]
for _i in (1, 2):
    _SIGNED += [f"'Signature #{_i}:'", "'  - Signer Certificate Common Name: ' || p_brand", f"'  - Signed Ranges: [0 - ' || (p_size + {_i}) || '], [900 - 950]'", f"CASE WHEN (p_partkey + {_i}) % 3 = 0 THEN '  - Not total document signed' ELSE '  - Total document signed' END", f"'  - Signature Validation: ' || CASE WHEN (p_partkey + {_i}) % 5 = 0 THEN 'Digest Mismatch.' WHEN (p_partkey + {_i}) % 7 = 0 THEN 'Signature not found.' ELSE 'Signature is Valid.' END"]
_SIGNATURES = """SELECT p_partkey AS doc_id, g.i::INT AS number, p_brand AS signer, NULL::VARCHAR AS signing_time, NULL::VARCHAR AS hash_algorithm, 0::BIGINT AS start_1, (p_size + g.i)::BIGINT AS length_1, 900::BIGINT AS start_2, 50::BIGINT AS length_2,
CASE WHEN (p_partkey + g.i) % 3 = 0 THEN 'prior-revision' ELSE 'full' END AS coverage, CASE WHEN (p_partkey + g.i) % 5 = 0 THEN 'invalid' WHEN (p_partkey + g.i) % 7 = 0 THEN 'indeterminate' ELSE 'valid' END AS integrity FROM part, (SELECT unnest([1, 2]) AS i) g"""


@query(_SIGNATURES)
def signature_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.signatures(printed(spark, sf_dir, _SIGNED))


@query(f"""WITH s AS ({_SIGNATURES}), c AS (SELECT doc_id, count(*) AS n, CASE WHEN bool_or(integrity = 'invalid') THEN 'invalid' WHEN bool_or(integrity = 'indeterminate') THEN 'indeterminate' ELSE 'valid' END AS status, bool_and(coverage = 'full') AS whole FROM s GROUP BY 1)
SELECT doc_id, n, status, CASE WHEN status <> 'valid' THEN status WHEN whole THEN 'valid' ELSE 'modified-after-signing' END AS current_status FROM c""")
def signature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.signature_summary(O.signatures(printed(spark, sf_dir, _SIGNED)))


@query("""SELECT p_partkey AS doc_id, 0 AS at, p_name AS text, (p_size + 0.5)::DOUBLE AS confidence, p_size AS "left", 0 AS top, 7 AS width, 8 AS height FROM part WHERE p_partkey % 6 <> 0""")
def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns come in the order that the first line names, not the usual one."""
    cells = lambda *c: f" || {TAB} || ".join(c)
    rows = [cells("'text'", "'conf'", "'left'", "'top'", "'width'", "'height'"), cells("' ' || p_name", "CASE WHEN p_partkey % 6 = 0 THEN '-1' ELSE CAST(p_size AS STRING) || '.5' END", "p_size || 'px'", "'none'", "'7'", "'8'"), cells("' '", "'90'", "'1'", "'1'", "'1'", "'1'"), cells("'x'", "'high'", "'1'", "'1'", "'1'", "'1'")]
    return O.ocr_words(printed(spark, sf_dir, rows))


def _tsv(*cells: str) -> str:
    return f" || {TAB} || ".join(cells)


_NODES = [_tsv(*(f"'{c}'" for c in O.TSV)), _tsv("'1'", "'1'", "'0'", "'0'", "'0'", "'0'", "'0'", "'0'", "'200'", "'100'", "'-1'", "''"), _tsv("'2'", "'1'", "CASE WHEN p_partkey % 5 = 0 THEN '2' ELSE '1' END", "'0'", "'0'", "'0'", "'0'", "'0'", "'100'", "'50'", "'-1'", "''"), _tsv("'3'", "'1'", "'1'", "'1'", "'0'", "'0'", "p_size", "'0'", "'160'", "'50'", "'-1'", "''"), _tsv("'4'", "'1'", "'1'", "'1'", "CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE '1' END", "'0'", "'10'", "'10'", "'20'", "'10'", "'-1'", "''")]


@query("""SELECT p_partkey AS doc_id, g.i::INT AS at, CASE g.i WHEN 0 THEN '1:0:0:0:0' WHEN 1 THEN '1:' || (CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END) || ':0:0:0' WHEN 2 THEN '1:1:1:0:0' ELSE '1:1:1:' || (CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END) || ':0' END AS id,
CASE g.i WHEN 2 THEN p_size / 200.0 WHEN 3 THEN 0.05 ELSE 0.0 END::DOUBLE AS x, CASE g.i WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 0.1 END::DOUBLE AS width, NOT (g.i = 2 AND p_size > 40) AS valid FROM part, (SELECT unnest([0, 1, 2, 3]) AS i) g""")
def ocr_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ocr_nodes(printed(spark, sf_dir, _NODES), F.lit(200), F.lit(100)).select("doc_id", "at", "id", "x", "width", "valid")


@query("""SELECT p_partkey AS doc_id, 2 AS at, 'orphan' AS code FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, unnest([2, 3]), 'repeated' FROM part WHERE p_partkey % 7 = 0""")
def ocr_hierarchy_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without their parent, and nodes that share an identifier."""
    nodes = O.ocr_nodes(printed(spark, sf_dir, _NODES), F.lit(200), F.lit(100))
    return G.missing_parents(nodes, ["doc_id", "page", "block", "paragraph", "line", "word"], "level", fixed=1).select("doc_id", "at", "code")


@query("""SELECT user_id, event_id, code FROM (SELECT *, CASE WHEN n > 1 THEN 'repeated' WHEN level > 1 AND "first" IS NULL THEN 'orphan' WHEN level > 1 AND "first" >= event_id THEN 'late' END AS code FROM (
SELECT a.*, (SELECT count(*) FROM k b WHERE b.user_id = a.user_id AND b.p = a.p AND b.q = a.q AND b.r = a.r) AS n, (SELECT min(event_id) FROM k b WHERE b.user_id = a.user_id AND b.p = a.p AND b.q = CASE a.level WHEN 3 THEN a.q ELSE 0 END AND b.r = 0) AS "first" FROM k a)) WHERE code IS NOT NULL""".replace(" k ", " (SELECT user_id, event_id, event_id % 3 + 1 AS level, floor(value)::BIGINT % 9 + 1 AS p, CASE WHEN event_id % 3 > 0 THEN floor(value)::BIGINT % 4 + 1 ELSE 0 END AS q, CASE WHEN event_id % 3 > 1 THEN event_id % 7 + 1 ELSE 0 END AS r FROM events) "))
def hierarchy_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nodes of three levels: those that repeat, lack their parent, or come before it."""
    e, v = _t(spark, sf_dir, "events"), F.floor("value")
    level = F.col("event_id") % 3 + 1
    nodes = e.select("user_id", "event_id", level.alias("level"), (v % 9 + 1).alias("p"), F.when(level > 1, v % 4 + 1).otherwise(0).alias("q"), F.when(level > 2, F.col("event_id") % 7 + 1).otherwise(0).alias("r"))
    return G.missing_parents(nodes, ["user_id", "p", "q", "r"], "level", fixed=1, order="event_id").select("user_id", "event_id", "code")


_ALTO = "CASE WHEN p_partkey % 5 = 0 THEN '<alto/>' WHEN p_partkey % 5 = 1 THEN '<!DOCTYPE alto SYSTEM \"x\">' || repeat('-', 60) WHEN p_partkey % 5 = 2 THEN '<page>' || repeat('-', 60) || '</page>' ELSE '<?xml version=\"1.0\"?> <alto xmlns=\"x\"><Layout><Page ID=\"1\">' || p_name || ' and more of the same text</Page></Layout></alto>' END"


@query(f"SELECT p_partkey AS doc_id, strlen(a)::BIGINT AS n_bytes, sha256(a) AS sha256, CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'active' WHEN 2 THEN 'malformed' ELSE 'sound' END AS status FROM (SELECT *, {_ALTO} AS a FROM part)")
def alto_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.alto_envelopes(printed(spark, sf_dir, [_ALTO]))


@query("SELECT p_partkey AS doc_id, g.i::INT AS page, CASE WHEN g.i = 1 OR p_partkey % 4 <> 0 THEN 0.25 END::DOUBLE AS cyan, CASE WHEN g.i = 1 OR p_partkey % 4 <> 0 THEN 0.5 END::DOUBLE AS magenta, CASE WHEN g.i = 1 OR p_partkey % 4 <> 0 THEN 0.0 END::DOUBLE AS yellow, CASE WHEN g.i = 1 OR p_partkey % 4 <> 0 THEN 1.0 END::DOUBLE AS black, CASE WHEN g.i = 1 OR p_partkey % 4 <> 0 THEN 175.0 END::DOUBLE AS total, g.i = 1 OR p_partkey % 4 <> 0 AS valid FROM part, (SELECT unnest([1, 2]) AS i) g")
def ink_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = "CASE WHEN p_partkey % 4 = 0 THEN '2.0 0 0 0 CMYK OK' ELSE ' 0.25  0.5 0 1.0 CMYK OK' END"
    return O.ink_coverage(printed(spark, sf_dir, ["'GPL Ghostscript 10'", "'Page 1'", "' 0.25000  0.5  0.0  1 CMYK OK'", second]))


_LINES = ["'List of available languages (2):'", "p_brand || ' '", "' ' || split_part(lower(p_name), ' ', 1) || ' '", "lower(replace(p_type, ' ', '_'))", "p_name"]


@query(f"SELECT p_partkey AS doc_id, language FROM (SELECT p_partkey, trim(unnest([{', '.join(_LINES)}])) AS language FROM part) WHERE regexp_matches(language, '^[a-z0-9_]+$')")
def recognizer_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.languages(printed(spark, sf_dir, _LINES))
