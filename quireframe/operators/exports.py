"""Exports and interchange: texts of documents in several forms, lists as CSV and XML, comments, and their way back. A document's
parts are put together from its pages, which are few against a table; lines of lists stay rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.operators import structure as C
from quireframe.operators.diff import quoted
from quireframe.operators.text import SPACES

#: The kinds of annotations.
ANNOTATION_TYPES = ("comment", "note", "callout", "textMarkup", "drawingMarkup", "reference", "measurement", "stamp")
#: The frame of the canonical XFDF form, and the header of a form's CSV.
XFDF_HEAD, XFDF_TAIL = '<?xml version="1.0" encoding="UTF-8"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve"><annots>', "</annots></xfdf>\n"
FORM_HEADER = "fieldName,currentValue"


def _joined(pages: DataFrame, part: Column, between: str) -> DataFrame:
    each = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", part.alias("part")))).alias("p"))
    return each.select("doc_id", F.array_join(F.transform("p", lambda x: x["part"]), between).alias("body"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+$", "")


def structured_export(pages: DataFrame, kind: str, title: str = "PDF text export") -> DataFrame:
    """doc_id and data: the pages (doc_id, page, text) of each document as rtf, html or xml. White space at the ends of pages
    goes. XML is null for a document with a character that XML forbids."""
    n, t = F.col("page").cast("string"), _stripped(F.col("text"))
    name = C.markup_escaped(F.lit(title))
    if kind == "rtf":
        body = _joined(pages, F.concat(F.lit("\\b Page "), n, F.lit("\\b0\\line\n"), C.rtf_escaped(t)), "\\page\n")
        return body.select("doc_id", F.concat(F.lit("{\\rtf1\\ansi\\deff0\n"), "body", F.lit("\n}")).alias("data"))
    if kind == "html":
        body = _joined(pages, F.concat(F.lit('<section data-page="'), n, F.lit('"><h2>Page '), n, F.lit("</h2><pre>"), C.markup_escaped(t), F.lit("</pre></section>")), "\n")
        head = F.concat(F.lit('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>'), name, F.lit("</title></head><body>\n"))
        return body.select("doc_id", F.concat(head, "body", F.lit("\n</body></html>\n")).alias("data"))
    if kind == "xml":
        whole = pages.groupBy("doc_id").agg(F.bool_and(C.xml_valid(F.col("text"))).alias("ok"))
        body = _joined(pages, F.concat(F.lit('  <page number="'), n, F.lit('">'), F.replace(C.markup_escaped(t), F.lit("\r"), F.lit("&#13;")), F.lit("</page>")), "\n")
        head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<document title="'), name, F.lit('">\n'))
        return body.join(whole, "doc_id").select("doc_id", F.when(F.col("ok"), F.concat(head, "body", F.lit("\n</document>\n"))).alias("data"))
    raise ValueError(f"unknown form {kind}")


def minimal_csv(cell: Column) -> Column:
    """A cell that is quoted only if it holds a comma, a quote or a line break; null is empty."""
    c = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(rows: DataFrame, key: str, cells: list[Column]) -> DataFrame:
    """key and line of each row, cells quoted where they must be."""
    return rows.select(key, F.concat_ws(",", *[minimal_csv(c) for c in cells]).alias("line"))


def review_lines(annotations: DataFrame) -> DataFrame:
    """Annotations as lines of a review list: id, line (id, type, status, page, author, text; a status of one's own comes
    first) and xfdf, the annotation as an element."""
    status = F.coalesce(F.nullif("custom_status", F.lit("")), "status")
    e = lambda c: C.markup_escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    xfdf = F.concat(F.lit('<text name="'), e("id"), F.lit('" page="'), (F.col("page") - 1).cast("string"), F.lit('" title="'), e("author"), F.lit('" contents="'), e("text"), F.lit('" subject="'), e("type"), F.lit('"/>'))
    cells = (F.col("id"), F.col("type"), status, F.col("page"), F.col("author"), F.col("text"))
    return annotations.select("id", F.concat_ws(",", *[minimal_csv(c) for c in cells]).alias("line"), xfdf.alias("xfdf"))


def text_annotations(docs: DataFrame, column: str = "xfdf") -> DataFrame:
    """``docs`` with the text annotation that an XFDF text of the canonical form holds: page (from 1), left, bottom, right,
    top, name, contents, and ``valid``. Other declarations, comments, CDATA, entities than the five, control characters,
    empty texts and boxes without area are not admitted."""
    x = F.col(column)
    n = r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]{1,6})?)"
    shape = f'^{re.escape(XFDF_HEAD)}<text page="(0|[1-9][0-9]{{0,3}})" rect="{n},{n},{n},{n}"(?: name="([^"<>]*)")?><contents>([^<]*)</contents></text>{re.escape(XFDF_TAIL)}$'
    get = lambda i: F.regexp_extract(x, shape, i)
    box = [F.nullif(get(i), F.lit("")).cast("double") for i in range(2, 6)]
    named = x.rlike(shape.replace(")?><contents>", ")><contents>"))
    plain = lambda c: C.markup_unescaped(c)
    bad = get(7).rlike(r"[\x00-\x1f\x7f-\x9f]|&(?!(?:amp|lt|gt|quot|apos);)") | get(6).rlike(r"[\x00-\x1f\x7f-\x9f]|&(?!(?:amp|lt|gt|quot|apos);)")
    ok = x.rlike(shape) & ~bad & (get(7) != "") & (~named | (get(6) != "")) & (box[2] > box[0]) & (box[3] > box[1]) & (get(1) != "9999")
    ok = F.coalesce(ok, F.lit(False))
    values = {"page": F.nullif(get(1), F.lit("")).cast("int") + 1, **dict(zip(("left", "bottom", "right", "top"), box, strict=True)), "name": F.when(named, plain(get(6))), "contents": plain(get(7))}
    return docs.select("*", ok.alias("valid")).withColumns({k: F.when(F.col("valid"), v) for k, v in values.items()})


def annotation_xfdf(page: Column, box: list[Column], name: Column, contents: Column) -> Column:
    """The canonical XFDF text of a text annotation; page is from 1, a null name is left out."""
    e = C.markup_escaped
    rect = F.concat_ws(",", *[c.cast("string") for c in box])
    named = F.coalesce(F.concat(F.lit(' name="'), e(name), F.lit('"')), F.lit(""))
    return F.concat(F.lit(XFDF_HEAD + '<text page="'), (page - 1).cast("string"), F.lit('" rect="'), rect, F.lit('"'), named, F.lit("><contents>"), e(contents), F.lit("</contents></text>" + XFDF_TAIL))


REVIEW = T.StructType([T.StructField("format", T.StringType()), T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])))])


def imported_reviews(docs: DataFrame, form: str, column: str = "json") -> DataFrame:
    """Annotations of review interchanges (JSON texts of format ``form``), a row each: doc_id, id, type, page, text and code,
    what is wrong with it (duplicate id, unknown type, bad page) or null. A text of another format gives one row with code
    bad-format."""
    each = docs.select("doc_id", F.from_json(column, REVIEW).alias("r"))
    good = F.coalesce((F.col("r.format") == form) & F.col("r.annotations").isNotNull(), F.lit(False))
    bad = each.filter(~good).select("doc_id", *[F.lit(None).cast(k).alias(n) for n, k in (("id", "string"), ("type", "string"), ("page", "int"), ("text", "string"))], F.lit("bad-format").alias("code"))
    rows = each.filter(good).select("doc_id", F.posexplode("r.annotations").alias("at", "a")).select("doc_id", "at", "a.*")
    again = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("at")) > 1
    code = F.when(F.col("id").isNull() | again, "duplicate-id").when(~F.coalesce(F.col("type").isin(*ANNOTATION_TYPES), F.lit(False)), "unknown-type").when(~F.coalesce(F.col("page").between(1, 100_000), F.lit(False)), "bad-page")
    return rows.select("doc_id", "id", "type", "page", "text", code.alias("code")).unionByName(bad)


def forms_lines(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Fields with their values as lines of CSV: id and line (id, name, value; no value: empty)."""
    v = values.select(F.col("id").alias("_id"), F.col("value").alias("_v"))
    both = fields.join(v, F.col("id") == F.col("_id"), "left")
    return csv_lines(both, "id", [F.col("id"), F.col("name"), F.col("_v")])


def form_csv(name: Column, value: Column) -> Column:
    """One field as a whole CSV text with a mark of byte order and quoted cells; null if a cell could be a formula, is
    empty-named or holds control characters."""
    safe = lambda c: ~c.rlike(r"^(?:[\t\r\n]|\s*[=+\-@])") & ~c.rlike(r"[\x00-\x1f\x7f]")
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit(f"\ufeff{FORM_HEADER}\r\n"), q(name), F.lit(","), q(value), F.lit("\r\n"))
    return F.when(safe(name) & safe(value) & (name != ""), text)


def parsed_form_csv(docs: DataFrame, column: str = "csv") -> DataFrame:
    """``docs`` with field_name, value and ``valid`` of texts that ``form_csv`` makes; any other text is not valid."""
    shape = rf'(?s)^\x{{FEFF}}{FORM_HEADER}\r\n"((?:[^"]|"")*)","((?:[^"]|"")*)"\r\n$'
    get = lambda i: F.replace(F.regexp_extract(column, shape, i), F.lit('""'), F.lit('"'))
    ok = F.coalesce(F.col(column).rlike(shape) & form_csv(get(1), get(2)).eqNullSafe(F.col(column)), F.lit(False))
    return docs.select("*", F.when(ok, get(1)).alias("field_name"), F.when(ok, get(2)).alias("value"), ok.alias("valid"))


def comments(annotations: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Annotations (doc_id, at, id, page, author, text, replies: array of id, author, text) and their replies as one list in
    order: doc_id, order (from 1), id, kind (annotation or comment), annotation_id, page, author, text. With ``chosen``
    (doc_id, id), these only, in the order of all."""
    own = annotations.select("doc_id", "at", F.lit(0).alias("k"), "id", F.lit("annotation").alias("kind"), F.col("id").alias("annotation_id"), "page", "author", "text")
    each = annotations.select("doc_id", "at", F.posexplode("replies").alias("i", "r"), F.col("id").alias("annotation_id"), "page")
    replies = each.select("doc_id", "at", (F.col("i") + 1).alias("k"), "r.id", F.lit("comment").alias("kind"), "annotation_id", "page", "r.author", "r.text")
    both = own.unionByName(replies).withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "k")))
    both = both.select("doc_id", "order", "id", "kind", "annotation_id", "page", "author", "text")
    return both if chosen is None else both.join(chosen.select("doc_id", "id"), ["doc_id", "id"], "left_semi").select(*both.columns)


def forged(annotations: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen (doc_id, id) that are of no annotation or reply, and identifiers that a document has twice: doc_id, id, code."""
    all_ = comments(annotations)
    unknown = chosen.select("doc_id", "id").distinct().join(all_, ["doc_id", "id"], "left_anti").select("doc_id", "id", F.lit("unknown").alias("code"))
    twice = all_.groupBy("doc_id", "id").count().filter("count > 1").select("doc_id", "id", F.lit("repeated").alias("code"))
    return unknown.unionByName(twice)


def page_lines(pages: DataFrame) -> DataFrame:
    """The relation of a spreadsheet of page texts: doc_id, page, line (from 1) and text."""
    each = pages.select("doc_id", "page", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("i", "text"))
    return each.select("doc_id", "page", (F.col("i") + 1).alias("line"), "text")


def positioned_words(words: DataFrame) -> DataFrame:
    """Recognized words (doc_id, id, text, confidence, x, y, width, height as shares) as elements placed on their page:
    doc_id, id and element; null where the place is not on the page."""
    pc = lambda c: F.format_string("%.4f", F.col(c) * 100)
    style = F.concat(F.lit("left:"), pc("x"), F.lit("%;top:"), pc("y"), F.lit("%;width:"), pc("width"), F.lit("%;height:"), pc("height"), F.lit("%"))
    e = lambda c: F.replace(C.markup_escaped(F.col(c).cast("string")), F.lit("&apos;"), F.lit("&#39;"))
    element = F.concat(F.lit('<span data-ocr-id="'), e("id"), F.lit('" data-confidence="'), e("confidence"), F.lit('" style="'), style, F.lit('">'), e("text"), F.lit("</span>"))
    ok = reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in ("x", "y", "width", "height")]) & (F.col("x") + F.col("width") <= 1.000001) & (F.col("y") + F.col("height") <= 1.000001)
    return words.select("doc_id", "id", F.when(ok, element).alias("element"))


def check_elements(checks: DataFrame) -> DataFrame:
    """Checks (doc_id, check, status, evidence: JSON text) as elements with their evidence in canonical form: doc_id, check and
    element."""
    from quireframe.functions.values import canonical

    element = F.concat(F.lit('<check id="'), C.markup_escaped(F.col("check")), F.lit('" status="'), C.markup_escaped(F.col("status")), F.lit('"><evidence>'), C.markup_escaped(canonical(F.col("evidence"))), F.lit("</evidence></check>"))
    return checks.select("doc_id", "check", element.alias("element"))


def suspect_entries(suspects: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suspects (page, text, confidence, left, top, width, height) with their digest, over canonical JSON, and what was decided
    (decisions: digest, state): id, digest, page, text, state. An undecided one has a null state."""
    from quireframe.functions.values import provenance

    body = F.to_json(F.struct("confidence", "height", "left", "page", "text", "top", "width"))
    each = suspects.withColumn("digest", provenance(body))
    return each.join(decisions.select("digest", "state"), "digest", "left").select(F.concat(F.lit("ocr-suspect-"), "digest").alias("id"), "digest", "page", "text", "state")


def published(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write ``df`` to a place where nothing is yet; anything there is an error and stays as it is."""
    df.write.mode("errorifexists").format(form).save(path)


def spreadsheet_lines(rows: DataFrame, key: str, cells: list[str]) -> DataFrame:
    """key and line of each row, all cells quoted and none that a spreadsheet takes for a formula."""
    return rows.select(key, F.concat_ws(",", *[quoted(F.col(c).cast("string")) for c in cells]).alias("line"))
