"""Whole files of interchange: forms with all that is wrong in them, comments under a digest, reports of checks, and recognized
layout as JSON, HTML and CSV. What one file holds meets in one row, as it must; nothing else does. Where a file cannot be
made, its row says why and has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.functions.values import canonical, canonical_list
from quireframe.operators import exports as E
from quireframe.operators import layout as L
from quireframe.operators import structure as C
from quireframe.operators.diff import quoted

#: The types of fields, and those of them that choose among options.
FIELD_TYPES = ("text", "checkbox", "radio", "select", "date", "number", "barcode", "signature")
CHOICES = ("radio", "select")
#: Bounds of a file, and what patterns and calculations of fields are made of.
MOST_RECORDS, MOST_PAGES, MOST_OPTIONS, LONGEST_TEXT, FARTHEST = 250, 10_000, 100, 4_000, 1_000_000
FIELD_PATTERN = r"^\^?(?:[A-Za-z0-9 ._-]|\\[ds]){1,120}\$?$"
CALCULATION = r"^(?:sum|average|min|max|product)\([A-Za-z0-9._-]+(?:,[A-Za-z0-9._-]+)*\)$"
#: What a check can come to.
STATUSES = ("pass", "warning", "fail", "not-checked")


def _first_fault(*faults: tuple[str, Column]) -> Column:
    """The name of the first of ``faults`` (name, condition) that holds; one that is null does not."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in faults])


def _no(condition: Column) -> Column:
    """Whether ``condition`` is false or null."""
    return ~F.coalesce(condition, F.lit(False))


def _text(item: Column, path: str) -> Column:
    """A member of a JSON value that is text, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(item, path, "variant")) == "STRING", F.try_variant_get(item, path, "string"))


def _printable(text: Column, longest: int) -> Column:
    return (F.length(text) <= longest) & ~text.rlike(r"[\x00-\x1f]")


def _members(item: Column) -> Column:
    """What a field says, read once: what a lambda says twice is worked out twice."""
    get = lambda path, kind: F.try_variant_get(item, path, kind)
    given = lambda path: F.coalesce(F.schema_of_variant(get(path, "variant")) != "VOID", F.lit(False))
    said = {"id": "$.id", "calculation": "$.calculation", "pattern": "$.validation.pattern", "least": "$.validation.min", "most": "$.validation.max", "options": "$.options"}
    texts = [_text(item, said.get(n, f"$.{n}")).alias(n) for n in ("id", "name", "type", "pattern", "calculation")]
    numbers = [get(said[n], "double").alias(n) for n in ("least", "most")]
    return F.struct(*texts, *numbers, get("$.options", "array<string>").alias("options"), get("$.page", "int").alias("page"), get("$.rectangle", "array<double>").alias("box"), *[given(path).alias(f"given_{n}") for n, path in said.items()])


def _field(m: Column) -> Column:
    """A field of ``_members`` with the first fault of its own."""
    name, kind, pattern, least, most, box = (m[n] for n in ("name", "type", "pattern", "least", "most", "box"))
    options = F.coalesce(m["options"], F.array().cast("array<string>"))
    given = lambda n: m[f"given_{n}"]
    whole = lambda v: (v == F.floor(v)) & v.between(-FARTHEST, FARTHEST)
    listed = (F.size(options) <= MOST_OPTIONS) & (F.size(F.array_distinct(options)) == F.size(options)) & ~F.exists(options, lambda o: _no(_printable(o, 256) & (F.trim(o) != "")))
    boxed = (F.size(box) == 4) & ~F.exists(box, lambda v: _no(v.between(-FARTHEST, FARTHEST))) & (box[0] <= box[2]) & (box[1] <= box[3])
    fault = _first_fault(
        ("bad-type", _no(kind.isin(*FIELD_TYPES))),
        ("bad-options", (given("options") & m["options"].isNull()) | _no(listed) | (kind.isin(*CHOICES) & (F.size(options) == 0))),
        ("unsafe-pattern", given("pattern") & _no((pattern == "") | pattern.rlike(FIELD_PATTERN))),
        ("bad-range", (given("least") & _no(whole(least))) | (given("most") & _no(whole(most))) | (least > most)),
        ("bad-id", given("id") & _no(m["id"].rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"))),
        ("bad-name", _no(_printable(name, 128) & (F.trim(name) != ""))),
        ("bad-page", _no(m["page"].between(1, MOST_PAGES))),
        ("bad-box", _no(boxed)),
        ("bad-calculation", given("calculation") & _no((m["calculation"] == "") | m["calculation"].rlike(CALCULATION))),
    )
    return F.struct(m["id"].alias("id"), name.alias("name"), kind.alias("type"), options.alias("options"), fault.alias("fault"))


def imported_forms(docs: DataFrame, form: str, column: str = "json", most: int = MOST_RECORDS) -> DataFrame:
    """Fields and values of forms interchanges (``docs``: doc_id and a JSON text of format ``form``), a row each: doc_id, kind
    (field or value), at (from 0), id, name and type (of the field; a value's are those of its field), value (a value's as
    text), code and accepted.

    code is the first fault, or null: of a field bad-type, bad-options, unsafe-pattern, bad-range, bad-id, bad-name, bad-page,
    bad-box, bad-calculation, duplicate-id or duplicate-name; of a value unknown-field or bad-value (true or false for a check
    box, a number for a number, one of the options for a choice, else printable text; none is text not given). A file is taken
    as a whole: accepted says that no row of it has a code. A text that is null, no JSON, of another format, without both
    lists or with over ``most`` in one gives one row of kind file with code bad-format. A form without fields and values gives
    no row; a field may have no id, and then no value is its. Rows that repeat are read each. A file is read within its row: nothing is shuffled."""
    read = docs.select("doc_id", F.try_parse_json(column).alias("_v"))
    lists = {k: F.try_variant_get("_v", f"$.{k}", "array<variant>") for k in ("fields", "values")}
    read = read.select("doc_id", _text(F.col("_v"), "$.format").alias("_format"), *[v.alias(f"_{k}") for k, v in lists.items()])
    good = F.coalesce((F.col("_format") == form) & (F.size("_fields") <= most) & (F.size("_values") <= most) & F.col("_fields").isNotNull() & F.col("_values").isNotNull(), F.lit(False))
    read = read.select("doc_id", good.alias("_good"), F.when(good, F.transform(F.transform("_fields", _members), _field)).alias("_fields"), F.when(good, F.col("_values")).alias("_values"))
    named = read.withColumns({"_ids": F.transform("_fields", lambda f: f["id"]), "_names": F.transform("_fields", lambda f: f["name"])})
    none = F.lit(None).cast("string")

    def field(f: Column, at: Column) -> Column:
        again = lambda names, x: F.array_position(names, x) <= at
        code = F.coalesce(f["fault"], _first_fault(("duplicate-id", again("_ids", f["id"])), ("duplicate-name", again("_names", f["name"]))))
        return F.struct(F.lit("field").alias("kind"), at.alias("at"), f["id"].alias("id"), f["name"].alias("name"), f["type"].alias("type"), none.alias("value"), code.alias("code"))

    def given(v: Column) -> Column:
        id_ = _text(v, "$.id")
        of = F.get("_fields", (F.array_position("_ids", id_) - 1).cast("int"))
        return F.struct(id_.alias("id"), of.alias("of"), F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.value", "variant")), F.lit("VOID")).alias("kind"), F.try_variant_get(v, "$.value", "string").alias("text"))

    def value(v: Column, at: Column) -> Column:
        of, kind, text = v["of"], v["kind"], v["text"]
        right = (
            F.when(of["type"] == "checkbox", kind == "BOOLEAN")
            .when(of["type"] == "number", kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"))
            .when(of["type"].isin(*CHOICES), (kind == "STRING") & F.array_contains(of["options"], text))
            .otherwise((kind == "VOID") | ((kind == "STRING") & _printable(text, LONGEST_TEXT)))
        )
        code = _first_fault(("unknown-field", F.coalesce(of["id"].isNull(), F.lit(True))), ("bad-value", _no(right)))
        return F.struct(F.lit("value").alias("kind"), at.alias("at"), v["id"].alias("id"), of["name"].alias("name"), of["type"].alias("type"), text.alias("value"), code.alias("code"))

    file = F.array(F.struct(F.lit("file").alias("kind"), F.lit(None).cast("int").alias("at"), none.alias("id"), none.alias("name"), none.alias("type"), none.alias("value"), F.lit("bad-format").alias("code")))
    rows = named.select("doc_id", F.when(F.col("_good"), F.concat(F.transform("_fields", field), F.transform(F.transform("_values", given), value))).otherwise(file).alias("_rows"))
    rows = rows.withColumn("accepted", ~F.exists("_rows", lambda r: r["code"].isNotNull()))
    # An inner explode would have the optimizer test the length of the rows, and so read each file, a second time below.
    return rows.select("doc_id", F.explode_outer("_rows").alias("r"), "accepted").filter("r.kind IS NOT NULL").select("doc_id", "r.*", "accepted")


def comment_envelopes(annotations: DataFrame, sources: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Comments of each document in an envelope: doc_id, n_comments, digest (SHA-256 of the comments' canonical JSON), envelope
    (canonical JSON of sourceSha256, revision, commentSha256, commentCount and comments) and code. ``annotations`` and
    ``chosen`` are as in ``exports.comments``; ``sources`` has doc_id (once), sha256 and revision. A document without comments,
    or of no source, has no row. Identifiers that a document has twice are a forged-id, and there is no envelope. Null authors
    and texts count as empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.to_json(F.struct(F.col("annotation_id").alias("annotationId"), empty("author").alias("author"), "id", "kind", "order", "page", empty("text").alias("text")))
    each = E.comments(annotations, chosen).groupBy("doc_id").agg(F.count("*").alias("n_comments"), (F.count_distinct("id") < F.count("*")).alias("_forged"), F.sort_array(F.collect_list(F.struct("order", one.alias("j")))).alias("_c"))
    listed = each.withColumn("_list", canonical(F.concat(F.lit("["), F.array_join(F.transform("_c", lambda c: c["j"]), ","), F.lit("]")))).withColumn("digest", F.sha2("_list", 256))
    head = F.to_json(F.struct(F.col("n_comments").alias("commentCount"), F.col("digest").alias("commentSha256")))
    tail = F.to_json(F.struct("revision", F.col("sha256").alias("sourceSha256")))
    whole = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"comments":'), "_list", F.lit(","), F.expr("substr(_tail, 2)"))
    both = listed.join(sources.select("doc_id", "sha256", "revision"), "doc_id").withColumns({"_head": head, "_tail": tail})
    return both.select("doc_id", "n_comments", "digest", F.when(~F.col("_forged"), whole).alias("envelope"), F.when(F.col("_forged"), "forged-id").alias("code"))


def check_reports(checks: DataFrame, documents: DataFrame, profile: str, limitations: list[str]) -> DataFrame:
    """Reports of checks as XML documents: doc_id, status, digest, xml and code. ``checks`` has doc_id, at, check, status,
    summary and evidence (a JSON text), in the order of at and check; ``documents`` has doc_id (once), sha256 and pages.

    status is fail if a check fails, review-required if one warns or was not made, else pass. digest is the SHA-256 of the
    report's canonical JSON, which the document names. code is bad-check where an identifier, status, summary or evidence is
    none, missing or beyond what XML takes, else null; then there is no digest and no document. Documents without checks have
    a report without any."""
    esc = C.markup_escaped

    def one(r: Column) -> Column:
        check, status, summary, e = r["r"]["check"], r["r"]["status"], r["r"]["summary"], r["e"]
        good = check.rlike(r"^[a-z0-9.-]{1,128}$") & status.isin(*STATUSES) & C.xml_valid(summary) & C.xml_valid(e) & e.isNotNull()
        json = F.concat(F.lit('{"evidence":'), e, F.lit(","), F.substr(F.to_json(F.struct(check.alias("id"), status.alias("status"), summary.alias("summary"))), F.lit(2)))
        xml = F.concat(F.lit('    <check id="'), check, F.lit('" status="'), status, F.lit('">\n      <summary>'), esc(summary), F.lit('</summary>\n      <evidence encoding="canonical-json">'), esc(e), F.lit("</evidence>\n    </check>\n"))
        return F.struct(r["r"]["at"].alias("at"), check.alias("check"), status.alias("status"), json.alias("_j"), xml.alias("_x"), F.coalesce(good, F.lit(False)).alias("_ok"))

    # Checks meet as they are: their texts, which are several times as large, are made afterwards and not shuffled. Nor is Python asked
    # before, as what it gives counts as parted by no key.
    met = checks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "check", "status", "summary", "evidence")).alias("_r"))
    both = documents.select("doc_id", "sha256", "pages").join(met, "doc_id", "left")
    both = both.withColumn("_r", F.coalesce("_r", F.expr("array()").cast(met.schema["_r"].dataType)))
    both = both.withColumn("_e", canonical_list(F.transform("_r", lambda r: r["evidence"])))
    both = both.select("doc_id", "sha256", "pages", F.sort_array(F.transform(F.arrays_zip(F.col("_r").alias("r"), F.col("_e").alias("e")), one)).alias("_c"))
    both = both.withColumn("_ok", F.forall("_c", lambda c: c["_ok"]))
    count = lambda s: F.size(F.filter("_c", lambda c: F.coalesce(c["status"] == s, F.lit(False))))
    both = both.withColumns({f"_n_{s}": count(s) for s in STATUSES})
    n = {s: F.col(f"`_n_{s}`").cast("string") for s in STATUSES}
    status = F.when(F.col("_n_fail") > 0, "fail").when((F.col("_n_warning") > 0) | (F.col("`_n_not-checked`") > 0), "review-required").otherwise("pass")
    limits = F.array(*map(F.lit, limitations)).cast("array<string>")
    # Members are written in the order of their names, and evidence is canonical already: so is the whole.
    body = F.concat(
        F.lit('{"authoritative":false,"checks":['), F.array_join(F.transform("_c", lambda c: c["_j"]), ","), F.lit('],"counts":{'),
        F.concat_ws(",", *[F.concat(F.lit(f'"{s}":'), n[s]) for s in sorted(STATUSES)]), F.lit('},"document":'), F.to_json(F.struct(F.col("pages").alias("pageCount"), "sha256")),
        F.lit(',"kind":"preflight-review","limitations":'), F.to_json(limits), F.lit(',"localOnly":true,"profile":'), F.to_json(F.struct(F.lit(True).alias("fixed"), F.lit(profile).alias("id"))),
        F.lit(',"schemaVersion":1,"status":"'), "status", F.lit('"}'),
    )
    both = both.withColumn("status", status).withColumn("digest", F.when(F.col("_ok"), F.sha2(body, 256)))
    lines = "".join(f"    <limitation>{escaped(x)}</limitation>\n" for x in limitations)
    document = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<preflight-review schema-version="1" local-only="true" authoritative="false" report-sha256="'), "digest",
        F.lit(f'">\n  <profile id="{escaped(profile)}" fixed="true"/>\n  <document sha256="'), "sha256", F.lit('" page-count="'), F.col("pages").cast("string"), F.lit('"/>\n  <result status="'), "status", F.lit('">\n    <counts '),
        F.concat_ws(" ", *[F.concat(F.lit(f'{s}="'), n[s], F.lit('"')) for s in STATUSES]), F.lit('/>\n  </result>\n  <checks count="'), F.size("_c").cast("string"), F.lit('">\n'),
        F.array_join(F.transform("_c", lambda c: c["_x"]), ""), F.lit(f'  </checks>\n  <limitations count="{len(limitations)}">\n{lines}  </limitations>\n</preflight-review>\n'),
    )
    return both.select("doc_id", "status", "digest", F.when(F.col("_ok"), document).alias("xml"), F.when(~F.col("_ok"), "bad-check").alias("code"))


def escaped(text: str) -> str:
    """``structure.markup_escaped`` for a text of the caller."""
    return reduce(lambda t, e: t.replace(*e), C.MARKUP_ESCAPES, text)


def _met_pages(words: DataFrame, sizes: DataFrame, *by: str) -> DataFrame:
    """A row for each of ``sizes``: doc_id, page and _p, a structure of page, wide, high and _w, the page's words as they are. Both tables are
    dealt out once, ``by`` their keys or some of them, so that no word is shuffled as a text made of it, nor a second time."""
    word = F.struct("id", "text", "confidence", "x", "y", "width", "height")
    size = F.struct(F.col("points_wide").alias("wide"), F.col("points_high").alias("high"))
    words, sizes = words.filter("doc_id IS NOT NULL AND page IS NOT NULL").select("doc_id", "page", word.alias("_w")), sizes.select("doc_id", "page", size.alias("_z"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = words.select("*", none(sizes, "_z")).unionByName(sizes.select("*", none(words, "_w"))).repartition(*by)
    met = rows.groupBy("doc_id", "page").agg(F.collect_list("_w").alias("_w"), F.collect_list("_z").alias("_z"))
    return met.select("doc_id", "page", "_w", F.explode("_z").alias("_z")).select("doc_id", "page", F.struct("page", "_z.wide", "_z.high", "_w").alias("_p"))


def _page_code(p: Column) -> Column:
    """What is wrong with a page, or null."""
    on = lambda w: F.coalesce(reduce(lambda a, b: a & b, [w[c].between(0, 1) for c in ("x", "y", "width", "height")]) & (w["x"] + w["width"] <= 1.000001) & (w["y"] + w["height"] <= 1.000001), F.lit(False))
    return _first_fault(("bad-size", _no((p["wide"] > 0) & (p["high"] > 0))), ("bad-word", ~F.forall(p["_w"], on)))


def _page_parts(p: Column) -> Column:
    """The texts of a page without faults: page, json and html."""

    def texts(w: Column) -> Column:
        bounds = F.struct(*[w[c].alias(c) for c in ("x", "y", "width", "height")])
        pc = lambda c: F.format_string("%.4f", w[c] * 100)
        style = F.concat(F.lit("left:"), pc("x"), F.lit("%;top:"), pc("y"), F.lit("%;width:"), pc("width"), F.lit("%;height:"), pc("height"), F.lit("%"))
        e = lambda c: C.markup_escaped(F.coalesce(w[c].cast("string"), F.lit("")))
        span = F.concat(F.lit('<span data-confidence="'), e("confidence"), F.lit('" style="'), style, F.lit('">'), e("text"), F.lit("</span>"))
        one = F.to_json(F.struct(w["id"].alias("id"), F.coalesce(w["text"], F.lit("")).alias("text"), w["confidence"].alias("confidence"), bounds.alias("bounds")))
        return F.struct(w["y"].alias("y"), w["x"].alias("x"), w["id"].alias("id"), one.alias("j"), span.alias("s"))

    n, wide, high = (p[c].cast("string") for c in ("page", "wide", "high"))

    def parts(w: Column) -> Column:
        json = F.concat(F.lit('{"page":'), n, F.lit(',"width":'), wide, F.lit(',"height":'), high, F.lit(',"words":['), F.array_join(F.transform(w, lambda t: t["j"]), ","), F.lit("]}"))
        html = F.concat(F.lit("<section><h2>Page "), n, F.lit('</h2><div class="ocr-page" style="aspect-ratio:'), wide, F.lit("/"), high, F.lit('">'), F.array_join(F.transform(w, lambda t: t["s"]), ""), F.lit("</div></section>"))
        return F.struct(p["page"].alias("page"), json.alias("json"), html.alias("html"))

    # Of a list of one, so that a page's texts are made and sorted once for both parts.
    return F.transform(F.array(F.sort_array(F.transform(p["_w"], texts))), parts)[0]


def layout_pages(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """Recognized words (doc_id, page, id, text, confidence, x, y, width, height as shares of the page) and pages (doc_id, page,
    points_wide, points_high) as a part for each page: doc_id, page, n_words, json, html and code. Words are in the order of y,
    x and id; a page without words has empty parts. code is bad-size where a page has no positive size, bad-word where a word
    is not on its page, else null; then there are no parts. Words of a page without size are in no part."""
    each = _met_pages(words, sizes, "doc_id", "page").withColumn("code", _page_code(F.col("_p")))
    each = each.withColumn("_t", F.when(F.col("code").isNull(), _page_parts(F.col("_p"))))
    return each.select("doc_id", "page", F.size("_p._w").cast("long").alias("n_words"), "_t.json", "_t.html", "code")


def layout_documents(words: DataFrame, sizes: DataFrame, title: str = "Positioned words") -> DataFrame:
    """The parts of ``layout_pages`` as a file for each document: doc_id, n_pages, n_words, json, html and code, that of the
    first page with one; then there are no files."""
    each = _met_pages(words, sizes, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.size("_p._w")).alias("n_words"), F.collect_list("_p").alias("_p"))
    faults = F.filter(F.transform("_p", lambda p: F.struct(p["page"].alias("page"), _page_code(p).alias("code"))), lambda f: f["code"].isNotNull() & f["page"].isNotNull())
    each = each.withColumn("code", F.array_min(faults)["code"])
    each = each.withColumn("_t", F.when(F.col("code").isNull(), F.sort_array(F.transform("_p", _page_parts))))
    joined = lambda part, by: F.array_join(F.transform("_t", lambda s: s[part]), by)
    t = escaped(title)
    json = F.concat(F.lit('{"schemaVersion":1,"pages":['), joined("json", ","), F.lit("]}"))
    html = F.concat(F.lit(f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{t}</title><style>.ocr-page{{position:relative}}.ocr-page span{{position:absolute}}</style></head><body><h1>{t}</h1>'), joined("html", ""), F.lit("</body></html>"))
    return each.select("doc_id", "n_pages", "n_words", json.alias("json"), html.alias("html"), "code")


def table_csv(words: DataFrame, most_rows: int = L.MOST_ROWS, most_columns: int = L.MOST_COLUMNS) -> DataFrame:
    """The table that each document's words form (``layout.tables``) as CSV: doc_id, rows, columns and csv, all cells quoted and
    none that a spreadsheet takes for a formula, lines ended by CR LF. Cells without words are empty."""
    shape = L.tables(words, most_rows, most_columns).select("doc_id", "rows", "columns")
    cells = L.table_cells(words, most_rows, most_columns).groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("column").cast("int").alias("k"), "text"))).alias("_m"))
    line = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda i: quoted(F.element_at(F.col("_m"), i))), ","), F.lit("\r\n"))
    lines = cells.join(shape, "doc_id").select("doc_id", "rows", "columns", "row", line.alias("line"))
    each = lines.groupBy("doc_id", "rows", "columns").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("_l"))
    return each.select("doc_id", "rows", "columns", F.array_join(F.transform("_l", lambda s: s["line"]), "").alias("csv"))
