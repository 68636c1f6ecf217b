"""Rule engines: document profiles as rows of checks, form values, workflows that carry a state, chains of intent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireframe.functions import values as V
from quireframe.functions.bounded import bounded_test_of
from quireframe.operators import inventory as I
from quireframe.operators import text as X
from quireframe.session import ship_code

STATUSES = ("pass", "warning", "fail", "not-checked")
#: The roles of tagged text, and the parents that lists and tables ask for.
TAG_ROLES = (
    "Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private", "P", "H", "H1", "H2", "H3", "H4", "H5", "H6",
    "L", "LI", "Lbl", "LBody", "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot", "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Ruby",
    "RB", "RT", "RP", "Warichu", "WT", "WP", "Figure", "Formula", "Form", "Artifact",
)
LIST_PARENTS = {"LI": ["L"], "Lbl": ["LI"], "LBody": ["LI"]}
TABLE_PARENTS = {"TR": ["Table", "THead", "TBody", "TFoot"], "TH": ["TR"], "TD": ["TR"]}
LEAST_PPI = 150


def _checks(rows: DataFrame, of: str, checks: dict[str, Column]) -> DataFrame:
    """A row (of, check, status) for each check of each row."""
    made = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()])
    return rows.select(of, F.explode(made).alias("c")).select(of, "c.check", "c.status")


def preflight(documents: DataFrame, fonts: DataFrame, images: DataFrame, pages: DataFrame, profile: str, of: str = "doc_id") -> DataFrame:
    """The checks of print-review or archive-review for each document: of, check and status.

    ``documents`` has encrypted and javascript (yes, no or unknown), truncated (whether pages were left out) and xmp (whether
    there is a packet); fonts have embedded; images width, height, bits, x_ppi and y_ppi; pages width, height and boxes
    media_box, bleed_box and trim_box. Each is counted by document before it is joined. What cannot be told is not-checked.
    """
    if profile not in ("print-review", "archive-review"):
        raise ValueError(f"unknown profile {profile}")
    f = fonts.groupBy(of).agg(F.count_if(~I.said_yes(F.col("embedded"))).alias("_unembedded"))
    bad = ~F.coalesce((F.col("width") >= 1) & (F.col("height") >= 1) & (F.col("bits") >= 1), F.lit(False))
    known = F.col("x_ppi").isNotNull() & F.col("y_ppi").isNotNull()
    i = images.groupBy(of).agg(F.count_if(bad).alias("_bad"), F.count_if(known & (F.least("x_ppi", "y_ppi") < LEAST_PPI)).alias("_low"), F.count_if(~known).alias("_dark"))
    m, b, t = (F.col(f"{x}_box") for x in ("media", "bleed", "trim"))
    outside = (b.isNotNull() & ~V.box_holds(m, b)) | (t.isNotNull() & b.isNotNull() & ~V.box_holds(b, t))
    p = pages.groupBy(of).agg(F.count_distinct("width", "height").alias("_sizes"), F.count_if(outside).alias("_outside"), F.count_if(t.isNull() | b.isNull()).alias("_lacking"))
    all_ = documents.join(f, of, "left").join(i, of, "left").join(p, of, "left").fillna(0, ["_unembedded", "_bad", "_low", "_dark", "_sizes", "_outside", "_lacking"])
    n = F.col
    by_flag = lambda c, bad_status: F.when(I.said_no(n(c)), "pass").when(I.said_yes(n(c)), bad_status).otherwise("not-checked")
    printed = profile == "print-review"
    checks = {
        "document.encryption": by_flag("encrypted", "warning" if printed else "fail"),
        "document.javascript": by_flag("javascript", "fail"),
        "fonts.embedding": F.when(n("_unembedded") > 0, "fail").otherwise("pass"),
        "pages.geometry-consistency": F.when(n("_sizes") > 1, "warning").otherwise("pass"),
    }
    if printed:
        checks["pages.production-boxes"] = F.when(n("_outside") > 0, "fail").when(n("_lacking") > 0, "warning").otherwise("pass")
    checks["pages.inspection-range"] = F.when(n("truncated"), "not-checked").otherwise("pass")
    if printed:
        checks["images.inventory"] = F.when(n("_bad") > 0, "fail").otherwise("pass")
        checks["images.effective-resolution"] = F.when(n("_low") > 0, "warning").when(n("_dark") > 0, "not-checked").otherwise("pass")
    else:
        checks["metadata.xmp"] = F.when(n("xmp"), "pass").otherwise("fail")
    checks["color.output-intent"] = F.lit("not-checked")
    if printed:
        checks["color.spot-and-overprint-semantics"] = F.lit("not-checked")
    return _checks(all_, of, checks)


def rolled_up(checks: DataFrame, of: str = "doc_id") -> DataFrame:
    """Per document the number of checks of each status, zeros included, and the verdict: fail, review-required where there
    is a warning or what was not checked, or pass."""
    counts = checks.groupBy(of).agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES])
    return counts.withColumn("verdict", F.when(F.col("fail") > 0, "fail").when((F.col("warning") > 0) | (F.col("not_checked") > 0), "review-required").otherwise("pass"))


def tag_summary(rows: DataFrame, of: str = "doc_id", order: str = "seq", depth: str = "depth", value: str = "value") -> DataFrame:
    """Per document of depth-coded tag lines (two blanks a level): records, unknown roles, steps of depth that are none,
    headings, whether their levels skip, the numbers of roles that shape checks ask for, and list and table roles whose
    parent is another than they ask for, or is unknown. ``complete``: no unknown role and no bad step."""
    from quireframe.operators import records as R

    role = F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9]*)(?:\s|\(|$)", 1)
    known = F.when(role.isin(*TAG_ROLES), role)
    ok = F.coalesce((F.col(depth) >= 0) & (F.col(depth) % 2 == 0), F.lit(False))
    rows = rows.select(F.col(of), F.col(order), known.alias("role"), ok.alias("ok"), F.when(ok, F.col(depth)).otherwise(0).cast("int").alias("d"))
    tree = R.tree_parents(rows, of, order, "d")
    parents = rows.select(F.col(of).alias("_of"), F.col(order).alias("_at"), F.col("role").alias("above"))
    tree = tree.join(parents, (F.col(of) == F.col("_of")) & (F.col("parent") == F.col("_at")), "left")
    w = Window.partitionBy(of).orderBy(order)
    before = F.lag("d").over(w)
    level = F.regexp_extract("role", "^H([1-6])$", 1).try_cast("int") if hasattr(Column, "try_cast") else F.expr("try_cast(regexp_extract(role, '^H([1-6])$', 1) AS int)")
    tree = tree.withColumn("fault", ~F.col("ok") | F.when(before.isNull(), F.col("d") != 0).otherwise((F.col("d") > before) & (F.col("d") != before + 2))).withColumn("level", level)
    last = F.last("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tree = tree.withColumn("skip", F.coalesce(F.when(last.isNull(), F.col("level") != 1).otherwise(F.col("level") > last + 1), F.lit(False)))

    def odd(parents_of: dict[str, list[str]], unknown: bool) -> Column:
        asks = F.col("role").isin(*parents_of)
        if unknown:
            return F.coalesce(asks & F.col("above").isNull(), F.lit(False))
        wrong = reduce(lambda a, kv: a | ((F.col("role") == kv[0]) & ~F.col("above").isin(*kv[1])), parents_of.items(), F.lit(False))
        return F.coalesce(wrong & F.col("above").isNotNull(), F.lit(False))

    out = {"unknown_roles": F.col("role").isNull(), "bad_steps": F.col("fault"), "headings": F.col("level").isNotNull(), "list_parents": odd(LIST_PARENTS, False), "list_unknown": odd(LIST_PARENTS, True), "table_parents": odd(TABLE_PARENTS, False), "table_unknown": odd(TABLE_PARENTS, True)}
    roles = ["Document", "L", "LI", "LBody", "Table", "TR", "TH", "TD", "Artifact"]
    each = tree.groupBy(of).agg(F.count("*").alias("records"), *[F.count_if(v).alias(k) for k, v in out.items()], F.bool_or("skip").alias("skips"), *[F.count_if(F.col("role") == r).alias(f"n_{r.lower()}") for r in roles])
    return each.withColumn("complete", (F.col("unknown_roles") == 0) & (F.col("bad_steps") == 0))


def tag_roles(rows: DataFrame, of: str = "doc_id", value: str = "value") -> DataFrame:
    """Per document and known role its number: of, role and n; roles that are not known are under a null role."""
    role = F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9]*)(?:\s|\(|$)", 1)
    return rows.groupBy(of, F.when(role.isin(*TAG_ROLES), role).alias("role")).agg(F.count("*").alias("n"))


def accessibility(documents: DataFrame, tags: DataFrame, fonts: DataFrame, pages: DataFrame, of: str = "doc_id") -> DataFrame:
    """The accessibility checks of each document: of, check and status. ``documents`` has tagged, title, language, form (texts)
    and content_accessible (boolean or null); ``tags`` are ``tag_summary``'s; fonts have embedded and unicode; pages text.
    What no inspection can prove stays not-checked."""
    f = I.font_evidence(fonts, of)
    p = pages.groupBy(of).agg(F.count_if(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("_empty"))
    counted = ["fonts", "not_embedded", "unknown_embedded", "not_unicode", "unknown_unicode", "_empty", "records", "headings", "list_parents", "list_unknown", "table_parents", "table_unknown", "n_document", "n_l", "n_li", "n_lbody", "n_table", "n_tr", "n_th", "n_td"]
    d = documents.join(tags, of, "left").join(f, of, "left").join(p, of, "left").fillna(0, counted).fillna(False, ["complete", "skips"])
    n = F.col
    tagged, structure = I.said_yes(n("tagged")), n("records") > 0
    said = lambda c: F.coalesce(F.trim(n(c)) != "", F.lit(False))
    whole = n("complete")
    by_font = lambda bad, dark: F.when(n(bad) > 0, "fail").when(n(dark) > 0, "warning").when(n("fonts") > 0, "pass").otherwise("not-checked")
    none = F.lit("not-checked")
    return _checks(d, of, {
        "tagged-indicator": F.when(tagged, "pass").otherwise("fail"),
        "tag-structure-listing": F.when(structure, "pass").otherwise("fail"),
        "tag-role-inventory": F.when(~tagged | ~structure, none).when((n("n_document") > 0) & whole, "pass").otherwise("warning"),
        "heading-role-sequence": F.when(n("headings") == 0, none).when(n("skips"), "warning").when(whole, "pass").otherwise(none),
        "list-role-shape": F.when(n("n_l") == 0, none).when(n("list_parents") > 0, "warning").when(~whole | (n("list_unknown") > 0), none).when((n("n_li") >= n("n_l")) & (n("n_lbody") >= n("n_li")), "pass").otherwise("warning"),
        "table-role-shape": F.when(n("n_table") == 0, none).when(n("table_parents") > 0, "warning").when(~whole | (n("table_unknown") > 0), none).when((n("n_tr") < n("n_table")) | (n("n_th") + n("n_td") == 0) | (n("n_th") == 0), "warning").otherwise("pass"),
        "document-title": F.when(said("title"), "pass").otherwise("warning"),
        "document-language": F.when(said("language"), "pass").otherwise("warning"),
        "font-tounicode": by_font("not_unicode", "unknown_unicode"),
        "font-embedding": by_font("not_embedded", "unknown_embedded"),
        "empty-extracted-text-pages": F.when(n("_empty") > 0, "warning").otherwise("pass"),
        "image-alt-text": none, "artifact-classification": none,
        "form-semantics": F.when(F.lower(F.trim(n("form"))) == "none", "pass").otherwise(none),
        "reading-order": none, "link-bookmark-semantics": none, "contrast": none,
        "screen-reader-permissions": F.when(n("content_accessible").isNull(), none).when(n("content_accessible"), "pass").otherwise("fail"),
        "pdf-ua-conformance": none,
    })


LANGUAGE = r"[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})?"


#: Names of metadata entries, elements and attributes that declare a language, and how far a language list reaches.
LANGUAGE_ENTRIES = ("language", "lang", "dc:language")
LANGUAGE_ELEMENTS = ("dc:language", "pdf:lang", "xmp:language")
LANGUAGE_ATTRIBUTES = ("xml:lang", "language")
LANGUAGE_LIST, LANGUAGE_ITEM, LANGUAGE_REACH = "dc:language", "rdf:li", 4096


def _tags(xml: Column) -> Column:
    """The tags of ``xml`` in order: name (in small letters, a slash before that of a closing one), code (the language that all
    text up to the next tag is, else empty), next (the next tag's name), length (with that text) and after (of that text)."""
    each = F.transform(
        F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit("<[^<>]*>[^<]*"), F.lit(0)),
        lambda t: F.struct(F.lower(F.regexp_extract(t, r"^<(/?[^\s/<>]*)", 1)).alias("name"), F.regexp_extract(t, rf">\s*({LANGUAGE})\s*$", 1).alias("code"), F.length(t).alias("length"), (F.length(t) - F.instr(t, F.lit(">"))).alias("after")),
    )
    following = F.concat(F.slice(F.transform(each, lambda t: t["name"]), F.lit(2), F.size(each)), F.array(F.lit("")))
    return F.when(F.size(each) > 0, F.zip_with(each, following, lambda t, n: t.withField("next", n))).otherwise(F.array().cast("array<struct<name:string,code:string,length:int,after:int,next:string>>"))


def declared_language(custom: Column, xml: Column) -> Column:
    """The language that metadata declares: that of the first custom entry (array of name and value) of ``LANGUAGE_ENTRIES``
    whose value is one; else, of the packet, that of the first item within 4,096 characters of the beginning of a language
    list, of the first element, or of the first attribute that is one, in this order; else null. The packet is read tag by
    tag and need not be well-formed."""
    named = F.filter(custom, lambda e: F.lower(e["name"]).isin(*LANGUAGE_ENTRIES) & F.trim(e["value"]).rlike(f"^{LANGUAGE}$"))
    tags = _tags(xml)

    def step(s: Column, t: Column) -> Column:
        item = (s["gap"] <= LANGUAGE_REACH) & (t["name"] == LANGUAGE_ITEM) & (t["next"] == f"/{LANGUAGE_ITEM}") & (t["code"] != "")
        gap = F.when(t["name"] == LANGUAGE_LIST, t["after"]).otherwise(s["gap"] + t["length"])
        return F.struct(gap.alias("gap"), F.coalesce(s["code"], F.when(item, t["code"])).alias("code"))

    listed = F.aggregate(tags, F.struct(F.lit(None).cast("int").alias("gap"), F.lit(None).cast("string").alias("code")), step, lambda s: s["code"])
    elements = F.filter(tags, lambda t: t["name"].isin(*LANGUAGE_ELEMENTS) & t["next"].isin(*[f"/{e}" for e in LANGUAGE_ELEMENTS]) & (t["code"] != ""))
    attribute = F.regexp_extract(F.coalesce(xml, F.lit("")), rf"(?i)(?:{'|'.join(LANGUAGE_ATTRIBUTES)})=[\"']({LANGUAGE})[\"']", 1)
    return F.coalesce(F.trim(F.get(named, 0)["value"]), listed, F.get(elements, 0)["code"], F.nullif(attribute, F.lit("")))


def issues(documents: DataFrame, pages: DataFrame, images: DataFrame, fields: DataFrame, of: str = "doc_id") -> DataFrame:
    """Accessibility issues, a row each: of, id (a11y-1 and on, in the order of rules and pages), rule, severity and page.
    ``documents`` has tagged, unicode_mapped and fonts_embedded (booleans), title and language; pages empty; images alt_text
    and fields label, both with page."""
    rules = {"tagged-pdf": ("error", ~F.coalesce(F.col("tagged"), F.lit(False))), "document-title": ("warning", F.coalesce(F.col("title") == "", F.lit(True))), "document-language": ("warning", F.coalesce(F.col("language") == "", F.lit(True))), "unicode-mapping": ("error", F.coalesce(~F.col("unicode_mapped"), F.lit(False))), "font-embedding": ("warning", F.coalesce(~F.col("fonts_embedded"), F.lit(False)))}
    broken = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("k"), F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for i, (r, (s, c)) in enumerate(rules.items())]))
    none = F.lit(None).cast("int").alias("page")
    rows = [documents.select(of, F.explode(broken).alias("r")).select(of, "r.k", "r.rule", "r.severity", none, F.lit(0).cast("long").alias("at"))]
    parts = ((pages, F.coalesce("empty", F.lit(False)), "empty-page", "warning"), (images, F.coalesce(F.col("alt_text") == "", F.lit(True)), "image-alt-text", "error"), (fields, F.coalesce(F.col("label") == "", F.lit(True)), "form-label", "error"))
    for i, (d, bad, rule, severity) in enumerate(parts, len(rules)):
        rows.append(d.filter(bad).select(of, F.lit(i).alias("k"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("page").cast("int"), F.col("at").cast("long")))
    each = reduce(DataFrame.unionByName, rows)
    n = F.row_number().over(Window.partitionBy(of).orderBy("k", "page", "at"))
    return each.select(of, F.concat(F.lit("a11y-"), n.cast("string")).alias("id"), "rule", "severity", "page")


def field_values(rows: DataFrame) -> DataFrame:
    """Values (text) of form fields by type (type, options): value as it is kept, and ``valid``. A checkbox is true or false,
    a number finite, a choice one of its options."""
    v, kind = F.col("value"), F.col("type")
    number = F.expr("try_cast(value AS double)")
    finite = F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
    ok = F.when(kind == "checkbox", v.isin("true", "false")).when(kind == "number", finite).when(kind.isin("radio", "select"), F.array_contains("options", v)).otherwise(v.isNotNull())
    kept = F.when(kind == "number", V.fifteen_digits(number).cast("string")).otherwise(v)
    ok = F.coalesce(ok, F.lit(False))
    return rows.withColumn("valid", ok).withColumn("value", F.when(F.col("valid"), kept))


def with_values(fields: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """Every field with its value, an empty text where it has none."""
    v = values.select(F.col(key).alias("_id"), F.col("value").alias("_v"))
    return fields.join(v, F.col(key) == F.col("_id"), "left").withColumn("value", F.coalesce("_v", F.lit(""))).drop("_id", "_v")


def unknown_values(fields: DataFrame, values: DataFrame, key: str = "id") -> DataFrame:
    """Values that are of no field: an import that has any is refused."""
    return values.join(fields.select(key), key, "left_anti")


def value_errors(rows: DataFrame, of: str) -> DataFrame:
    """A row (of, field, code) per rule that a value breaks. ``rows`` has field, value (text), value_type (string or boolean, null
    is string) and the rules: required (null is true), type, min_length, max_length and pattern (null: none; a bounded expression
    of 200 characters at most, which the value or a part of it must match). A blank text that is required breaks that rule
    only, a value of another type than asked for that one only, and a boolean has no length and no pattern. An expression that
    the grammar refuses is an error, as a rule that cannot be checked must not pass."""
    ship_code(rows.sparkSession)
    v, is_text = F.col("value"), F.coalesce(F.col("value_type"), F.lit("string")) == "string"
    blank = is_text & F.coalesce(F.col("required"), F.lit(True)) & (F.coalesce(X.trimmed(v), F.lit("")) == "")
    other_type = F.coalesce(F.col("type") != F.coalesce(F.col("value_type"), F.lit("string")), F.lit(False))
    # Only what the rule applies to leaves the JVM.
    asked = F.when(is_text & ~blank & ~other_type & F.col("pattern").isNotNull(), v)
    tested = rows.withColumn("_matches", bounded_test_of(asked, F.col("pattern"), longest=200, allow_empty=True))
    codes = F.when(is_text, F.array_compact(F.array(F.when(F.length(v) < F.col("min_length"), "MIN_LENGTH"), F.when(F.length(v) > F.col("max_length"), "MAX_LENGTH"), F.when(~F.col("_matches"), "PATTERN"))))
    return tested.select(of, "field", F.explode(F.when(blank, F.array(F.lit("REQUIRED"))).when(other_type, F.array(F.lit("TYPE"))).otherwise(codes)).alias("code"))


def workflow(facts: DataFrame, steps: list[dict], of: str) -> DataFrame:
    """Conditional workflows: a row per step of each ``facts`` row: of, step (from 1), matched, status (queued or skipped),
    jobs and queued (so far). A step is {field, operator, value, then, otherwise}: a condition on a column of ``facts``, on
    queuedCount or on previousStatus (none, queued, skipped at first), and how many jobs each branch queues (0: it skips).
    The state is carried from step to step; null matches nothing."""
    queued, status, out = F.lit(0), F.lit("none"), []
    for i, s in enumerate(steps, 1):
        actual = {"queuedCount": queued, "previousStatus": status}.get(s["field"], F.col(s["field"]) if s["field"] not in ("queuedCount", "previousStatus") else None)
        matched = I.condition_holds(actual, s["operator"], s["value"])
        jobs = F.when(matched, s["then"]).otherwise(s["otherwise"])
        status, queued = F.when(jobs > 0, "queued").otherwise("skipped"), queued + jobs
        out.append(F.struct(F.lit(i).alias("step"), matched.alias("matched"), status.alias("status"), jobs.alias("jobs"), queued.alias("queued")))
    return facts.select(of, F.explode(F.array(*out)).alias("s")).select(of, "s.*")


def resolved(rows: DataFrame) -> DataFrame:
    """Conflicts settled by their policy: value is local's or incoming's for keep-local and keep-incoming, and null for manual,
    where both stay; status is settled or open. Equal values are no conflict."""
    same = F.col("local").eqNullSafe(F.col("incoming"))
    value = F.when(same | (F.col("policy") == "keep-local"), F.col("local")).when(F.col("policy") == "keep-incoming", F.col("incoming"))
    return rows.withColumn("value", value).withColumn("status", F.when(same | F.col("policy").isin("keep-local", "keep-incoming"), "settled").otherwise("open"))


#: The records of a signing intent, in order.
INTENT = ("consent", "routed-signature", "visible-appearance", "audit")


def intents(records: DataFrame, of: str, order: str) -> DataFrame:
    """Per intent (of): records and ``valid``: they are the four kinds in order, each naming the digest of the one before
    (genesis for the first), each digest that of its own content. ``records`` has type, id, previous, digest, intent and data
    (JSON text, null for the audit record). Digests are over canonical JSON."""
    w = Window.partitionBy(of).orderBy(order)
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    value = lambda c: F.regexp_replace(quoted(c), r"^\{\"v\":(.*)\}$", "$1")
    body = F.concat(F.lit('{"data":'), F.coalesce("data", F.lit("null")), F.lit(',"id":'), value(F.col("id")), F.lit(',"intentHash":'), value(F.col("intent")), F.lit(',"previousHash":'), value(F.col("previous")), F.lit(',"type":'), value(F.col("type")), F.lit("}"))
    plain = F.concat(F.lit('{"id":'), value(F.col("id")), F.lit(',"intentHash":'), value(F.col("intent")), F.lit(',"previousHash":'), value(F.col("previous")), F.lit(',"type":"audit"}'))
    want = F.sha2(F.when(F.col("type") == "audit", plain).otherwise(body), 256)
    kind = F.get(F.array(*[F.lit(t) for t in INTENT]), F.row_number().over(w) - 1)
    ok = F.col("previous").eqNullSafe(F.coalesce(F.lag("digest").over(w), F.lit("genesis"))) & F.col("digest").eqNullSafe(want) & F.col("type").eqNullSafe(kind)
    each = records.withColumn("_ok", ok).groupBy(of).agg(F.count("*").alias("records"), F.bool_and("_ok").alias("_ok"))
    return each.select(of, "records", ((F.col("records") == len(INTENT)) & F.col("_ok")).alias("valid"))
