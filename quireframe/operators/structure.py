"""What the lines and sentences of a text say of its structure: roles, bookmarks, fields, cues, blocks and escapes. All are column
expressions over one text, or rows of its lines."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.operators import text as X
from quireframe.session import checkpointed

EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Lines of a text that are read for roles, fields and labels, and what is listed of them, at most.
ROLE_LINES, FORM_LINES, FIELDS, LABEL_LINES, BOOKMARKS = 100, 200, 50, 50, 50


def _lines(text: Column, trim: bool = True) -> Column:
    parts = F.split(text, "\n+", -1)
    return F.filter(F.transform(parts, X.trimmed) if trim else parts, lambda x: x != "")


def line_roles(docs: DataFrame, most: int = ROLE_LINES) -> DataFrame:
    """doc_id, order (from 1), role and text (200 characters) of the first ``most`` lines that are not empty: H1 for a first
    line like a heading, LBody for items of lists, H2 for short lines that begin with a capital and have no full stop, else
    P."""
    each = docs.select("doc_id", F.posexplode(F.slice(_lines(F.col("text"), trim=False), 1, most)).alias("i", "line"))
    line = F.col("line")
    role = F.when((F.col("i") == 0) & line.rlike(rf"(?i)^(?:#{{1,6}}\s|(?:chapter|section|part){X.EDGES[1]})"), "H1").when(line.rlike(r"^\s*[-*•]\s"), "LBody").when(line.rlike(r"^[0-9]+[.)]\s"), "LBody")
    role = role.when((F.length(line) < 48) & line.rlike("^[A-Z]") & ~line.rlike("[.!?]$"), "H2").otherwise("P")
    return each.select("doc_id", (F.col("i") + 1).alias("order"), role.alias("role"), F.substring(line, 1, 200).alias("text"))


def role_digest(roles: DataFrame) -> DataFrame:
    """Per document of ``line_roles`` (which bounds its lines): how many, and the SHA-256 of order:role:text, a line each."""
    part = F.concat_ws(":", F.col("order").cast("string"), "role", "text")
    each = roles.groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("order", part.alias("s")))).alias("p"))
    return each.select("doc_id", "n", F.sha2(F.array_join(F.transform("p", lambda x: x["s"]), "\n"), 256).alias("digest"))


def bookmarks(docs: DataFrame, most: int = BOOKMARKS) -> DataFrame:
    """doc_id, ordinal (from 1) and title of the lines like headings, ``most`` of them: those that begin with chapter, section
    or number signs, and short ones of letters, digits and blanks alone. Without any, the best sentence's first 80
    characters. A text without sentences has none."""
    X.ship_code(docs.sparkSession)
    like = rf"(?i)^(?:chapter{X.EDGES[1]}|section{X.EDGES[1]}|#{{1,6}}\s|[A-Z][A-Z0-9 ]{{0,40}}$)"
    titles = F.slice(F.filter(_lines(F.col("text")), lambda x: x.rlike(like)), 1, most)
    # Sentences are made of the texts without headings only.
    each = docs.select("doc_id", "text", titles.alias("t")).select("doc_id", "t", X.sentence_array(F.when(F.size("t") == 0, F.col("text"))).alias("s"))
    best = F.get("s", F.get("p", 0))
    found = F.when(F.size("t") > 0, F.col("t")).otherwise(F.array_compact(F.array(F.substring(best, 1, 80))))
    each = each.withColumn("p", X.summary_places(F.col("s"), 1)).select("doc_id", F.posexplode(found).alias("i", "title"))
    return each.select("doc_id", (F.col("i") + 1).alias("ordinal"), "title")


def form_values(docs: DataFrame, lines: int = FORM_LINES, most: int = FIELDS) -> DataFrame:
    """doc_id, ordinal (from 1), name and value (80 characters) of lines like ``Name: value`` or ``Name_ value``, of the first
    ``lines`` that are not blank and ``most`` in all."""
    pattern = r"^([A-Za-z][A-Za-z0-9 /_-]{1,40})\s*[:_]\s*(.*)$"
    hits = F.slice(F.filter(F.slice(_lines(F.col("text")), 1, lines), lambda x: x.rlike(pattern)), 1, most)
    each = docs.select("doc_id", F.posexplode(hits).alias("i", "line"))
    return each.select("doc_id", (F.col("i") + 1).alias("ordinal"), X.trimmed(F.regexp_extract("line", pattern, 1)).alias("name"), F.substring(F.regexp_extract("line", pattern, 2), 1, 80).alias("value"))


def label_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal (from 1) and name of the lines that are a name and a colon."""
    pattern = r"^([A-Za-z][A-Za-z0-9 /_-]{1,40})\s*:\s*$"
    each = docs.select("doc_id", F.posexplode(F.filter(_lines(F.col("text")), lambda x: x.rlike(pattern))).alias("i", "line"))
    return each.select("doc_id", (F.col("i") + 1).alias("ordinal"), X.trimmed(F.regexp_extract("line", pattern, 1)).alias("name"))


def field_types(docs: DataFrame, most: int = LABEL_LINES) -> DataFrame:
    """Fields that labels ask for: doc_id, tab_order (the line's place from 0), name, tooltip, type, required, default_value
    and top (of its box on the page), from the first ``most`` lines that are not blank. A label tells its type by what it
    speaks of: dates before texts, numbers and checkboxes; one that speaks of none is no field. A star at the end makes it
    required."""
    parts = F.filter(F.transform(F.split("text", "\r?\n", -1), X.trimmed), lambda x: x != "")
    each = docs.select("doc_id", F.posexplode(F.slice(parts, 1, most)).alias("i", "label"))
    each = each.withColumn("clean", X.trimmed(F.regexp_replace("label", "[:*]+$", ""))).filter("clean != '' AND length(clean) <= 128")
    low = F.lower("clean")
    kind = F.when(low.contains("date"), "date").when(low.rlike("email|name|address|comment|phone"), "text").when(low.rlike("amount|quantity|total|number"), "number").when(low.rlike("agree|consent|accept"), "checkbox")
    name = F.regexp_replace(F.regexp_replace("clean", "[^A-Za-z0-9._-]", "_"), "^_+|_+$", "")
    name = F.when(name == "", F.concat(F.lit("field_"), (F.col("i") + 1).cast("string"))).otherwise(name)
    out = each.select("doc_id", F.col("i").alias("tab_order"), name.alias("name"), F.col("clean").alias("tooltip"), kind.alias("type"), F.col("label").rlike(r"\*$").alias("required"), F.when(kind == "checkbox", "false").otherwise("").alias("default_value"), (714 - F.col("i") * 18).alias("top"))
    return out.filter("type IS NOT NULL")


def accessibility_cues(docs: DataFrame) -> DataFrame:
    """doc_id and cue: no word of language, no word of headings or titles, places of images."""
    t = F.col("text")
    cues = F.array(
        F.when(~t.rlike(rf"(?i){X.EDGES[0]}lang(?:uage)?{X.EDGES[1]}"), "missing-language-cue"),
        F.when(~t.rlike(rf"(?im)^#|{X.EDGES[0]}(?:heading|title){X.EDGES[1]}"), "missing-heading-cue"),
        F.when(t.rlike(r"(?i)\[image\]|\[figure\]"), "image-placeholders"),
    )
    return docs.select("doc_id", F.explode(F.array_compact(cues)).alias("cue"))


def reflow_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, order (from 1) and text (500 characters) of the parts between full stops with white space after them."""
    parts = F.filter(F.split("text", rf"\.{X.SPACES}+", -1), lambda x: x != "")
    each = docs.select("doc_id", F.posexplode(parts).alias("i", "t"))
    return each.select("doc_id", (F.col("i") + 1).alias("order"), F.substring("t", 1, 500).alias("text"))


def normalized(text: Column) -> Column:
    """``text`` composed (NFC), white space collapsed and trimmed; null is empty."""
    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return F.trim(F.regexp_replace(F.arrow_udf(compose, "string")(F.coalesce(text, F.lit(""))), X.SPACES + "+", " "))


#: What markup escapes, in the order in which it does.
MARKUP_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def markup_escaped(text: Column) -> Column:
    for plain, escape in MARKUP_ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return text


def markup_unescaped(text: Column) -> Column:
    for plain, escape in reversed(MARKUP_ESCAPES):
        text = F.replace(text, F.lit(escape), F.lit(plain))
    return text


def xml_valid(text: Column) -> Column:
    """Whether all characters are allowed in XML 1.0; null is."""
    return ~F.coalesce(text.rlike("[^\\x09\\x0a\\x0d\\x{20}-\\x{d7ff}\\x{e000}-\\x{fffd}\\x{10000}-\\x{10ffff}]"), F.lit(False))


def rtf_escaped(text: Column) -> Column:
    """``text`` for RTF: backslashes and braces escaped, line breaks as \\line, and what is not printable ASCII by its UTF-16
    units, signed."""
    def escape(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            parts = []
            for c in t:
                if c in "\\{}":
                    parts.append("\\" + c)
                elif c == "\n":
                    parts.append("\\line\n")
                elif " " <= c <= "~":
                    parts.append(c)
                else:
                    units = c.encode("utf-16-le", "surrogatepass")
                    parts += [f"\\u{int.from_bytes(units[i : i + 2], 'little', signed=True)}?" for i in range(0, len(units), 2)]
            out.append("".join(parts))
        return pa.array(out, pa.string())

    return F.arrow_udf(escape, "string")(F.coalesce(text, F.lit("")))


def snippets(matches: DataFrame, pages: DataFrame, context: int) -> DataFrame:
    """``matches`` (doc_id, page, start, end) with the text up to ``context`` characters around each, clipped to the page, and
    its place: snippet, snippet_start, snippet_end; and before and after with white space collapsed, as lists show them.
    Pages without matches are not moved further than the join."""
    each = matches.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    begin, stop = F.greatest(F.col("start") - context, F.lit(0)), F.least(F.col("end") + context, F.length("text"))
    cut = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    flat = lambda x: F.regexp_replace(x, X.SPACES + "+", " ")
    return each.select(*matches.columns, cut(begin, stop).alias("snippet"), begin.alias("snippet_start"), stop.alias("snippet_end"), F.ltrim(flat(cut(begin, F.col("start")))).alias("before"), F.rtrim(flat(cut(F.col("end"), stop))).alias("after"))


def claim_terms(claims: DataFrame) -> DataFrame:
    """claim_id, term and n, the number of its claim's terms, of ``claims`` (claim_id, claim): distinct tokens that are no stop words. A
    claim without any has no row."""
    stop = F.array(*[F.lit(w) for w in X.STOP_WORDS])
    each = claims.select("claim_id", F.array_except(F.array_distinct(X.tokens(F.col("claim"))), stop).alias("q"))
    return each.select("claim_id", F.size("q").alias("n"), F.explode("q").alias("term"))


#: As many terms of claims, those of all claims together, go to the tasks, so that sentences are scored where their text lies.
LISTED_TERMS = 200_000


def _scored(index: dict[bytes, tuple[int, ...]], each_document: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best sentence of each claim (by its number in ``index``: the claims that a term is of) among sentences in lower case: of each
    document, or of all that a task reads, of equals that of the smallest key and there the first. A task keeps a row a claim."""

    def of(sentences: list[bytes]) -> dict[int, tuple[int, int]]:
        out: dict[int, tuple[int, int]] = {}
        for i, s in enumerate(sentences):
            for k, n in Counter(chain.from_iterable(index[w] for w in X.words_of(s) if w in index)).items():
                if k not in out or n > out[k][0]:
                    out[k] = (n, i)
        return out

    def rows(found: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ([],) * 4
        kinds = (("doc_id", key), ("claim", pa.int32()), ("score", pa.int64()), ("idx", pa.int32()))
        return pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        key = None
        for batch in batches:
            key = batch.column(0).type
            for doc, sentences in zip(batch.column(0).to_pylist(), X.each_list(batch.column(1)), strict=True):
                found = of(sentences)
                if each_document and found:
                    yield rows([(doc, k, n, i) for k, (n, i) in found.items()], key)
                elif doc is not None:
                    for k, (n, i) in found.items():
                        if k not in best or n > best[k][0] or n == best[k][0] and doc < best[k][1]:
                            best[k] = (n, doc, i)
        if best:
            yield rows([(doc, k, n, i) for k, (n, doc, i) in best.items()], key)

    return run


def sentence_scores(docs: DataFrame, claims: DataFrame, each_document: bool = True) -> tuple[DataFrame, bool]:
    """doc_id, idx (the sentence, from 0), claim_id, n (the claim's terms) and score: how many tokens of the sentence are terms of the
    claim, at least one. ``doc_id`` and ``claim_id`` are keys. With it, whether rows are few: then there is only the best sentence of
    each document and claim, or, unless ``each_document``, of what a task reads and claim, and no row was shuffled.

    So it is while claims have ``LISTED_TERMS`` terms at most. Beyond it terms meet by an equi-join, however many claims there are: a
    broadcast one within the session's threshold for that, else a shuffle by term, where adaptive execution splits frequent terms."""
    X.ship_code(docs.sparkSession)
    terms = checkpointed(claim_terms(claims))
    few = terms.select("claim_id", "n", "term").limit(LISTED_TERMS + 1).collect()
    if len(few) <= LISTED_TERMS:
        number = {c: i for i, c in enumerate(dict.fromkeys(r["claim_id"] for r in few))}
        index: dict[bytes, tuple[int, ...]] = {}
        for r in few:
            index[r["term"].encode()] = (*index.get(r["term"].encode(), ()), number[r["claim_id"]])
        named = docs.sparkSession.createDataFrame(list({(number[r["claim_id"]], r["claim_id"], r["n"]) for r in few}), T.StructType([T.StructField("claim", T.IntegerType()), terms.schema["claim_id"], terms.schema["n"]]))
        lowered = docs.select("doc_id", F.transform(X.sentence_array(F.col("text")), F.lower).alias("s"))
        schema = T.StructType([docs.schema["doc_id"], T.StructField("claim", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("idx", T.IntegerType())])
        return lowered.mapInArrow(_scored(index, each_document), schema).join(F.broadcast(named), "claim").drop("claim"), True
    # Outer, as a filter on what is exploded would be inferred otherwise, and would split every text once more. No null has a partner.
    each = X.with_sentences(docs).select("doc_id", F.posexplode_outer("t").alias("idx", "t"))
    each = each.select("doc_id", "idx", F.explode_outer("t").alias("term"))
    return each.join(terms, "term").groupBy("doc_id", "idx", "claim_id").agg(F.count("*").alias("score"), F.first("n").alias("n")), False


def _quoted(best: DataFrame, docs: DataFrame, few: bool = False) -> DataFrame:
    """``best`` (doc_id, idx, score, n and more) with quote, the sentence itself, and confidence, the share of the claim's terms, 1 at
    most. Sentences are made again for documents that are quoted; ``few`` says that these can be sent to all tasks."""
    ids = best.select("doc_id").distinct()
    cited = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sentences = cited.select("doc_id", F.posexplode_outer(X.sentence_array(F.col("text"))).alias("idx", "quote"))
    kept = [c for c in best.columns if c not in ("idx", "score", "n")]
    return best.join(sentences, ["doc_id", "idx"]).select(*kept, "quote", F.least(F.lit(1.0), F.col("score") / F.col("n")).alias("confidence"))


#: As many claims are put to a text's sentences in its own row; more are joined.
IN_ROWS = 64


def _in_rows(docs: DataFrame, claims: list) -> DataFrame:
    """``citations`` of few claims (claim_id and their terms), without a shuffle and with a text split once."""
    each = [F.struct(F.lit(r["claim_id"]).alias("claim_id"), X.best_sentence(F.col("s"), F.col("t"), " ".join(r["terms"])).alias("b"), F.lit(float(len(r["terms"]))).alias("n")) for r in claims]
    best = X.with_sentences(docs).select("doc_id", F.explode_outer(F.array(*each)).alias("c")).select("doc_id", "c.*")
    return best.filter("b.score > 0").select("doc_id", "claim_id", F.col("b.s").alias("quote"), F.least(F.lit(1.0), F.col("b.score") / F.col("n")).alias("confidence"))


def citations(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """The sentence of each document that holds most of each claim (claim_id, claim: a table of any size), the first of equals: doc_id,
    claim_id, quote and confidence. A document without any term of a claim gives no row; ``unquoted`` adds these. Of
    ``IN_ROWS`` claims or less every text's row is asked; more meet the texts by a join, with the same rows."""
    X.ship_code(docs.sparkSession)
    few = claim_terms(claims).groupBy("claim_id").agg(F.collect_list("term").alias("terms")).limit(IN_ROWS + 1).collect()
    if 0 < len(few) <= IN_ROWS:
        return _in_rows(docs, few)
    scores, best_only = sentence_scores(docs, claims)
    if best_only:
        return _quoted(checkpointed(scores), docs)
    best = scores.groupBy("doc_id", "claim_id").agg(F.max(F.struct("score", -F.col("idx"), "n")).alias("b"))
    return _quoted(checkpointed(best.select("doc_id", "claim_id", (-F.col("b.col2")).alias("idx"), "b.score", "b.n")), docs)


def unquoted(docs: DataFrame, claims: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` of ``citations`` with a row for every document and claim (the result that is asked for has as many): no quote and
    confidence 0 where the document has no term of the claim."""
    each = docs.select("doc_id").join(claims.select("claim_id"), how="cross")
    return each.join(found, ["doc_id", "claim_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def best_sources(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """The sentence of all documents that holds most of each claim: claim_id, doc_id, quote and confidence; of equals the one of the
    smallest doc_id, and there the first. A claim that no document has a term of gives no row."""
    scores, few = sentence_scores(docs, claims, each_document=False)
    best = scores.groupBy("claim_id").agg(F.max(F.struct("score", -F.col("doc_id"), -F.col("idx"), "n")).alias("b"))
    return _quoted(checkpointed(best.select("claim_id", (-F.col("b.col2")).alias("doc_id"), (-F.col("b.col3")).alias("idx"), "b.score", "b.n")), docs, few)


def replaced(text: Column, find: str, by: str) -> Column:
    """Every occurrence of ``find`` replaced, left to right without overlap."""
    if not find:
        raise ValueError("nothing to find")
    return F.replace(text, F.lit(find), F.lit(by))


def regions_present(regions: DataFrame, pages: DataFrame, of: str) -> DataFrame:
    """``regions`` (of, page, region) with present, whether the page's text holds the region's, white space aside. A region
    without text, or of a page that is not there, is not present."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), X.SPACES + "+", " "))
    both = regions.join(pages.select(of, "page", "text"), [of, "page"], "left")
    r = flat(F.col("region"))
    return both.select(*regions.columns, ((r != "") & F.contains(flat(F.col("text")), r)).alias("present"))


def common_terms(docs: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` terms that most documents share, two at least: rank, term and documents; of equals the one that occurs first, by
    document and place in it."""
    X.ship_code(docs.sparkSession)
    t = X.term_frequency(docs).filter(F.length("term") > 3)
    shared = t.groupBy("term").agg(F.count("*").alias("df"), F.min(F.struct("doc_id", "first_pos")).alias("first")).filter("df >= 2")
    order = [F.desc("df"), "first", "term"]
    best = shared.orderBy(*order).limit(most)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "term", F.col("df").alias("documents"))
