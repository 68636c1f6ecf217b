"""Text operators over pages: search, patterns, terms, summaries and extraction. Column expressions, but for the counts of
a text's terms, which an Arrow function takes where the text lies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.session import ship_code

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same matches, looked for where a name can begin only: at its first character, or where the match before it ends.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))" + EMAIL.replace("+@", "++@")
#: White space of any script, and what no word character (ASCII letters, digits, underscore) lies before or after.
SPACES = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SPACES = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
EDGES = (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])")
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: White space may follow the dollar sign, commas part groups of three.
AMOUNT = r"\$" + SPACES + r"?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?"
#: Words that carry no topic, and a glossary.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "is", "are", "was", "were", "be", "as", "by", "with", "that", "this", "it", "from", "at")
GLOSSARY = {"document": "documento", "page": "página", "form": "formulario", "signature": "firma", "review": "revisión", "accessibility": "accesibilidad", "redaction": "redacción", "print": "impresión", "measurement": "medición", "project": "proyecto", "summary": "resumen", "contract": "contrato", "value": "valor", "safety": "seguridad", "valve": "válvula"}
#: Values of a kind that an extraction lists at most.
LISTED = 50


def pages_of(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n") -> DataFrame:
    """doc_id, page (from 1) and text of the parts between separators."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), separator, -1)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


def trimmed(text: Column) -> Column:
    """``text`` without white space of any script at its ends."""
    return F.btrim(text, F.lit(_SPACES))


def _starts(gaps: Column, lengths: Column) -> Column:
    """Where matches start (from 0), by the lengths of what lies before each since the last one, and their own: running sums."""

    def run(gaps: pa.Array, lengths: pa.Array) -> pa.Array:
        own = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        passed = np.concatenate([[0], np.cumsum(gaps.flatten().to_numpy(zero_copy_only=False) + own)])
        n = np.array([len(x) if x.is_valid else 0 for x in lengths], np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        starts = passed[1:] - own - np.repeat(passed[ends[:-1]], n)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(starts, pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(gaps, lengths)


def match_rows(pages: DataFrame, pattern: str, needs: str | None = None) -> DataFrame:
    """A row per match of a pattern that cannot be empty, left to right without overlap: doc_id, page, match number on the page, start,
    end (from 0) and the matching text. ``needs`` is what every match holds.

    The gaps between matches come from a split by the same pattern; a start is the sum of all that lies before."""
    ship_code(pages.sparkSession)
    able = pages if needs is None else pages.filter(F.contains("text", F.lit(needs)))
    hit = able.filter(F.col("text").rlike(pattern))  # so that gaps are made only where there is a match
    each = hit.select("doc_id", "page", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("f"), F.transform(F.split("text", pattern, -1), F.length).alias("g"))
    each = each.select("doc_id", "page", "f", F.slice("g", 1, F.size("f")).alias("g"), F.transform("f", F.length).alias("n"))
    each = each.withColumn("s", _starts(F.col("g"), F.col("n")))
    # Outer, though each has a match, as the length of what is exploded would be tested below, and starts be made a second time.
    each = each.select("doc_id", "page", F.posexplode_outer(F.arrays_zip(F.col("s").alias("start"), F.col("n").alias("length"), F.col("f").alias("match"))).alias("i", "m"))
    return each.select("doc_id", "page", (F.col("i") + 1).alias("match_no"), F.col("m.start").alias("start"), (F.col("m.start") + F.col("m.length")).alias("end"), F.col("m.match").alias("match"))


def literal_pattern(needle: str, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """A Java pattern for a literal; whole words are bounded by anything but letters, digits and underscore."""
    body = re.escape(needle)
    if whole_word:
        body = rf"(?<![\p{{L}}\p{{N}}_]){body}(?![\p{{L}}\p{{N}}_])"
    return body if case_sensitive else f"(?iu){body}"


def wildcard_pattern(query: str, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """``*`` stands for the fewest of up to 256 characters, ``?`` for one. A whole word is looked for after the shortest
    match is fixed, hence the atomic group. A query without any literal character is refused."""
    collapsed = re.sub(r"\*+", "*", query)
    if not re.search(r"[^*?]", collapsed):
        raise ValueError("a wildcard query needs a literal character")
    body = "".join(".{0,256}?" if c == "*" else "." if c == "?" else re.escape(c) for c in collapsed)
    if whole_word:
        body = rf"(?<![\p{{L}}\p{{N}}_])(?>{body})(?![\p{{L}}\p{{N}}_])"
    return ("(?s)" if case_sensitive else "(?isu)") + body


def luhn_valid(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check, which is what tells a payment card from other numbers."""
    d = F.regexp_replace(digits, "[^0-9]", "")
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def tokens(text: Column) -> Column:
    """Lower-cased ASCII terms; every other character but dot and hyphen separates."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s.-]", " "), r"\s+"), "")


_TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("first_pos", T.IntegerType())]))


#: What separates terms, and white space, as blanks; other bytes of UTF-8 as they are.
_BLANKED = bytes(i if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789.-" else 32 for i in range(256))


def words_of(lowered: bytes) -> list[bytes]:
    """``tokens`` of a text that is in lower case already, within a task."""
    return lowered.translate(_BLANKED).split()


def each_list(lists: pa.ListArray) -> Iterator[list[bytes]]:
    """The texts of each list in UTF-8, of a null none, a list at a time, so that a batch is not held as Python objects."""
    for x in lists:
        yield x.values.cast(pa.large_binary()).to_pylist() if x.is_valid else []


#: Bytes of text, about, that are parted into tokens at a time.
COUNTED_BYTES = 1 << 20


class Tokens(NamedTuple):
    """The tokens of texts, one after another: the text that each is of and its number in ``words``, the distinct ones; ``stop`` and
    ``short`` tell of each of these whether it is a stop word, or has fewer than three letters."""

    text: np.ndarray
    number: np.ndarray
    words: pa.Array
    stop: np.ndarray
    short: np.ndarray


def _tokens_in(lowered: pa.Array) -> Tokens:
    """The ``tokens`` of texts in lower case, within a task. No token is a Python object."""
    texts = lowered.fill_null("").cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    plain = data[ends[0] : ends[-1]].to_pybytes().translate(_BLANKED) if data is not None else b""
    raw = np.frombuffer(plain, np.uint8)
    part = raw != 32
    begins = part.copy()
    begins[1:] &= ~part[:-1]
    edges = ends[:-1][np.diff(ends) > 0] - ends[0]  # a text begins a token, whatever the one before it ends with
    begins[edges] = part[edges]
    at = np.flatnonzero(begins)
    own = np.cumsum(part, dtype=np.int32)[at] - 1 if len(at) else at
    starts = np.append(own, np.count_nonzero(part)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(raw[part])]).dictionary_encode()
    words = found.dictionary
    stop = pc.is_in(words, pa.array([w.encode() for w in STOP_WORDS], pa.binary())).to_numpy(zero_copy_only=False)
    text = np.searchsorted(ends - ends[0], at, "right") - 1
    return Tokens(text, found.indices.to_numpy(), words, stop, pc.binary_length(words).to_numpy(zero_copy_only=False) < 3)


def _shares(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``COUNTED_BYTES``, about, whose bytes are given: one at least."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // COUNTED_BYTES)) + 1
    yield from pairwise([0, *cuts.tolist(), len(sizes)])


def _counted_terms(texts: pa.Array, most: int | None) -> tuple[np.ndarray, pa.StructArray]:
    """How many terms each of these texts in lower case has, and ``term_counts`` of all, one after another."""
    t = _tokens_in(texts)
    met = pa.array(t.text * len(t.words) + t.number).dictionary_encode()  # so that terms are in order of occurrence
    number = met.indices.to_numpy()
    text, word = np.divmod(met.dictionary.to_numpy(), max(len(t.words), 1))
    first = np.empty(len(text), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    tf = np.bincount(number, minlength=len(text))
    begins = np.searchsorted(t.text, np.arange(len(texts)))
    kept = np.flatnonzero(~(t.stop | t.short)[word])
    if most is not None:
        order = kept[np.lexsort((-tf[kept], text[kept]))]
        kept = order[np.arange(len(order)) - np.searchsorted(text[order], text[order]) < most]
    rows = [t.words.take(pa.array(word[kept])).cast(pa.string()), pa.array(tf[kept], pa.int64()), pa.array(first[kept] - begins[text[kept]], pa.int32())]
    return np.bincount(text[kept], minlength=len(texts)), pa.StructArray.from_arrays(rows, ["term", "tf", "first_pos"])


def _counted(texts: pa.Array, most: int | None) -> pa.ListArray:
    """``term_counts`` of texts in lower case."""
    done = [_counted_terms(texts[a:b], most) for a, b in _text_shares(texts)]
    ends = np.cumsum(np.concatenate([[0], *[n for n, _ in done]]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([rows for _, rows in done]))


def _text_shares(texts: pa.Array) -> Iterator[tuple[int, int]]:
    return _shares(pc.binary_length(texts).fill_null(0).to_numpy())


def term_counts(text: Column, most: int | None = None) -> Column:
    """A text's terms of three letters or more that are no stop words: array of term, tf and first_pos (among all its
    tokens), in order of occurrence, or the ``most`` frequent, of equals the first. A text is counted where it lies: its terms
    dealt out are several times its size."""

    def count(texts: pa.Array) -> pa.Array:
        return _counted(texts, most)

    return F.arrow_udf(count, _TERMS)(F.lower(text))


def term_frequency(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf and first_pos of each document's terms; no shuffle. Of a batch of texts, Python holds the terms of
    ``COUNTED_BYTES`` at a time."""
    ship_code(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *_TERMS.elementType.fields])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text_shares(batch.column(1)):
                n, rows = _counted_terms(batch.column(1)[a:b], None)
                ids = batch.column(0)[a:b].take(pa.array(np.repeat(np.arange(b - a), n)))
                yield pa.RecordBatch.from_arrays([ids, *rows.flatten()], names=schema.names)

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(counted, schema)


def document_frequency(docs: DataFrame, least: int = 2) -> DataFrame:
    """Terms of more than three letters that ``least`` documents have, and how many do."""
    t = term_frequency(docs).filter(F.length("term") > 3)
    return t.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)


def ranked_terms(text: Column, n: int) -> Column:
    """The ``n`` most frequent terms of a text, ties by first occurrence: array of term and tf."""
    return F.transform(term_counts(text, n), lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("tf")))


def top_terms(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, rank (from 1), term and tf of each document's ``n`` most frequent terms."""
    ship_code(docs.sparkSession)
    each = docs.select("doc_id", F.posexplode(ranked_terms(F.col("text"), n)).alias("i", "t"))
    return each.select("doc_id", (F.col("i") + 1).alias("rank"), "t.term", "t.tf")


def sentence_array(text: Column) -> Column:
    """The sentences of a text, trimmed; a sentence ends at white space after a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(text, f"(?<=[.!?]){SPACES}+", -1), trimmed), lambda s: s != "")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, idx (from 0) and sentence."""
    return docs.select("doc_id", F.posexplode(sentence_array(F.col("text"))).alias("idx", "sentence"))


def _best_sentences(sents: pa.Array, doc: np.ndarray, n: int) -> np.ndarray:
    """Places among ``sents``, rising, of the ``n`` of each document (the number in ``doc``, rising) whose terms are met in it most often on
    average, with nine places."""
    t = _tokens_in(sents)
    kept = ~t.stop[t.number]
    sent, number = t.text[kept], t.number[kept]
    term = pa.array(doc[sent] * len(t.words) + number).dictionary_encode().indices.to_numpy()
    often = np.where(t.short[number], 0, np.bincount(term)[term]) if len(term) else term
    score = np.rint(np.bincount(sent, often, len(sents)) / np.maximum(np.bincount(sent, minlength=len(sents)), 1) * 1e9)
    order = np.lexsort((-score, doc))
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc[order])
    return np.sort(order[rank < n])


def summary_places(parts: Column, n: int) -> Column:
    """Places (from 0, rising) of the ``n`` sentences, of ``parts``, whose terms are most frequent in all of them on average, the
    first of equals. Stop words do not count; terms of fewer than three letters count as never occurring."""

    def pick(parts: pa.Array) -> pa.Array:
        counts = pc.list_value_length(parts).fill_null(0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(counts)])
        sents = parts.flatten()
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(sents).to_numpy())])[ends]
        best = [_best_sentences(sents[ends[a] : ends[b]], np.repeat(np.arange(b - a), counts[a:b]), n) + ends[a] for a, b in _shares(np.diff(sizes))]
        places = np.concatenate(best) - np.repeat(ends[:-1], np.minimum(counts, n))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(counts, n))]), pa.int32()), pa.array(places, pa.int32()))

    return F.arrow_udf(pick, T.ArrayType(T.IntegerType()))(F.transform(parts, F.lower))


def summary(docs: DataFrame, n: int) -> DataFrame:
    """The ``n`` best sentences of each document in their order: doc_id, idx, sentence. No shuffle."""
    ship_code(docs.sparkSession)
    each = docs.select("doc_id", sentence_array(F.col("text")).alias("s")).withColumn("p", summary_places(F.col("s"), n))
    # An inner explode would have the optimizer test the length of p, and so make all sentences, a second time below.
    rows = each.select("doc_id", "s", F.explode_outer("p").alias("idx")).filter("idx IS NOT NULL")
    return rows.select("doc_id", "idx", F.get("s", F.col("idx")).alias("sentence"))


def question_terms(question: str) -> list[str]:
    """The terms that a question asks for: its distinct tokens that are no stop words. A question without any is refused."""
    found = [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9\s.-]", " ", question.lower())) if t and t not in STOP_WORDS]
    if not found:
        raise ValueError("the question has no terms")
    return list(dict.fromkeys(found))


def best_sentence(parts: Column, terms: Column, question: str) -> Column:
    """score, less (the place, negated) and s of the sentence of ``parts`` in which most tokens (``terms``: those of each) are
    terms of the question, the first of equals."""
    q = question_terms(question)
    # Zipped before, as what a lambda refers to from outside could be made anew for each sentence.
    both = F.arrays_zip(parts.alias("s"), terms.alias("t"))
    return F.array_max(F.transform(both, lambda x, i: F.struct(F.size(F.filter(x["t"], lambda t: t.isin(*q))).alias("score"), (-i).alias("less"), x["s"].alias("s"))))


def answer_of(best: Column, question: str) -> Column:
    """The sentence that ``best_sentence`` gives and the confidence: the share of the question's terms, 1 at most. Without a
    sentence that has a term: null and 0."""
    hit = F.coalesce(best["score"] > 0, F.lit(False))
    n = float(len(question_terms(question)))
    return F.struct(F.when(hit, best["s"]).alias("answer"), F.when(hit, F.least(F.lit(1.0), best["score"] / F.lit(n))).otherwise(0.0).alias("confidence"))


def with_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, s (sentences) and t (the tokens of each), columns of their own, so that a text is split once whatever is asked."""
    return docs.select("doc_id", sentence_array(F.col("text")).alias("s")).withColumn("t", F.transform("s", tokens))


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many tokens of a text are one of ``terms``, of which none is empty; the text's other tokens are not made."""
    begin = "".join(sorted({re.escape(t[0]) for t in terms}))
    pattern = f"(?=[{begin}])(?<![a-z0-9.-])(?:{'|'.join(map(re.escape, terms))})(?![a-z0-9.-])"
    return F.regexp_count(F.lower(text), F.lit(pattern))


def ask(docs: DataFrame, question: str) -> DataFrame:
    """doc_id, answer and confidence: a row for every document."""
    q = question_terms(question)
    parts = docs.select("doc_id", sentence_array(F.col("text")).alias("s"))
    best = parts.select("doc_id", F.array_max(F.transform("s", lambda s, i: F.struct(term_hits(s, q).alias("score"), (-i).alias("less"), s.alias("s")))).alias("b"))
    return best.select("doc_id", answer_of(F.col("b"), question).alias("a")).select("doc_id", "a.*")


def distinct_values(text: Column, pattern: str, most: int = LISTED) -> Column:
    """The first ``most`` distinct matches of a pattern, in order of occurrence."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, most)


def extracted(docs: DataFrame) -> DataFrame:
    """The first distinct e-mail addresses, dates and amounts of each document, joined by bars in order of occurrence, and
    its 20 most frequent terms with their counts (term:count). No list holds a bar otherwise."""
    ship_code(docs.sparkSession)
    get = lambda p, text=F.col("text"): F.array_join(distinct_values(text, p), "|")
    holds = lambda c: F.when(F.contains("text", F.lit(c)), F.col("text")).otherwise(F.when(F.col("text").isNotNull(), ""))
    keywords = F.array_join(F.transform(ranked_terms(F.col("text"), 20), lambda t: F.concat(t["term"], F.lit(":"), t["tf"].cast("string"))), "|")
    return docs.select("doc_id", get(_EMAIL, holds("@")).alias("emails"), get("(?=[0-9])" + EDGES[0] + DATE + EDGES[1]).alias("dates"), get(AMOUNT, holds("$")).alias("amounts"), keywords.alias("keywords"))


def translated(text: Column) -> Column:
    """The tokens of a text, those of the glossary translated, joined by spaces."""
    words = F.create_map(*[F.lit(x) for kv in GLOSSARY.items() for x in kv])
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(F.try_element_at(words, t), t)), " ")


def proofread(text: Column) -> Column:
    """White space collapsed, none before punctuation, and a lone i in upper case. Texts of any language are taken: an i
    is alone if no ASCII letter, digit or underscore is beside it."""
    one = F.regexp_replace(F.regexp_replace(text, SPACES + "+", " "), " ([,.!?;:])", "$1")
    return F.trim(F.regexp_replace(one, "i".join(EDGES), "I"))


#: A word: letters, marks and digits, with apostrophes inside.
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"


def unknown_words(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, word and how often, of folded words that ``dictionary`` (word) has not. The join is an anti-join on the
    word after counting, so that a frequent word is one row a document."""
    w = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    return w.groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(dictionary, "word", "left_anti").select("doc_id", "word", "n")


def spelling_findings(pages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """A row per word of a page that ``dictionary`` (word, folded) has not: doc_id, page, offset (from 0), length and the
    word's SHA-256. Frequent words of the dictionary are the smaller side of the anti-join."""
    found = match_rows(pages, WORD).withColumn("word", F.lower("match")).join(dictionary.select("word").distinct(), "word", "left_anti")
    return found.select("doc_id", "page", F.col("start").alias("offset"), F.length("match").alias("length"), F.sha2("match", 256).alias("digest"))


#: The tags of markup that go, become a line break or become a tab, in turn, and the entities that are read.
MARKUP = (
    (r"(?i)</?(?:html|head|body|title)\b[^>]*>", ""),
    (r"(?i)<(?:text:|w:)?(?:p|h|tr|br|cr)\b[^>]*>", "\n"),
    (r"(?i)<(?:text:)?(?:tab|s)\b[^>]*/?>(?:</[^>]+>)?", "\t"),
    (r"<[^>]*>", ""),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Text of markup: what opens a paragraph, heading, row or line becomes a line break, tabs tabs, other tags go, five
    entities are read, carriage returns and blanks that begin a line go, and three or more line breaks become two."""
    for pattern, plain in MARKUP:
        html = F.regexp_replace(html, pattern, plain)
    for entity, plain in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(plain))
    html = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "\r", ""), r"\n[\t ]+", "\n"), r"\n{3,}", "\n\n")
    return trimmed(html)


def spreadsheet_safe(cell: Column) -> Column:
    """A cell that a spreadsheet could take for a formula gets an apostrophe in front."""
    return F.when(cell.rlike(r"^(?:[\t\r\n]|\s*[=+\-@])"), F.concat(F.lit("'"), cell)).otherwise(cell)


def export_text(pages: DataFrame) -> DataFrame:
    """One text per document: each page, without white space at its end, under a heading with its number."""
    part = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.regexp_replace("text", SPACES + "+$", ""))
    each = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", part.alias("part")))).alias("p"))
    return each.select("doc_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("export"))
