"""Sensitive text: the kinds that a page is searched for, their places, and what is reported of them without the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireframe.functions.bounded import bounded_matches
from quireframe.operators import text as X
from quireframe.session import ship_code

#: Between a word character (ASCII letters, digits, underscore) and any other.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: The patterns of the kinds.
EMAIL = EDGE + X.EMAIL + EDGE
PHONE = r"(?<![A-Za-z0-9_])(?:\+?[0-9][0-9 .()\-]{6,}[0-9])(?![A-Za-z0-9_])"
CARD = r"(?<![0-9])(?:[0-9][ -]?){13,19}(?![0-9])"
SSN = X.EDGES[0] + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + X.EDGES[1]
US_PHONE = X.EDGES[0] + "[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}" + X.EDGES[1]
PHONE_DIGITS = 15
#: Matches of a report, and findings of a kind, at most.
MATCHES, FINDINGS = 500, 50


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def payment_cards(pages: DataFrame) -> DataFrame:
    """Places of numbers of 13 to 19 digits that pass the Luhn check; a separator after the last digit belongs to it."""
    return X.match_rows(pages, CARD).filter(X.luhn_valid(F.col("match")))


def bounded_rows(pages: DataFrame, expression: str) -> DataFrame:
    """doc_id, page, start and end of the matches of a bounded expression in any case."""
    ship_code(pages.sparkSession)
    return pages.select("doc_id", "page", F.explode(bounded_matches(F.col("text"), expression, ignore_case=True)).alias("m")).select("doc_id", "page", "m.start", "m.end")


def kinds(pages: DataFrame, custom: list[tuple[str, str, bool]] = ()) -> DataFrame:
    """Places of all kinds on each page: doc_id, page, start, end, kind and label, never the text. ``custom`` patterns are
    (label, pattern, whether it is an expression): literals are found as they are, expressions, which are bounded ones, in any
    case, leftmost and longest. Kinds are searched apart, so that matches of several may overlap."""
    found = [
        (X.match_rows(pages, EMAIL, needs="@"), "email", "Email"),
        (X.match_rows(pages, PHONE).filter(F.length(digits(F.col("match"))) <= PHONE_DIGITS), "phone", "Phone"),
        (payment_cards(pages), "payment-card", "Payment card"),
    ]
    for label, pattern, expression in custom:
        if expression:
            found.append((bounded_rows(pages, pattern), "custom-regex", label))
        else:
            found.append((X.match_rows(pages, X.literal_pattern(pattern, case_sensitive=True), needs=pattern), "custom-literal", label))
    return reduce(DataFrame.unionByName, [m.select("doc_id", "page", "start", "end", F.lit(kind).alias("kind"), F.lit(label).alias("label")) for m, kind, label in found])


def report(found: DataFrame, most: int = MATCHES) -> DataFrame:
    """``kinds`` as a report per document: matches in order of page, start and end are numbered match-1, match-2 and so on;
    the first ``most`` are listed, and truncated tells whether so many were found."""
    of = Window.partitionBy("doc_id")
    each = found.withColumns({"_n": F.row_number().over(of.orderBy("page", "start", "end", "kind", "label")), "_all": F.count("*").over(of)})
    return each.filter(F.col("_n") <= most).select("doc_id", F.concat(F.lit("match-"), F.col("_n").cast("string")).alias("id"), "page", "start", "end", "kind", "label", (F.col("_all") >= most).alias("truncated"))


def findings(docs: DataFrame, most: int = FINDINGS) -> DataFrame:
    """What a text holds of e-mail addresses, social security and telephone numbers: doc_id, label, ordinal (from 1 in its
    label), hash (16 digits of SHA-256) and length; ``most`` of each label."""
    each = [docs.select("doc_id", F.lit(label).alias("label"), F.posexplode(F.slice(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), 1, most)).alias("i", "value")) for label, pattern in (("email", X.EMAIL), ("ssn", SSN), ("phone", US_PHONE))]
    return reduce(DataFrame.unionByName, each).select("doc_id", "label", (F.col("i") + 1).alias("ordinal"), F.substring(F.sha2("value", 256), 1, 16).alias("hash"), F.length("value").alias("length"))
