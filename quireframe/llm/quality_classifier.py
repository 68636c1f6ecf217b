"""Compression classifier for text quality (operator 8).

One zstandard dictionary is built from good and one from bad labelled text. A text compresses better with the dictionary
of its own kind: the difference of its two compressed sizes over their sum, with the compressed share of the text's own
size (which is what gives pure repetition away), is turned into a probability by logistic regression on labelled rows
that built no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.session import ship_code

#: Bounds of the sample that the model is fitted on, drawn by a hash of the key: labelled rows of each class, how many
#: of them go into its dictionary at most, and the bytes of a text that are sampled at most. Scoring has no such bound.
SAMPLE_ROWS = 3_000
DICTIONARY_ROWS = 1_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Texts are compressed in pieces of so many bytes, so that a long text does not become its own dictionary.
PIECE = 2_048
FOLDS, HELD_OUT = 3, 1
SEED = 80_021


class Model(NamedTuple):
    """All that scoring needs: two dictionaries and the logistic regression. Without dictionaries the score is the
    share of good labels."""

    good: bytes
    bad: bytes
    center: list[float]
    scale: list[float]
    weights: list[float]
    share: float


def held_out(key: Column) -> Column:
    """Whether a row's label is kept from training: crc32 of the key as text, modulo 3, is 1; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to learn from: the text itself serves
        return b"\n".join(pieces)[:DICTIONARY_BYTES]


def _compressors(*dictionaries: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))
    return out


def _features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> list[float]:
    pieces = _pieces(text)
    g, b = (sum(len(c.compress(p)) for p in pieces) for c in (good, bad))
    d, r = (b - g) / (b + g), float(np.log(g / (len(text) + 8)))
    return [d, d * abs(d), r, r * r]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _regress(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(40):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model of the labelled rows outside the held-out fold: ``SAMPLE_ROWS`` of each class at most, and of each text
    one part of ``SAMPLE_BYTES`` bytes at most, at a place that a hash of the key picks.

    The labels are sampled first and joined to the texts after, so that texts that are no sample are not moved. Null
    texts, null keys and labels other than 0 and 1 are no sample. Of rows that repeat a key one is, that of the smallest
    part, and of labels that repeat a key one of each kind: else tables that hold rows many times over would give all pairs
    of them, and a sample of a few texts. With fewer than two usable rows of a class the model is the share of good labels
    (a half without labels).
    """
    known = labels.select(labels[f"`{key}`"].alias("k"), labels[f"`{label}`"].alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull())
    known = known.filter(~held_out(F.col("k")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    order = F.xxhash64("k", F.lit(SEED))
    drawn = [known.filter(F.col("y") == y).distinct().orderBy(order, "k").limit(SAMPLE_ROWS) for y in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # SAMPLE_ROWS rows of each class at most
    t = docs.select(docs[f"`{key}`"].alias("k"), F.encode(docs[f"`{text}`"], "UTF-8").alias("t")).filter("t IS NOT NULL")
    begin = F.pmod(F.xxhash64("k", F.lit(SEED + 1)), F.greatest(F.octet_length("t") - SAMPLE_BYTES + 1, F.lit(1))) + 1
    parts = t.join(drawn, "k").select("k", "y", F.substring("t", begin.cast("int"), F.lit(SAMPLE_BYTES)).alias("t"))
    parts = parts.groupBy("k", "y").agg(F.min("t").alias("t"))
    rows = parts.select("y", "t", order.alias("o"), "k").orderBy("o", "k").limit(2 * SAMPLE_ROWS).collect()  # there are no more
    of = [[bytes(r["t"]) for r in rows if r["y"] == y] for y in (0, 1)]
    if min(map(len, of)) < 2:
        return Model(b"", b"", [], [], [], share)
    cut = [min(DICTIONARY_ROWS, len(x) // 2) for x in of]
    bad, good = (_dictionary(x[:n]) for x, n in zip(of, cut, strict=True))
    by = _compressors(good, bad)
    x = np.array([_features(s, *by) for y in (0, 1) for s in of[y][cut[y] :]])
    n = [len(of[y]) - cut[y] for y in (0, 1)]
    y = np.repeat([0.0, 1.0], n)
    w = np.repeat([counts[y] / sum(counts.values()) / n[y] * sum(n) for y in (0, 1)], n)
    center, scale = x.mean(0), x.std(0) + 1e-9
    return Model(good, bad, center.tolist(), scale.tolist(), _regress((x - center) / scale, y, w).tolist(), share)


def score(text: Column, model: Model) -> Column:
    """The chance that a text is good, 0 to 1; a null text counts as empty, an empty one has a score too."""

    @F.pandas_udf(T.DoubleType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by = _compressors(model.good, model.bad) if model.weights else None
        beta = np.array(model.weights)
        for batch in texts:
            if by is None or not len(batch):
                yield pd.Series(np.full(len(batch), model.share))
                continue
            x = np.array([_features(t.encode("utf-8", "surrogatepass"), *by) for t in batch])
            yield pd.Series(_sigmoid(beta[0] + ((x - model.center) / model.scale) @ beta[1:]))

    return of(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, held_out, score and predicted (1 from a score of 0.5). No shuffle of texts.

    A null text counts as empty and has a score; rows that repeat have the same; a null key is not held out. An empty
    table gives no rows.
    """
    ship_code(docs.sparkSession)
    k = docs[f"`{key}`"]
    scored = docs.select(k.alias("doc_id"), held_out(k).alias("held_out"), score(docs[f"`{text}`"], fit(docs, labels, key, text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_documents(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, with the columns of ``docs``."""
    ship_code(docs.sparkSession)
    return docs.filter(score(docs[f"`{text}`"], model) >= least)
