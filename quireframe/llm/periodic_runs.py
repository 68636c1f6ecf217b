"""Runs of a text's words that repeat with a period (operator 13).

A run is a stretch of words with smallest period q and a length of at least max(6, 4 q) that cannot grow. At the scale of
B = 2^k with B <= q < 2 B, every run holds a whole block of B words that starts at a multiple of B, and the block recurs q words
later. So at each scale the text's aligned blocks are keys of an automaton over word numbers (or over numbers of stretches of
words, where blocks are long), the text is searched for them, and each occurrence at a distance of B to 2 B - 1 after its block
is a seed that is compared word by word to both sides.
Nothing is shuffled: a text is searched where it lies, long ones a window at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.shared import WORD
from quireframe.session import ship_code

#: The least length of a run, and the least number of its periods.
LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words whose blocks are keys of one automaton; blocks of a quarter of it or more have windows of four blocks.
WINDOW = 1 << 16
#: Blocks of more words are keys of so many stretches of words, so that a step of the search follows so many links at most.
KEY_LENGTH = 16

_word = re.compile(WORD)


def numbered(words: list[str]) -> np.ndarray:
    """Each word's number; equal words have equal ones."""
    number: dict[str, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))


def _agreeing(w: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many words from ``at`` on, by ``step`` of 1 or -1, equal those ``distance`` later."""
    n, size = 0, 16
    while True:
        room = at + 1 if step < 0 else len(w) - distance - at
        size = min(size, room)
        if size <= 0:
            return n
        low = at - size + 1 if step < 0 else at
        differ = np.flatnonzero((w[low : low + size] != w[low + distance : low + distance + size])[::step])
        if len(differ):
            return n + int(differ[0])
        n, at, size = n + size, at + step * size, size * 4


def _gaps(w: np.ndarray) -> np.ndarray:
    """For each word, how much later it is met next; more than all words if never."""
    order = np.argsort(w, kind="stable")
    same = np.flatnonzero(w[order[1:]] == w[order[:-1]])
    gaps = np.full(len(w), len(w) + 1)
    gaps[order[same]] = order[same + 1] - order[same]
    return gaps


def _paired(names: np.ndarray, length: int) -> np.ndarray:
    """From the names of stretches of ``length`` words at every place, those of stretches of twice that; equal ones are equal."""
    left, right = names[:-length].astype(np.int64), names[length:]
    return np.unique(left * (int(names.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _seeds(names: np.ndarray, part: int, starts: np.ndarray, block: int, window: int) -> Iterator[tuple[int, int]]:
    """(start, distance to an occurrence one to two blocks later) for the aligned blocks at ``starts``.

    ``names`` tells the stretches of ``part`` words at every place. A block is a key of block / part names, and the text is
    searched once for each place that a stretch can begin at."""
    span = max(window, 4 * block) // block * block
    for first in np.unique(starts // span) * span:
        here = starts[(starts >= first) & (starts < first + span)]
        base, end = int(here[0]), int(here[-1]) + 3 * block
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        of_key: dict[tuple[int, ...], list[int]] = {}
        for s in here.tolist():
            of_key.setdefault(tuple(names[s : s + block : part].tolist()), []).append(s)
        for k, key in enumerate(of_key):
            automaton.add_word(key, k)
        automaton.make_automaton()
        found: list[list[int]] = [[] for _ in of_key]
        for offset in range(part):
            begin = base + offset - block + part
            for last, k in automaton.iter(tuple(names[base + offset : end : part].tolist())):
                found[k].append(begin + last * part)
        for k, own in enumerate(of_key.values()):
            at, own = np.sort(found[k]), np.array(own)
            low, high = np.searchsorted(at, own + block), np.searchsorted(at, own + 2 * block)
            for x in np.flatnonzero(low < high).tolist():
                s = int(own[x])
                for place in at[low[x] : high[x]].tolist():
                    yield s, place - s


def runs_of(w: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``w``, by start, then period."""
    n = len(w)
    if n < LEAST_LENGTH:
        return []
    # A run has each of its words four times at least, and all of its words side by side.
    usable = np.bincount(w)[w] >= LEAST_PERIODS
    edges = np.flatnonzero(np.diff(np.concatenate(([0], usable.view(np.int8), [0]))))
    begins, ends = edges[::2], edges[1::2]
    longest = int((ends - begins).max(initial=0))
    if longest < LEAST_LENGTH:
        return []
    for b, e in zip(begins[ends - begins < LEAST_LENGTH], ends[ends - begins < LEAST_LENGTH], strict=True):
        usable[b:e] = False
    gaps = _gaps(w)
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(n, np.int64)  # the farthest end of a run of a smaller scale that holds the word
    block, names, part = 1, w, 1
    while LEAST_PERIODS * block <= longest:
        last: dict[int, int] = {}  # end of the last stretch compared, by period
        new = []
        # By period within a scale, as a stretch's smallest period is met first.
        # The first block of a run is followed by itself, so each of its words comes again within two blocks. What follows in a
        # known run for two blocks has no further period.
        recurs = (usable & (gaps < 2 * block))[: n // block * block].reshape(-1, block).all(axis=1)
        starts = np.flatnonzero(recurs) * block
        starts = starts[reach[starts] < np.minimum(starts + 3 * block - 1, n)]
        while part * KEY_LENGTH < block and len(starts):
            names, part = _paired(names, part), 2 * part
        for s, q in sorted(_seeds(names, part, starts, block, window), key=lambda x: (x[1], x[0])):
            # Within a run of a smaller period, that period divides this one, and so does it for all the stretch.
            if reach[s] >= s + q + block or last.get(q, 0) >= s + q + block:
                continue
            start = s - _agreeing(w, s - 1, q, -1)
            end = s + block + _agreeing(w, s + block, q, 1) + q
            last[q] = end
            if end - start >= max(LEAST_LENGTH, LEAST_PERIODS * q) and (start, end) not in found:
                found[start, end] = q
                new.append((start, end))
        for start, end in new:
            np.maximum(reach[start:end], end, out=reach[start:end])
        block *= 2
    return sorted((start, end - start, q) for (start, end), q in found.items())


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by a space."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return " ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def document_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words (long), runs (array of start, length, period, by start, then period) and collapsed (string: the words
    without repeats of a run, joined by a space) of every row, over whole texts.

    Null and empty texts and those without words have no words, no runs and an empty collapsed text; rows that repeat or
    have a null key keep a row each; an empty table gives no rows. ``window`` bounds the memory of a search and changes no
    result. No shuffle."""
    ship_code(docs.sparkSession)
    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    of_key = rows.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                counts, runs, texts = [], [], []
                for t in some.column("text"):
                    words = _word.findall(t.as_py() or "")
                    r = runs_of(numbered(words), window)
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in r])
                    texts.append(collapsed(words, r))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(search, f"doc_id {of_key}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text) where one text in ten gets a tail that repeats: with h = crc32 of the key's decimal digits and
    g = h div 10, where h is divisible by 10, word i of n from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) div (3 + g % 8). A null key or a text without words stays."""
    words = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text")).withColumn("_h", F.crc32(F.col("doc_id").cast("string")))
    n, g = F.size("_w"), F.expr("_h div 10")
    repeated = F.array_join(F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", (F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int")))), " ")
    cut = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_g", g)
    cut = cut.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + _g % 8)"))
    return cut.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def digest_runs(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equals the first, then of the smallest period; nulls without one) and digests of all
    runs and of the collapsed text, of ``document_runs``."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("_best", F.when(F.size("runs") > 0, longest))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.b").alias("start"),
        (-F.col("_best.a")).alias("length"),
        F.col("_best.c").alias("period"),
        F.expr("1000 * -_best.a div _best.c").cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
