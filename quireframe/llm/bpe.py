"""Token counts by byte-pair merging with a heap over a linked list (operator 9).

A word's count is the number of its bytes less the number of merges; no identifiers are made. Words recur, so each
Python worker keeps the results of the short words it has met, up to a bound; long ones, which do not, are counted anew.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.llm.shared import n_bytes
from quireframe.session import ship_code

#: How byte-level vocabularies of this family cut a text into words before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words of a cache before it starts anew, and the characters of the longest that it keeps: at four bytes a character and
#: what an entry takes, 200 MB of a worker at most, and 60 MB where words are of usual length.
CACHED_WORDS = 400_000
CACHED_CHARS = 64
TOKEN_LIMIT = 512

_any_split = regex.compile(SPLIT)
# The standard library's classes agree with the pattern on these characters, and are faster.
_latin_split = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_not_latin = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")


def split_words(text: str) -> list[str]:
    return (_any_split if _not_latin.search(text) else _latin_split).findall(text)


class Vocabulary:
    """What a tokenizer file says: merges, the bytes' symbols and the added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.bytes = [number(c) for c in _byte_symbols()]
        self.rank_of: dict[tuple[int, int], int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(said["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.append((number(a), number(b), number(a + b)))
            self.rank_of.setdefault(self.pairs[-1][:2], rank)
        order = [said["model"]["vocab"].get(a + b) for a, b in (p.split(" ") if isinstance(p, str) else p for p in said["model"]["merges"])]
        level = (said.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not said.get("normalizer")
        self.ids_follow_merges = level and None not in order and all(x < y for x, y in zip(order, order[1:]))  # noqa: B905
        symbols = {c: b for b, c in enumerate(_byte_symbols())}
        added = {t["content"] for t in said["added_tokens"]}
        self.token_bytes = {bytes(symbols[c] for c in k): v for k, v in said["model"]["vocab"].items() if k not in added} if level else {}
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.added_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def parts(self, text: str) -> list[str]:
        """The text cut at added tokens; these are the items at odd places."""
        return self.added_split.split(text) if self.added_split and any(t in text for t in self.added) else [text]


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return out


def merged_length(word: bytes, vocabulary: Vocabulary) -> int:
    """Tokens of one word: pop the adjacent pair of lowest rank (leftmost of equals) until none is left."""
    rank_of, pairs = vocabulary.rank_of, vocabulary.pairs
    symbol = list(map(vocabulary.bytes.__getitem__, word))
    n = len(symbol)
    # A heap item holds rank and place in one number; the rank tells the pair.
    heap = [r << 32 | i for i, pair in enumerate(zip(symbol, symbol[1:])) if (r := rank_of.get(pair, -1)) >= 0]  # noqa: B905
    if not heap:
        return n
    heapq.heapify(heap)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    count = n
    while heap:
        item = heapq.heappop(heap)
        i = item & 0xFFFFFFFF
        a, b, new = pairs[item >> 32]
        j = after[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue  # one of the two was merged meanwhile
        symbol[i], symbol[j] = new, -1
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if (r := rank_of.get((new, symbol[k]), -1)) >= 0:
                heapq.heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := rank_of.get((symbol[h], new), -1)) >= 0:
            heapq.heappush(heap, r << 32 | h)
    return count


class WordCache:
    """Results by word; a full cache starts anew and long words are not kept, so memory stays bounded whatever the texts
    hold."""

    def __init__(self, make: Callable[[str], int], most: int = CACHED_WORDS, longest: int = CACHED_CHARS):
        self.make, self.most, self.longest, self.known = make, most, longest, {}

    def of(self, words: list[str]) -> list[int]:
        found = list(map(self.known.get, words))
        if None in found:
            for i, w in enumerate(words):
                if found[i] is None:
                    found[i] = self._one(w)
        return found

    def _one(self, word: str) -> int:
        if (n := self.known.get(word)) is None:
            n = self.make(word)
            if len(word) <= self.longest:
                if len(self.known) >= self.most:
                    self.known = {}
                self.known[word] = n
        return n


_of_worker: dict[str, tuple[Vocabulary, WordCache]] = {}


def _counter(path: str) -> tuple[Vocabulary, WordCache]:
    if path not in _of_worker:
        v = Vocabulary(path)
        _of_worker[path] = v, WordCache(lambda w: merged_length(w.encode(), v))
    return _of_worker[path]


def count_tokens(text: str, path: str) -> int:
    vocabulary, cache = _counter(path)
    return sum(1 if i % 2 else sum(cache.of(split_words(part))) for i, part in enumerate(vocabulary.parts(text)))


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text (null: 0) by the vocabulary file at ``path``, which every executor must have."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([count_tokens(t, path) for t in batch], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, over whole texts. A null text counts as empty; an empty
    one has 0 tokens; strings of added tokens inside a text are one token each. Rows that repeat or have a null key
    keep a row each; an empty table gives no rows. No shuffle."""
    ship_code(docs.sparkSession)
    t = docs[f"`{text}`"]
    counted = docs.select(docs[f"`{key}`"].alias("doc_id"), n_bytes(t).alias("n_bytes"), token_count(t, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
