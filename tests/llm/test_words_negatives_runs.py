"""Encoding by distinct words, hard negatives and periodic runs against the library and brute force, on odd rows too."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quireframe.llm import hard_negatives, periodic_runs, queries, token_table
from quireframe.llm.bpe import Vocabulary

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, key string, value string, block long, item string, runs int, label int, n long"


def odd_texts():
    r = random.Random(11)
    letters = "ab é中́ \t\n 　\x1c\x85'"
    return [
        None,
        "",
        " ",
        "  \n",
        "It's   the 's we'll'd <|endoftext|><|endoftext|> <|endoftext|",
        "a" * 50_000,
        " " * 3_000 + "x" + "\n" * 2_000,
        "one two\x1cthree \x1c four",
        "word " * 9_000,
        *("".join(r.choice(letters) for _ in range(r.randint(1, 400))) for _ in range(60)),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(i, t, "en", "k", "v", 1, "i", 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, texts[4], None, *rows[0][3:]), (None, None, None, *rows[0][3:])], DOC)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("bounds", [{}, {"most": 40, "distinct": 7, "cell": 3, "stretch": 5}], ids=["usual", "tiny"])
def test_encoding(spark, odd, tokenizer, bounds):
    got = token_table.decode_documents(token_table.encode_documents(odd.repartition(3), PATH, **bounds), PATH).collect()
    want = []
    for r in odd.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((g.doc_id, bytes(g.ids), g.decoded) for g in got), key=key) == sorted(want, key=key)


def test_encoding_of_nothing_and_digests(spark, odd, tokenizer):
    digests = lambda docs: token_table.digest_documents(token_table.decode_documents(token_table.encode_documents(docs, PATH), PATH)).collect()
    assert digests(odd.limit(0)) == []
    (row,) = digests(odd.filter("doc_id = 4").limit(1))
    ids = tokenizer.encode(odd_texts()[4], add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert row.decoded_sha256 == hashlib.sha256(odd_texts()[4].encode()).hexdigest()


def test_decoding_of_ids(spark, tokenizer):
    r = random.Random(3)
    rows = [(i, [r.randrange(50_257) for _ in range(r.randrange(40))]) for i in range(50)] + [(50, None), (51, []), (None, [50_256, 220]), (52, [99_999, 220, None, 50_256])]
    got = {x.doc_id: x.decoded for x in token_table.decode_documents(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    known = lambda ids: [i for i in ids or [] if i is not None and i < 50_257]
    assert got == {k: tokenizer.decode(known(ids), skip_special_tokens=False) for k, ids in rows}


def test_stretches_change_no_word():
    vocabulary = Vocabulary(PATH)
    for text in filter(None, odd_texts()):
        whole = [w for ws in token_table.words_of(text, vocabulary) for w in ws]
        assert [w for ws in token_table.words_of(text, vocabulary, 3) for w in ws] == whole
        assert "".join(whole) == text


def mined(rows, is_anchor, k, m, percent=(50, 95)):
    """All products, all orders."""
    vectors = [(i, key, label, [int(np.floor(256 * float(x))) for x in v]) for i, (key, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for *_, v in vectors), default=0)
    vectors = [(i, key, label, v + [0] * (d - len(v))) for i, key, label, v in vectors]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for i, key, label, v in vectors:
        if key is None or not is_anchor(key):
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=True)), other, j, lb) for j, other, lb, w in vectors if j != i]
        for p in sorted((s for s in scores if s[3] == label), key=order)[:k]:
            far = sorted((s for s in scores if s[3] != label and percent[0] * p[0] <= 100 * s[0] <= percent[1] * p[0]), key=order)[:m]
            out += [(key, p[1], rank, s[1], p[0], s[0]) for rank, s in enumerate(far, 1)]
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("tiles", [(hard_negatives.ANCHOR_TILE, hard_negatives.CANDIDATE_TILE), (3, 7)], ids=["usual", "tiny"])
@pytest.mark.parametrize("kind", ["random", "near", "equal", "large"])
def test_negatives(spark, tiles, kind):
    r = np.random.default_rng(7)
    n, d = 150, 12
    v = {"random": r.standard_normal((n, d)) / 4, "near": 1 + r.standard_normal((n, d)) / 50, "equal": np.ones((n, d)), "large": r.standard_normal((n, d)) * 3e4}[kind]
    rows = [(i, x.tolist(), i % 4) for i, x in enumerate(v)]
    rows += [(200, None, 1), (201, [1.0] * d, None), (202, [None] + [1.0] * (d - 1), 1), (203, [float("nan")] * d, 1), (204, [float("inf")] * d, 1), (None, v[3].tolist(), 3), (None, v[4].tolist(), 0), rows[10], rows[10], (205, [0.0] * d, 2), (206, [1.0, 0.5], 2), (210, [], 1)]
    frame = spark.createDataFrame([(*x, "other", 1, 2) for x in rows], "vec_id long, embedding array<double>, label int, q string, row long, tile int").repartition(3)
    got = hard_negatives.mine(frame, F.col("id") % 10 == 0, tiles=tiles).collect()
    assert sorted(tuple(g[c] for c in COLUMNS) for g in got if g.positive_id is not None and g.negative_id is not None and g.anchor_id != 10) == sorted(x for x in mined(rows, lambda k: k % 10 == 0, 5, 3) if None not in x and x[0] != 10)
    assert len(got) == len(mined(rows, lambda k: k % 10 == 0, 5, 3))


def test_negatives_of_nothing_and_too_large(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("id") % 10 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e15] * 4, 1), (1, [1e15] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(huge, F.col("id") % 10 == 0).count()


def test_bounds_hold_at_every_plane():
    r = np.random.default_rng(1)
    a, v = r.integers(-300, 300, (20, 9)), r.integers(-400, 400, (60, 9))
    exact = a @ v.T
    seen = []

    def keep(i, c, low, high):
        assert (low <= exact[i, c]).all() and (exact[i, c] <= high).all()
        seen.append((high - low).max())
        return np.ones(len(c), bool)

    for i, c, score in hard_negatives._search(a, v, lambda i: np.ones(60, bool), keep):
        assert (score == exact[i, c]).all()
    assert min(seen) == 0


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        t = 0
        while t < n - q:
            s = t
            while t < n - q and w[t] == w[t + q]:
                t += 1
            e = t + q
            if t > s and e - s >= max(6, 4 * q) and not any(all(w[i] == w[i + p] for i in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            t = max(t, s + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def repeating(r):
    w = []
    for _ in range(r.randint(1, 5)):
        if r.random() < 0.6:
            unit = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randint(1, 40 if r.random() < 0.1 else 9))]
            w += (unit * 9)[: r.randint(len(unit), 7 * len(unit) + 3)]
        else:
            w += [r.randrange(r.choice([2, 3, 50])) for _ in range(r.randint(0, 12))]
    return w


def test_runs_against_brute_force():
    r = random.Random(1)
    total = 0
    for _ in range(1500):
        w = repeating(r)
        want = brute_runs(w)
        total += len(want)
        for window in (8, periodic_runs.WINDOW):
            assert periodic_runs.runs_of(np.array(w, np.int32), window) == want, w
    assert total > 1000


@pytest.mark.parametrize("period", [1, 37, 1000, 60_000])
def test_long_runs(period):
    w = np.arange(300_000, dtype=np.int32) % period
    assert periodic_runs.runs_of(w) == [(0, 300_000, period)]


def test_runs_of_documents(spark):
    r = random.Random(2)
    texts = [None, "", " \n", "one", "x " * 40, "a b c\t" * 12 + "d", "\x1c " * 7, *(" ".join(f"w{x}" for x in repeating(r)) for _ in range(40))]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(4, texts[4], "c"), (None, texts[5], "c"), (None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string")
    got = periodic_runs.digest_runs(periodic_runs.document_runs(periodic_runs.with_repeats(docs))).collect()
    want = []
    for doc_id, text, _ in rows:
        w = WORDS.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        kept = [True] * n
        for start, length, q in runs:
            kept[start + q : start + length] = [False] * (length - q)
        best = min(((-length, start, q) for start, length, q in runs), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *longest, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(x for x, k in zip(w, kept, strict=True) if k))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 and t for d, t, _ in rows if d is not None)
    assert periodic_runs.document_runs(docs.limit(0)).count() == 0


def test_queries(spark):
    for name, n in (("op11_distinct_words", 200), ("op13_periodic_runs", 200)):
        assert queries.QUERIES[name](spark, SF).count() == n
    assert queries.QUERIES["op12_bit_sliced_negatives"](spark, SF).count() > 0
