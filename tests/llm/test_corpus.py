"""Each corpus operator against a brute-force version, on rows with nulls, empty and long texts, ties and repeats."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from quireframe.llm import ann, bpe, chat, host_quality, mixing, near_duplicates, packing, quality_classifier, sharding, warc
from quireframe.llm.shingles import block_keys, bands_of, parity, shingle_set

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row long, size long, bytes long, key string, host string, t long"


def odd_rows():
    r = random.Random(5)
    base = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randint(0, 60)) for _ in range(300))
    near = base.split()
    near[100] = "changed"
    texts = [base, base, base.upper(), " ".join(near), base + " tail", None, "", " \n\t ", "one", "One two", "one  two", "a b c", "line\nline\n\nline", "x " * 40, "word " * 20_000, "é# $%<|endoftext|> ok\x0b\x1c z"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, 1, 2, 3, 4, "k", "h", 5) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base, None, None, *rows[0][4:]), (None, None, None, None, *rows[0][4:])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def measures(text):
    w = WORDS.findall(text or "")
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_host_quality(odd, empty, spark):
    got = host_quality.score_documents(odd).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(r[0], *measures(r[1])) for r in odd_rows()])
    assert all(r.kept == (not r.base_failed and r.host_kept) for r in got)
    kept = host_quality.keep_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert host_quality.score_documents(empty).count() == 0 and host_quality.keep_documents(empty).count() == 0
    counts = spark.createDataFrame([("good", 1000, 10), ("bad", 1000, 990), ("tiny", 1, 1), (None, 5, 0)], "host string, n_docs long, n_failed long")
    v = {r.host: r for r in host_quality.host_verdicts(counts).collect()}
    assert v["good"].host_kept and not v["bad"].host_kept and v["tiny"].shrunk_rate < 1 and v[None].host_kept


def test_sharding(odd, empty, docs):
    for d in (odd, docs):
        rows, got = d.collect(), sharding.shard_documents(d).collect()
        size = lambda t: len((t or "").encode()) + 1
        same([(r.doc_id, r.size, r.text_crc32) for r in got], [(r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in rows])
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
        largest, share = max(r.size for r in got), sum(r.size for r in got) / 16
        assert set(by) <= set(range(16)) and max(sum(r.size for r in rs) for rs in by.values()) <= share + largest
    assert sharding.shard_documents(empty).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24)).round(3)
    rows = [(i, [float(v) for v in x[i % 390]]) for i in range(400)] + [(400, None), (420, [0.0] * 24), (440, [float("nan")] * 24), (460, [None] * 24), (480, [1.0]), (500, [])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1.0)).withColumn("list", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.search(t, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        exact = sorted((-float((x[i % 390] * x[q % 390]).sum()), i) for i in range(400) if i != q)[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == pytest.approx(float((x[i % 390] * x[q % 390]).sum()), abs=1e-12) for i, s in found)
        hits += len({i for _, i in exact} & {i for i, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(t.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(t.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2), (0, 3), (0, 4)]


@pytest.mark.parametrize("sigma", [0.0, 0.6, 1.0])
def test_nearest_of_differing_norms(spark, sigma):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32))
    x *= np.exp(sigma * rng.standard_normal(4000))[:, None] / np.linalg.norm(x, axis=1)[:, None]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.search(t, F.col("vec_id") % 40 == 0).collect():
        got[r.query_id].add(r.vec_id)
    score = x[::40] @ x.T
    score[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    hits = sum(len(got[40 * i] & set(np.argsort(-s)[:20])) for i, s in enumerate(score)) / 2000
    print(f"recall at sigma {sigma}: {hits}")
    assert hits >= 0.98


def test_warc(spark):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "u\r\nv", ""), (5, "http://b", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (None, "c", "z")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("d", F.lit("x"))
    captures = warc.archive_pages(t)
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.capture_digests(captures).collect()]
    kinds = [("revisit", 2), ("response", None), ("revisit", 2), ("revisit", 4), ("response", None), ("response", None), ("response", None)]
    same(got, [(p, len((h or "").encode()), digest(h), *k) for (p, _, h), k in zip(rows, kinds, strict=True)])
    assert captures.filter("n_requests != 1 OR n_metadata != 1 OR response IS NULL").count() == 0
    assert warc.capture_digests(warc.archive_pages(t.limit(0))).count() == 0
    loose = spark.createDataFrame([("request", "r1", ["m"], None), ("response", "m", ["x1"], None), ("metadata", "x1", [], None), ("metadata", "x2", [], None)], "record_type string, record_id string, concurrent_to array<string>, refers_to string")
    loose = loose.selectExpr("*", "'' target_uri", "'' content_type", "0L payload_bytes", "'' payload_digest", "map('a','b') fields", "binary('') payload")
    same([(r.capture_id, r.response is not None, r.n_requests, r.n_metadata) for r in warc.assemble(loose).collect()], [("m", True, 1, 1), ("x2", False, 0, 1)])


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = collections.Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in odd_rows())
    pieces = packing.pack_documents(odd, PATH)
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at, made, open_ = 0, collections.Counter(), []
    for r in rows:
        assert r.sequence_id * 2048 + r.offset == at and len(r.ids) == 4 * r.length and r.start == len(open_)
        open_ += np.frombuffer(r.ids, "<u4").tolist()
        at += r.length
        if len(open_) == r.doc_tokens:
            made[r.doc_id, tuple(open_)] += 1
            open_ = []
    assert made == want
    seq = packing.sequences(pieces).collect()
    assert all(len(s.ids) == 8192 or (s.n_tokens & (s.n_tokens - 1)) == 0 for s in seq) and sum(s.n_tokens for s in seq) == at
    assert packing.pack_documents(empty, PATH).count() == 0


def brute_components(rows, size, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x.translate(fold) for x in WORDS.findall(t or "")]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).extend([d] if d is not None else [])
    return [(d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates(odd, docs, size, percent):
    for d in (odd, docs):
        got = near_duplicates.document_components(d, size=size, percent=percent).collect()
        same([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute_components([(r.doc_id, r.text) for r in d.collect()], size, percent))


def test_one_of_each(odd, empty):
    kept = near_duplicates.keep_one_of_each(odd.filter("doc_id IS NOT NULL")).collect()
    want = {r[2] for r in brute_components([r[:2] for r in odd_rows() if r[0] is not None], 3, 90)}
    assert sorted(r.doc_id for r in kept) == sorted(want)
    assert near_duplicates.document_components(empty).count() == 0


def test_sketches_bound_differences():
    r = np.random.default_rng(2)
    for percent in (80, 90):
        for n in (1, 5, 12, 40, 300, 3000):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            cut = len(a) * (100 - percent) // 100
            b = a[: len(a) - cut]
            assert np.bitwise_count(parity(a, 1024) ^ parity(b, 1024)).sum() <= cut
            assert np.array_equal(a, b) or set(block_keys(a, percent)) & set(block_keys(b, percent))
            assert bands_of(percent).band(n) - bands_of(percent).band(max(1, -(-n * percent // 100))) <= 1
    assert len(shingle_set("A b", 3)) == 1 and len(shingle_set(" \n", 3)) == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left, free = total - sum(2 * sizes[s] for s in capped), [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: t.get(s, 2.0 * sizes[s]) for s in names}
        capped |= over


def test_mixing(odd, empty, docs):
    for d in (odd, docs):
        rows, got = d.collect(), mixing.mix_documents(d).collect()
        size = lambda t: len(WORDS.findall(t or ""))
        sizes, largest = collections.Counter(), collections.Counter()
        for r in rows:
            sizes[r.source] += size(r.text)
            largest[r.source] = max(largest[r.source], size(r.text))
        same([(r.doc_id, r.size, r.source_size) for r in got], [(r.doc_id, size(r.text), sizes[r.source]) for r in rows])
        targets = brute_targets(sizes)
        mixed = mixing.mix_rows(d.select(F.struct("doc_id", "source").alias("row"), "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS.pattern)).cast("long").alias("size"))).collect()
        taken = collections.Counter()
        for r in mixed:
            assert r.target == pytest.approx(targets[r.source]) and 0 <= r.copies <= 2
            taken[r.source] += r.copies * r.size
        assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_documents(d).collect()))
        assert mixing.take_documents(d).columns == d.columns
    assert mixing.mix_documents(empty).count() == 0 and mixing.take_documents(empty).count() == 0


def test_quality_classifier(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.score_documents(d, labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    scored = quality_classifier.score_documents(odd, labels).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert quality_classifier.score_documents(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.score_documents(odd, labels.limit(0)).collect()} == {0.5}


def test_token_counts(odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    same([tuple(r) for r in bpe.count_documents(odd, PATH).collect()], [(r[0], len((r[1] or "").encode()), n(r[1] or ""), n(r[1] or "") > 512) for r in odd_rows()])
    r = random.Random(1)
    letters = "ab  \n\t'sé1²_½Ⅷ一🙂́\x1c\x85 　<|endoftext|>.!"
    for _ in range(1500):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert bpe.count_tokens(t, PATH) == len(ids) and packing.encode(t, PATH) == np.array(ids, "<u4").tobytes()
    assert bpe.count_documents(empty, PATH).count() == 0


def test_chat(spark):
    r = random.Random(3)
    marks = ["\\", "###", " Assistant:", "</turn>", "<turn ", "\n", "a", ">", "é", "x", "y"]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", None]), r.choice([None, "".join(r.choice(marks) for _ in range(r.randint(0, 9)))])) for c in [*range(12), None] for t in range(r.randint(1, 5))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"long {t}") for t in range(200)] + [(51, None, "user", "a"), (51, None, "user", "a"), (51, 0, "assistant", "b")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    want = []
    for c in {x[0] for x in rows}:
        turns = sorted(((u is not None, u or 0, a or "", s or "") for k, u, a, s in rows if k == c))
        loss = "".join(s for _, _, a, s in turns if a == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{a}\n{s}\n" for _, _, a, s in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    same([tuple(x)[:5] for x in chat.digest_conversations(t).collect()], want)
    assert chat.format_conversations(t).filter("rewrites_history").count() == 0
    assert chat.digest_conversations(t.limit(0)).count() == 0
    output, spans, rewrites = chat.locate([("user", "a"), ("assistant", "b")], lambda ts: "|".join(s for _, s in ts[-1:]))
    assert rewrites and output == "b" and spans[1][:2] == (0, 1)


def test_chat_renders_true_prefixes(spark):
    head = lambda ts: "<begin>system\n" + "".join(f"{r}: {t}\n" for r, t in ts)
    numbered = lambda ts: "".join(f"{i}. {t}\n" for i, (_, t) in enumerate(ts))
    rewriting = lambda ts: "".join(f"{t if t != 'note' or len(ts) < 80 else 'cut'}\n" for _, t in ts)
    talks = {1: ["note", *map(str, range(99))], 2: ["x" * 210_000, "after", "end"], 3: ["short"]}
    rows = [(c, n, "assistant" if n % 2 else "user", t) for c, ts in talks.items() for n, t in enumerate(ts)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for template in (head, numbered, rewriting):
        got = {(r.conv_id, r.window): r for r in chat.format_conversations(t, template).collect()}
        assert sorted(got) == [(1, 0), (2, 0), (3, 0)]
        for c, ts in talks.items():
            turns = [(r, x) for k, _, r, x in rows if k == c]
            r = got[c, 0]
            assert r.formatted == template(turns) and len(r.turns) == len(ts)
            assert r.rewrites_history == (template is rewriting and c == 1)
            assert r.rewrites_history or all(r.formatted[s.text_start : s.text_end] == x for s, (_, x) in zip(r.turns, turns, strict=True))
    with pytest.raises(ValueError, match="append-only"):
        list(chat.windows([("user", x) for x in talks[1]], chat.append_only(numbered)))
    assert len(list(chat.windows([("user", x) for x in talks[1]], chat.turn_template))) == 2


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns and docs.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            assert counts[-1] == len({r[2] for r in brute_components([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], 5, 80)})
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    assert isinstance(docs.schema["doc_id"].dataType, T.LongType)
