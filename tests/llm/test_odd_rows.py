"""Corpus operators and pipeline stages on odd rows: nulls, empties, long texts, ties, repeats, clashing names, many keys."""

import collections
import gzip
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quireframe.llm import ann, chat, mixing, near_duplicates, quality_classifier, shared, warc

SF = "/root/testdata/sf0.001"
GOOD = " ".join(f"word{i} and thing{i * 7 % 13}" for i in range(60))
DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, t long, root long, e long, size long, host string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [GOOD, GOOD, GOOD + " tail", None, "", " \n ", "one", "word " * 30_000, GOOD.upper(), "é " * 50 + GOOD]
    rows = [(i, t, "en", "s" if i % 2 else None, 1, 2, 3, 4, 5, 6, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, GOOD, None, None, 1, 2, 3, 4, 5, 6, "h"), (3, GOOD + " other", "en", "s", 1, 2, 3, 4, 5, 6, "h")], DOC)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, stage):
    out = shared.written(stage(spark, odd, SF), "odd-stage")
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert last or out.columns == odd.columns
    if last:
        assert out.filter("doc_id IS NULL").count() > 0 and out.agg(F.sum("length")).first()[0] > odd.count()
    assert shared.written(stage(spark, odd.limit(0), SF), "empty-stage").count() == 0


def test_one_row_of_each_component(spark):
    near = GOOD + " changed"
    rows = [(3, GOOD), (3, near), (3, near), (4, GOOD), (None, GOOD), (5, "quite another text of many other words " * 9), (6, None), (6, None), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("root", F.lit("x"))
    kept = near_duplicates.keep_one_of_each(d, size=5, percent=80).collect()
    assert collections.Counter(r.doc_id for r in kept) == {3: 1, 5: 1, 6: 2, 7: 1}
    assert kept[0].__fields__ == ["doc_id", "text", "t", "root"]


def test_queries_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (20, x[7].tolist())]
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert all(sorted(k for k, _ in v) == list(range(1, 21)) for v in got.values()) and len(got) == 10
    assert all(collections.Counter(i for _, i in v)[q] == 0 for q, v in got.items())
    assert len({i for _, i in got[0]}) == 20 - (collections.Counter(i for _, i in got[0])[20] == 2)


def test_recall_on_many_vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64), pa.int32()), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": flat}), str(tmp_path / "v.parquet"))
    got = collections.defaultdict(set)
    for r in ann.search(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -9
        hits += len(found & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(got) == 500 and hits / (20 * len(got)) >= 0.9


def test_archives_of_others(spark, tmp_path):
    record = lambda kind, rid, block, *more: ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", rid), *more, ("Content-Length", len(block))]) + "\r\n").encode() + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"body" * 50_000
    all_ = [record("warcinfo", "<i>", b""), record("response", "<a>", http, ("Content-Type", "application/http; msgtype=response")), record("request", "<b>", b"GET", ("WARC-Concurrent-To", "<a>"))]
    (tmp_path / "plain.warc").write_bytes(b"".join(all_))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(all_).replace(b"<a>", b"<c>").replace(b"<b>", b"<d>")))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(r.replace(b"<a>", b"<e>").replace(b"<b>", b"<f>")) for r in all_))
    captures = warc.assemble(warc.read_archive(spark, str(tmp_path))).collect()
    answers = {r.capture_id: r for r in captures if r.response is not None}
    assert sorted(answers) == ["<a>", "<c>", "<e>"]
    assert all(r.n_requests == 1 and r.response.payload_bytes == 200_000 and bytes(r.response.payload) == b"body" * 50_000 for r in answers.values())


def test_splits_of_archives(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    splits = warc.write_archive(pages, str(tmp_path / "w"))
    assert splits.agg(F.sum("captures")).first()[0] == 60
    records = warc.read_archive(spark, str(tmp_path / "w"), with_payload=False, splits=splits)
    assert records.groupBy("record_type").count().filter("count = 60").count() == 3
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 180


def test_scores_by_hand(spark):
    rows = [(i, (GOOD if i % 2 else "bad junk $$$ ") * (i % 3 + 1) + str(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(d, labels)
    by = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_AUTO) for x in (model.good, model.bad)]
    got = {r.doc_id: r.score for r in quality_classifier.score_documents(d, labels).collect()}
    for i, t in rows:
        raw = t.encode()
        pieces = [raw[k : k + quality_classifier.PIECE] for k in range(0, len(raw), quality_classifier.PIECE)] or [b""]
        g, b = (sum(len(zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=x, write_content_size=False, write_dict_id=False, write_checksum=False).compress(p)) for p in pieces) for x in by)
        e, r = (b - g) / (b + g), np.log(g / (len(raw) + 8))
        x = (np.array([e, e * abs(e), r, r * r]) - model.center) / model.scale
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -50, 50))), abs=1e-9)


def test_many_sources(spark):
    sizes = spark.createDataFrame([(f"s{i:04d}", (i * 37 % 101 + 1) * 10) for i in range(2000)] + [(None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    names = sorted((s for s in got if s is not None)) + [None]
    size = {f"s{i:04d}": (i * 37 % 101 + 1) * 10 for i in range(2000)} | {None: 500}
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        level = left / sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and level * w[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    assert all(got[s] == pytest.approx(2 * size[s] if s in capped else level * w[s]) for s in names)


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " + ("x" * 250_000 if i == 40 else "")) for i in range(500)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.digest_conversations(t).first()
    loss = "".join(x for _, i, _, x in rows if i % 2)
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (500, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    blank = lambda ts: "".join(f"{x if len(ts) - i <= 100 else ''}\n" for i, (_, x) in enumerate(ts))
    short = t.filter("turn < 150").withColumn("text", F.substring("text", 1, 9))
    out = chat.format_conversations(short, blank).first()
    assert out.rewrites_history and out.formatted == blank([(a, x[:9]) for _, i, a, x in rows[:150]])


def test_shared_folder_needs_a_name(spark, monkeypatch):
    class Session:
        class conf:
            @staticmethod
            def get(*_):
                return None

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session)


def test_broadcasts_are_bounded_by_bytes(spark):
    d = spark.createDataFrame([("x" * 1000,)] * 10, "s string")
    assert "broadcast" in shared.broadcast_if_small(d, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in shared.broadcast_if_small(d, 100, 5000)._jdf.queryExecution().logical().toString().lower()


def test_pipeline_twice(spark):
    first = corpus_pipeline.run(spark, SF)
    rows = sorted(map(repr, first.collect()))
    second = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, first.collect())) == rows == sorted(map(repr, second.collect()))


def test_mix_of_many_equal_rows(spark):
    """All in one source, with null keys: in chunks like any other, and no row more than another's share."""
    n = 100_000
    same = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("one two three").alias("text"))
    other = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.lit("a b").alias("text"))
    got = mixing.mix_documents(same.unionByName(other))
    assert got.count() == n + 50
    taken = {r.target: (r.taken, r.n) for r in got.groupBy("target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()}
    for target, (sum_taken, _) in taken.items():
        assert abs(sum_taken - target) <= 3
    assert got.filter("taken > 2 * size OR taken < 0").count() == 0
    parts = mixing._told_apart(same.select(F.col("doc_id").alias("key"), "source", F.lit(3).alias("size")))
    assert parts.select("row").distinct().count() == n
    chunks = parts.select(F.pmod(F.xxhash64("row", F.lit(mixing.SEED)), F.lit(-(-n // mixing.CHUNK))).alias("c")).groupBy("c").count()
    assert chunks.agg(F.max("count")).first()[0] < 2 * mixing.CHUNK


def test_near_duplicates_in_shares_and_parts(spark, monkeypatch):
    """Small bounds: units are contracted share by share, and large groups compared part by part, with the same links."""
    texts = [" ".join(f"w{g}-{i}" if (i + k) % 97 else f"x{k}" for i in range(120)) for g in range(6) for k in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, texts[0])], "doc_id long, text string")
    want = sorted(map(tuple, near_duplicates.document_components(docs, size=3, percent=80).select("doc_id", "n_shingles", "component_id").collect()))
    assert len({w[2] for w in want}) < len(want)
    for name, value in (("ONE_ROUND", 3), ("UNIT", 4), ("UNIT_MEMBERS", 400)):
        monkeypatch.setattr(near_duplicates, name, value)
    got = sorted(map(tuple, near_duplicates.document_components(docs, size=3, percent=80).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == want
