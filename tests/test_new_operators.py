"""Operators beyond SQL, or at their edges: against brute force, round trips and recorded values."""

import datetime
import hashlib
import itertools
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quireframe import registry
from quireframe.functions import bounded, measures, rasters, values
from quireframe.operators import diff, exports, graph, records, review, rules, sensitive, structure
from quireframe.operators import text as X
from quireframe.sources import files, office, tool_output
from quireframe.streaming import jobs


def brute_runs(before, after):
    a, b = re.findall(r"\S+", before), re.findall(r"\S+", after)
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) - 1, -1, -1), range(len(b) - 1, -1, -1)):
        rows[i][j] = rows[i + 1][j + 1] + 1 if a[i] == b[j] else max(rows[i + 1][j], rows[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("unchanged", a[i]))
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or rows[i][j + 1] >= rows[i + 1][j]):
            out.append(("added", b[j]))
            j += 1
        else:
            out.append(("deleted", a[i]))
            i += 1
    return [(k, " ".join(t for _, t in g), len(g)) for k, g in ((k, list(g)) for k, g in itertools.groupby(out, key=lambda x: x[0]))]


def test_token_runs():
    assert diff.token_runs("alpha beta gamma", "alpha delta gamma") == [("unchanged", "alpha", 1), ("added", "delta", 1), ("deleted", "beta", 1), ("unchanged", "gamma", 1)]
    r = random.Random(2)
    for _ in range(400):
        x, y = (" ".join(r.choice("abcd") for _ in range(r.randint(0, 14))) for _ in range(2))
        assert diff.token_runs(x, y) == brute_runs(x, y)
    assert diff.token_runs("", "") == [] and diff.token_runs("x", "x x") == brute_runs("x", "x x")
    long = [str(r.randint(0, 99)) for _ in range(4000)]
    began, runs = time.time(), diff.token_runs(" ".join(long), " ".join(long[5:] + ["end"]))
    assert sum(n for k, _, n in runs if k == "unchanged") >= 3995 and time.time() - began < 5
    far = [[str(r.randint(0, 3_000)) for _ in range(20_000)] for _ in range(2)]
    began, runs = time.time(), diff.token_runs(*map(" ".join, far))
    assert sum(n for k, _, n in runs if k != "added") == sum(n for k, _, n in runs if k != "deleted") == 20_000 and time.time() - began < 30


def test_page_diffs(spark):
    left = spark.createDataFrame([(1, 1, "a b"), (1, 2, "c"), (2, 1, None)], "pair int, page int, text string")
    right = spark.createDataFrame([(1, 1, "a  b"), (2, 1, "d e"), (2, 2, "f")], "pair int, page int, text string")
    got = {(r.pair, r.page): r for r in diff.page_diffs(left, right, "pair").collect()}
    assert {k: (v.added, v.deleted, v.unchanged, v.left_present, v.right_present) for k, v in got.items()} == {(1, 1): (0, 0, 2, True, True), (1, 2): (0, 1, 0, True, False), (2, 1): (2, 0, 0, True, True), (2, 2): (1, 0, 0, False, True)}
    totals = {r.pair: r for r in diff.diff_totals(diff.page_diffs(left, right, "pair"), "pair").collect()}
    assert (totals[2].pages, totals[2].left_pages, totals[2].changed, totals[2].changed_pages) == (2, 1, 3, 2)


def test_bounded_expressions():
    assert bounded.Bounded("a|ab").find("xab") == (1, 3)  # the longest, not the first
    assert bounded.Bounded(r"^\d{3}-\d{2}-\d{4}$").test("123-45-6789") and not bounded.Bounded(r"^\d{3}-\d{2}-\d{4}$").test("bad")
    for bad in ("(a+)+$", "a**", "^*", "[", "(a", "a)", "[b-a]", "a{3,2}", "a{201}", "é", "", "\\q", "x" * 129):
        with pytest.raises(ValueError):
            bounded.Bounded(bad)
    began = time.time()
    assert not bounded.Bounded("a+a+a+a+a+a+a+$").test("a" * 10_000 + "!")
    assert time.time() - began < 1
    found = bounded.Bounded("a|ab", ignore_case=True).find_all("zz abab aB")
    assert found == [(3, 5), (5, 7), (8, 10)]
    for source, text, want in (("^a|b$|c", "acab", [(0, 1), (1, 2), (3, 4)]), ("(^|x)a", "aaxa", [(0, 1), (2, 4)]), ("k", "K\u212a\u0130", [(0, 1), (1, 2)]), ("[A-C]+", "xabC", [(1, 4)]), (r"\W", "a\u212ab", []), ("^$", "", []), (".", "\n\U0001f600", [(0, 1), (1, 2)])):
        assert bounded.Bounded(source, ignore_case=True).find_all(text) == want, source
    r = random.Random(4)
    for _ in range(600):
        source = "".join(r.choice(["a", "b", "c", ".", "[ab]", "[^a]", "(a|ab)", "(bc|b|)", "a?", "b*", "c+", "(ab){1,2}", "(a|b|cab){2,3}", "b{2,}", "c{0}"]) for _ in range(r.randint(1, 4)))
        if len(source) == 4 and source == "c{0}":
            continue
        t = "".join(r.choice("abc") for _ in range(9))
        got = bounded.Bounded(source).find(t)
        spans = [(i, j) for i in range(10) for j in range(i + 1, 10) if re.fullmatch(source, t[i:j])]
        want = min(spans, key=lambda s: (s[0], -s[1])) if spans else None
        assert got == want, (source, t)


def test_sensitive_kinds(spark):
    text = "call +1 (555) 123-4567, or 555-123-4567x; card 4111 1111 1111 1111 and 4111111111111112, id 12345678901234567; a@b.co _a@b.co A@B.CO"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, None), (2, 1, "")], "doc_id int, page int, text string")
    got = sensitive.kinds(pages, [("Word", "or", False), ("Code", "ID [0-9]{3}", True)]).collect()
    found = lambda kind: sorted(text[r.start : r.end] for r in got if r.kind == kind)
    assert found("phone") == ["+1 (555) 123-4567"] + [x for x in found("phone") if x != "+1 (555) 123-4567"]
    brute = [m[0] for m in re.finditer(r"(?<![A-Za-z0-9_])(?:\+?\d[\d .()\-]{6,}\d)(?![A-Za-z0-9_])", text) if len(re.sub(r"\D", "", m[0])) <= 15]
    assert found("phone") == sorted(brute)
    assert found("payment-card") == ["4111 1111 1111 1111 "]
    assert found("email") == ["A@B.CO", "_a@b.co", "a@b.co"] and found("custom-literal") == ["or"] and found("custom-regex") == ["id 123"]
    report = sensitive.report(sensitive.kinds(pages), 3).orderBy("id").collect()
    assert [r.id for r in report] == ["match-1", "match-2", "match-3"] and all(r.truncated for r in report)
    one = spark.createDataFrame([(1, "Email j.doe@example.com SSN 123-45-6789 phone 555-123-4567")], "doc_id int, text string")
    assert sorted((r.label, r.length) for r in sensitive.findings(one).collect()) == [("email", 17), ("phone", 12), ("ssn", 11)]


def test_forms_and_labels(spark):
    d = spark.createDataFrame([(1, "Date of birth*\nTotal amount:\nI agree\nFoo\n\n*"), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.name: (r.type, r.required, r.default_value) for r in structure.field_types(d).collect()}
    assert got == {"Date_of_birth": ("date", True, ""), "Total_amount": ("number", False, ""), "I_agree": ("checkbox", False, "false")}
    d = spark.createDataFrame([(1, "Name: Ada\nDate: 2026-07-01\nAmount: $20.00")], "doc_id int, text string")
    assert [(r.name, r.value) for r in structure.form_values(d).orderBy("ordinal").collect()] == [("Name", "Ada"), ("Date", "2026-07-01"), ("Amount", "$20.00")]
    values_ = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "x"), (4, "b", "7.5"), (5, "b", "NaN"), (6, "b", "1e3"), (7, "c", "no rule"), (8, "d", "abab!"), (9, "d", "")], "id int, field string, value string")
    rules_ = spark.createDataFrame([("a", "text", True, None, None, None), ("b", "number", False, "", 8.0, 100.0), ("d", "text", None, "^(ab|a){2}$", None, None)], "field string, type string, required boolean, pattern string, low double, high double")
    assert sorted((r.id, r.code) for r in review.form_errors(values_, rules_, "id").collect()) == [(1, "required"), (2, "required"), (4, "min"), (6, "max"), (8, "pattern")]


def test_value_errors(spark):
    ruled = "id int, field string, value string, value_type string, required boolean, type string, min_length int, max_length int, pattern string"
    ssn = r"^\d{3}-\d{2}-\d{4}$"
    rows = [
        (1, "f", "123-45-6789", None, None, None, None, None, ssn), (2, "f", "bad", None, None, None, None, None, ssn), (3, "f", "anything", None, None, None, None, None, ""), (4, "f", " \u00a0", None, None, "boolean", 9, None, "x"),
        (5, "f", "", None, False, None, 1, None, None), (6, "f", "true", "boolean", None, "string", 9, None, "x"), (7, "f", "true", "boolean", None, None, 9, None, "x"), (8, "f", "x", None, None, "boolean", 9, None, "y"),
        (9, "f", "long", None, None, "string", 5, 3, "z"), (10, "f", "a" * 10_000 + "!", None, None, None, None, None, "a+a+a+a+a+a+a+$"), (11, "f", None, None, None, None, 1, 1, "x"), (12, "f", None, None, False, None, 1, 1, "x"),
    ]
    began = time.time()
    assert sorted((r.id, r.code) for r in rules.value_errors(spark.createDataFrame(rows, ruled), "id").collect()) == [(2, "PATTERN"), (4, "REQUIRED"), (5, "MIN_LENGTH"), (6, "TYPE"), (8, "TYPE"), (9, "MAX_LENGTH"), (9, "MIN_LENGTH"), (9, "PATTERN"), (10, "PATTERN"), (11, "REQUIRED")]
    assert time.time() - began < 20
    with pytest.raises(Exception, match="repeat"):
        rules.value_errors(spark.createDataFrame([(1, "f", "v", None, None, None, None, None, "(a+)+$")], ruled), "id").collect()


def test_labels_of_numbers(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3)], "doc int, at int")
    assert [r.label for r in records.numbered(rows, "doc", "at", "A-", 99_999, 5, ".").orderBy("at").collect()] == ["A-99999.", "A-100000.", "A-100001."]
    n = spark.range(1, 4000).select(F.col("id"), records.roman(F.col("id")).alias("r"), records.letters(F.col("id")).alias("l"))
    got = {r.id: (r.r, r.l) for r in n.collect()}
    assert (got[1994], got[27], got[52], got[703]) == (("MCMXCIV", got[1994][1]), ("XXVII", "AA"), ("LII", "ZZ"), ("DCCIII", "A" * 28))


def test_chains_and_diffs(spark):
    rows = spark.createDataFrame([("a", i, f"x{i}") for i in range(5)] + [("b", 1, "y")], "log string, at int, what string")
    log = records.chained_log(rows, "log", "at", F.col("what"))
    content = F.concat("previous", F.lit("|"), F.col("what"))
    check = lambda d: {r.log: r.intact for r in records.verified_chain(d, "sequence", "previous", "digest", "log", content).collect()}
    assert check(log) == {"a": True, "b": True}
    last = [r for r in log.collect() if r.log == "b"][0]
    assert last.digest == hashlib.sha256(b"GENESIS|y").hexdigest()
    k = (F.col("log") == "a") & (F.col("at") == 2)
    for c, v in (("previous", None), ("previous", "x"), ("digest", None), ("what", "z"), ("sequence", 7)):
        damaged = log.withColumn(c, F.when(k, F.lit(v)).otherwise(F.col(c)).cast(log.schema[c].dataType))
        assert check(damaged) == {"a": False, "b": True}, c
    a = spark.createDataFrame([(None, "1"), ("b", "1")], "id string, p string")
    b = spark.createDataFrame([("b", "1"), ("c", "1")], "id string, p string")
    assert {r.id: r.status for r in records.keyed_diff(a, b, "id", ["p"]).collect()} == {None: "deleted", "b": "unchanged", "c": "added"}
    rise = spark.createDataFrame([("a", 1, 1), ("a", 2, None), ("a", 3, 2), ("b", 1, 1), ("b", 2, 5), ("c", 1, None)], "g string, at int, v int")
    assert {r.g: r.ascending for r in review.ascending(rise, "g", "at", "v").collect()} == {"a": False, "b": True, "c": False}


def test_cron():
    assert measures.cron_values("*/20", 0, 59) == [0, 20, 40] and measures.cron_values("*-20/5", 0, 59) == [0, 5, 10, 15, 20] and measures.cron_values("7", 0, 7) == [7]
    for bad in ("*-5", "8", "5-3", "*/0", "x", ""):
        with pytest.raises(ValueError):
            measures.cron_values(bad, 0, 7)


def test_graphs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 3), (2, 99)], "src int, dst int")
    got = {r.node for r in graph.reachability(nodes, edges, nodes.filter("node = 0")).filter("reachable").collect()}
    assert got == {0, 1, 2}
    needs = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 3), (5, 99), (6, 5), (6, 3)], "node int, needed int")
    order = {r.node: (r.level, r.status) for r in graph.dependency_order(nodes, needs).collect()}
    assert order == {0: (0, "resolved"), 1: (1, "resolved"), 2: (2, "resolved"), 3: (None, "cycle"), 4: (None, "cycle"), 5: (None, "missing"), 6: (None, "missing"), 7: (0, "resolved")}
    tree = spark.createDataFrame([(1, None, "A4", 2), (2, 1, None, 2), (3, 2, "A5", 0), (4, 2, None, 0), (5, 5, None, 0)], "node int, parent int, box string, n int")
    found = {r.node: (r.box, r.depth, r.leaf, r.leaves, r.declared) for r in graph.inherited(tree, ["box"], "n").collect()}
    assert found == {1: ("A4", 0, False, 2, True), 2: ("A4", 1, False, 2, True), 3: ("A5", 2, True, 1, True), 4: ("A4", 2, True, 1, True)}


def test_canonical_numbers():
    for x, want in ((1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (1e-7, "1e-7"), (123456789012345680000.0, "123456789012345680000"), (-0.0, "0"), (1.5e-6, "0.0000015"), (-2.5, "-2.5"), (100, "100")):
        assert values.canonical_json(x) == want
    assert values.canonical_json({"b": [1.0, None, "é"], "a": {"z": True, "y": False}}) == '{"a":{"y":false,"z":true},"b":[1,null,"é"]}'


def test_png_round_trip():
    r = random.Random(1)
    for w, h in ((1, 1), (3, 2), (7, 5)):
        raster = {"width": w, "height": h, "pixels": bytes(r.randrange(256) for _ in range(4 * w * h))}
        png = rasters.write_png(raster)["png"]
        assert rasters.read_png(png) == raster
        assert rasters.read_png(png[:-1]) is None and rasters.read_png(png + b"x") is None and rasters.read_png(png.replace(b"IDAT", b"IDAX")) is None
    import struct
    import zlib

    rows = [[10, 20, 30, 40, 50, 60], [11, 22, 33, 44, 55, 66], [9, 8, 7, 6, 5, 4]]
    filtered = bytes([1, 10, 20, 30, 30, 30, 30]) + bytes([3]) + bytes((v - ((rows[1][i - 3] if i >= 3 else 0) + rows[0][i]) // 2) & 255 for i, v in enumerate(rows[1]))
    paeth = lambda a, b, c: min((a, b, c), key=lambda v: abs(a + b - c - v))
    filtered += bytes([4]) + bytes((v - paeth(rows[2][i - 3] if i >= 3 else 0, rows[1][i], rows[1][i - 3] if i >= 3 else 0)) & 255 for i, v in enumerate(rows[2]))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = rasters.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(filtered)) + chunk(b"IEND", b"")
    assert list(rasters.read_png(png)["pixels"]) == [v for row in rows for p in (row[:3], row[3:]) for v in (*p, 255)]


def test_bundles_and_rtf():
    b = files.bundle({"name": "x"}, b"payload")
    assert files.bundle_status(b)[0] == "sound" and files.bundle_status(b[:-1])[0] == "truncated" and files.bundle_status(b + b"x")[0] == "trailing"
    assert files.bundle_status(b.replace(b'"name":"x"', b'"name": "x"'))[0] in ("not-canonical", "truncated")
    assert files.rtf_text("{\\rtf1\\ansi a\\'e9\\" + "u8364?\\par {\\b b\\b0} \\{c\\}\\tab d}") == "aé€\nb c\td"


def test_directory_and_publication(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "c.txt"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x" * 3)
    got = files.directory(spark, str(tmp_path / "in")).collect()
    assert [(r.name, r.size) for r in got] == [("a.pdf", 3), ("b.PDF", 3)]
    exports.published(spark.range(2), str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        exports.published(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


JOBS = [("j", 0, 1, "enqueue"), ("j", 10, 2, "claim"), ("j", 20, 3, "renew"), ("j", 200, 4, "complete"), ("j", 210, 5, "claim"), ("j", 220, 6, "fail"), ("j", 230, 7, "claim"), ("j", 1300, 8, "claim"), ("j", 1310, 9, "complete"), ("k", 5, 1, "claim")]
WANT = [("pending", True), ("running", True), ("running", True), ("pending", False), ("running", True), ("pending", True), ("pending", False), ("running", True), ("completed", True), ("none", False)]


def test_jobs_as_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(*j, 100, True, 1000) for j in JOBS], "job string, at long, seq long, action string, lease_ms long, transient boolean, delay_ms long")
    key = lambda r: (r.job, r.at)
    assert [(r.status, r.accepted) for r in sorted(jobs.job_states(rows).collect(), key=key)] == WANT
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.job_states_stream(stream).writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.status, r.accepted) for r in sorted(spark.table("jobs").collect(), key=key)] == WANT


def test_lease_ends_without_an_event(spark, tmp_path):
    schema = "job string, at long, seq long, action string, lease_ms long, transient boolean, delay_ms long"
    event = lambda job, at, action: (job, base + at, at, action, 1_000, True, 0)
    base = 1_700_000_000_000  # a stream begins with a watermark at the epoch
    parts = [
        [event("a", 0, "enqueue"), event("a", 10, "claim"), event("b", 0, "enqueue"), event("b", 10, "claim"), event("b", 500, "complete")],
        [event("other", 600_000, "enqueue")],
        [event("a", 600_001, "claim"), event("other", 1_200_000, "cancel")],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = jobs.job_states_timed(stream, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(((r.job, r.at - base, r.action, r.status, r.attempts) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert [g for g in got if g[0] == "a"] == [("a", 0, "enqueue", "pending", 0), ("a", 10, "claim", "running", 1), ("a", 1_010, "expire", "pending", 1), ("a", 600_001, "claim", "running", 2), ("a", 601_001, "expire", "pending", 2)]
    assert [g[2] for g in got if g[0] == "b"] == ["enqueue", "claim", "complete"]


def test_once_within(spark, tmp_path):
    schema = "id string, at timestamp, n int"
    t = lambda minute: datetime.datetime(2026, 1, 1, 0, minute)
    parts = [[("a", t(0), 1), ("b", t(1), 1), ("a", t(1), 2)], [("b", t(2), 3), ("c", t(3), 3)], [("d", t(40), 4)], [("e", t(41), 5), ("d", t(42), 5)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.append_within(stream, str(tmp_path / "log"), "id", "at", "10 minutes", str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect())
    batch = spark.createDataFrame([r for p in parts for r in p], schema)
    assert got == sorted(r.id for r in jobs.once_within(batch, "id", "at", "10 minutes").collect()) == ["a", "b", "c", "d", "e"]


def test_office_format(spark, tmp_path):
    office.register(spark)
    texts = {i: f"first & <{i}>\nsecond é\tx" for i in range(25)} | {99: ""}
    rows = spark.createDataFrame(list(texts.items()), "key int, text string").repartition(3)
    for kind in ("docx", "xlsx"):
        at = str(tmp_path / kind)
        rows.write.format("office").mode("append").option("kind", kind).save(at)
        read = spark.read.format("office").option("partition_bytes", 3_000).load(at)
        assert {int(re.search(r"(\d+)\.", r.path)[1]): r.text for r in read.collect()} == texts
        assert read.rdd.getNumPartitions() > 3
        assert spark.read.format("office").option("contents", "false").load(at).filter("text IS NULL AND size > 0").count() == 26
        assert json.loads((tmp_path / kind / "_manifest.json").read_text())["files"] == 26
    for bad in ([(1, "a"), (1, "b")], [(2, "a"), (None, "b")]):
        with pytest.raises(Exception, match="key"):
            spark.createDataFrame(bad, "key int, text string").repartition(2).write.format("office").mode("append").save(str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or list((tmp_path / "bad").rglob("*.docx")) == []


def test_zone_overlaps(spark):
    r = random.Random(8)
    rows = [(p, i, r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.0, 0.1, 1.0, 30.0, 500.0]) * r.random(), r.choice([0.0, 2.0, 40.0]) * r.random()) for p in range(3) for i in range(60)]
    rows += [(0, 60, None, 1.0, 1.0, 1.0), (None, 1, 0.0, 0.0, 1.0, 1.0), (1, 61, 0.0, 0.0, 4.0, 4.0), (1, 62, 4.0, 0.0, 4.0, 4.0), (1, 63, 2.0, 2.0, 0.0, 0.0)]
    got = sorted(map(tuple, records.overlapping(spark.createDataFrame(rows, "page int, id int, x double, y double, w double, h double"), "page").collect()))
    full = [z for z in rows if None not in z]
    assert got == sorted((a[0], a[1], b[1]) for a in full for b in full if a[0] == b[0] and a[1] < b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5])
    many = spark.range(100_000).select(F.lit(1).alias("page"), F.col("id"), (F.col("id") % 400 * 10).cast("double").alias("x"), F.floor(F.col("id") / 400 * 1.0).cast("double").alias("row")).withColumn("y", F.floor("row") * 10.0)
    many = many.select("page", "id", "x", "y", F.lit(10.5).alias("w"), F.lit(9.0).alias("h"))
    assert records.overlapping(many, "page").count() == 250 * 399


def test_append_once(spark, tmp_path):
    for part in ([("a", 1), ("b", 1), ("a", 2)], [("b", 3), ("c", 3)]):
        spark.createDataFrame(part, "id string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, n int").parquet(str(tmp_path / "in"))
        jobs.append_once(stream, str(tmp_path / "log"), "id", str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted(r.id for r in got) == ["a", "b", "c"]


def test_registry(spark):
    pages = spark.createDataFrame([(1, 1, "ab")], "doc_id int, page int, text string")
    assert registry.deliver("inventory.empty_pages", pages).count() == 0
    for name, error in (("no.such", KeyError), ("plugins.run", PermissionError)):
        with pytest.raises(error):
            registry.deliver(name)
    with pytest.raises(ValueError):
        registry.register("text", "summary", len)
    bad = lambda p: p.select("doc_id", "page", F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit("k").alias("kind"), F.lit("l").alias("label"))
    with pytest.raises(Exception, match="outside its page"):
        registry.detected(pages, bad).collect()
    with pytest.raises(ValueError):
        registry.detected(pages, lambda p: p)


def test_answers_and_sentences(spark):
    d = spark.createDataFrame([(1, "The contract value is $12,000. Delivery is 2026-08-01."), (2, "Nothing here."), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: (r.answer, r.confidence) for r in X.ask(d, "What is the contract value?").collect()}
    assert got[1] == ("The contract value is $12,000.", pytest.approx(2 / 3)) and got[2] == got[3] == got[4] == (None, 0.0)
    with pytest.raises(ValueError):
        X.ask(d, "is the")
    s = spark.createDataFrame([(1, " a. b!\x01c?  d ")], "doc_id int, text string")
    assert [r.sentence for r in X.sentences(s).orderBy("idx").collect()] == ["a.", "b!\x01c?", "d"]
    t = spark.createDataFrame([(1, "document page form review")], "doc_id int, text string").select(X.translated(F.col("text"))).first()[0]
    assert t == "documento página formulario revisión"


def test_text_pages(spark):
    o = spark.createDataFrame([(1, "a \r\nb\f\fc\f"), (2, "")], "doc_id int, output string")
    assert sorted((r.doc_id, r.page, r.text) for r in tool_output.text_pages(o).collect()) == [(1, 1, "a \nb"), (1, 2, ""), (1, 3, "c")]
    assert sorted((r.page, r.text) for r in tool_output.text_pages(o, F.lit(2)).filter("doc_id = 1").collect()) == [(1, "a \nb"), (2, "")]
    assert json.loads(values.canonical_json({"a": 1.25})) == {"a": 1.25}


def test_long_trees(spark):
    """A chain of 10,000, a tree by brute force, cycles and lost parents."""
    chain = spark.range(10_000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.when(F.col("id") % 1_000 == 0, F.col("id")).alias("v"), F.lit(1).alias("total"))
    began = time.time()
    got = {r.node: r for r in graph.inherited(chain, ["v"], "total").collect()}
    assert time.time() - began < 90 and len(got) == 10_000
    assert all((r.depth, r.root, r.v, r.leaf, r.declared) == (n, 0, n // 1_000 * 1_000, n == 9_999, True) for n, r in got.items())
    r = random.Random(6)
    parent = {0: None, 1: None} | {n: r.randrange(n) for n in range(2, 150)} | {200: 201, 201: 202, 202: 200, 203: 200, 204: 204, 205: 999}
    value = {n: r.choice([None, n]) for n in parent}
    under = {n: 0 for n in parent}
    for n in range(150):
        if n not in parent.values():
            at = n
            while at is not None:
                under[at] += 1
                at = parent[at]
    rows = [(n, p, value[n], under[n] if n % 3 else -1) for n, p in parent.items()]
    got = {r.node: r for r in graph.inherited(spark.createDataFrame(rows, "node int, parent int, v int, total int"), ["v"], "total").collect()}
    assert sorted(got) == list(range(150))
    for n, g in got.items():
        path = [n]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        leaf = n not in parent.values()
        assert (g.depth, g.root, g.v, g.leaf, g.declared) == (len(path) - 1, path[-1], next((value[x] for x in path if value[x] is not None), None), leaf, leaf or n % 3 > 0)
