import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quireframe.functions import measures as M
from quireframe.operators import records as R
from quireframe.operators import text as X
from quireframe.streaming.events import stable_files, stable_files_stream


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def test_whole_word_does_not_extend(spark):
    pages = one(spark, doc_id=1, page=1, text="cats act")
    assert X.match_rows(pages, X.wildcard_pattern("c*t", whole_word=True)).count() == 0
    assert [(r.start, r.end) for r in X.match_rows(pages, X.wildcard_pattern("c*t")).collect()] == [(0, 3), (6, 8)]
    for bad in ("**", "?*"):
        with pytest.raises(ValueError):
            X.wildcard_pattern(bad)


def test_luhn(spark):
    rows = spark.createDataFrame([("4111 1111 1111 1111",), ("4111 1111 1111 1112",), ("79927398713",)], "d string")
    assert [r[0] for r in rows.select(X.luhn_valid(F.col("d"))).collect()] == [True, False, False]


def test_formula(spark):
    row = one(spark, a=2.0, b=8.0)
    assert row.select(M.formula("-(a+2)*b/4"), M.formula("a/(b-8)")).first() == (-8.0, None)
    for bad in ("a+", "(a", "a b", "a;b", ""):
        with pytest.raises(ValueError):
            M.formula(bad)


def test_geometry_and_schedule(spark):
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    got = spark.range(1).select(M.area(points), M.perimeter(points), M.catch_up(F.lit(0), F.lit(60_000), F.lit(7_230_000))).first()
    assert tuple(got) == (12.0, 14.0, 7_200_000)


def test_summary_and_answer(spark):
    d = one(spark, doc_id=1, text="Safety review finds valve risk. Safety valve is old. Schedule slips.")
    assert X.summary(d, 1).first().sentence == "Safety valve is old."
    d = one(spark, doc_id=1, text="The contract value is $12,000. Delivery is 2026-08-01.")
    assert X.ask(d, "what contract value").first().confidence == pytest.approx(2 / 3)


def test_proofread(spark):
    assert one(spark, t="this   is ,a draft .").select(X.proofread(F.col("t"))).first()[0] == "this is,a draft."


def test_keyed_diff(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, p string")
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "id string, p string")
    assert {r.id: r.status for r in R.keyed_diff(a, b, "id", ["p"]).collect()} == {"a": "unchanged", "b": "changed", "c": "added"}


def test_text_sort(spark):
    rows = spark.createDataFrame([(1, 2), (2, 10), (3, 1)], "id int, page int")
    assert [r.page for r in R.sorted_as_text(rows, "page", "id").collect()] == [1, 10, 2]


POLLS = [(1, "f", "s1"), (2, "f", "s1"), (3, "f", "s2"), (4, "f", "s2"), (6, "f", "s2"), (7, "f", "s2")]


def test_stable_files(spark, tmp_path):
    want = [(2, "s1"), (4, "s2"), (7, "s2")]
    rows = spark.createDataFrame(POLLS, "poll int, name string, signature string")
    assert sorted((r.poll, r.signature) for r in stable_files(rows).collect()) == want
    for poll, name, sig in POLLS:
        spark.createDataFrame([(poll, name, sig)], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = stable_files_stream(stream).writeStream.format("memory").queryName("stable").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.poll, r.signature) for r in spark.table("stable").collect()) == want


def test_tree_of_any_depth(spark):
    r = random.Random(6)
    rows = [(t, n, r.choice([0, 2, 8, 10, 14, 20, r.randint(0, 20)])) for t in range(6) for n in range(60)] + [(7, n, n) for n in range(21)] + [(8, n // 2, d) for n, d in enumerate((0, 9, 12, 10, 13, 11))] + [(9, 1, None), (9, 2, 3), (9, 3, -1), (9, 4, 0)]
    got = R.tree_parents(spark.createDataFrame(rows, "tree long, n long, depth int"), "tree", "n", "depth").collect()
    sql = "SELECT a.tree, a.n, a.depth, (SELECT max(b.n) FROM r b WHERE b.tree = a.tree AND b.n < a.n AND b.depth < a.depth) AS parent FROM r a"
    con = duckdb.connect()
    con.execute("CREATE TABLE r (tree BIGINT, n BIGINT, depth INT)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(sql).fetchall()))


def test_proofread_any_language(spark, tmp_path):
    from quireframe.plans.queries import QUERIES

    rows = [(1, "en", "i see ,  i\tsay"), (2, "fr", "voil\u00e0\u00a0: i \u00e9i i\u00e9"), (3, "de", "\u2003ja !"), (4, None, "x i"), (5, "es", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.clean for r in QUERIES["proofread_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "I see, I say", 2: "voil\u00e0: I \u00e9I I\u00e9", 3: "ja!", 4: "x I", 5: None}


def test_extracted_data_has_keywords_and_spaced_amounts(spark):
    text = "Pay $ 100.00 or $2,500 by 2024-01-02, not 12024-01-02; mail A.b@c.org. " + " ".join(f"term{i:02d} " * (30 - i) for i in range(25))
    rows = [(1, text), (2, ""), (3, "$\u00a07 the $ 100.00 $ 100.00")]
    got = {r.doc_id: r for r in X.extracted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].emails, got[1].dates, got[1].amounts) == ("A.b@c.org", "2024-01-02", "$ 100.00|$2,500")
    assert got[1].keywords == "|".join(f"term{i:02d}:{30 - i}" for i in range(20))
    assert tuple(got[2]) == (2, "", "", "", "")
    assert (got[3].amounts, got[3].keywords) == ("$\u00a07|$ 100.00", "100.00:2")
