"""What the findings of round 4 asked for: SQL that leaves no tie to chance."""

import duckdb
import pytest


@pytest.fixture(scope="module")
def repeated_lines(tmp_path_factory):
    """Five files of lines that share document and place, but no supplier; some have none."""
    top = tmp_path_factory.mktemp("lines")
    (top / "lineitem.parquet").mkdir()
    for i in range(5):
        keys = f"SELECT range // 7 AS l_orderkey, (range % 7 + 1)::INT AS l_linenumber, CASE WHEN (range + {i}) % 11 > 0 THEN (range * {i + 3} + {i}) % 97 END::BIGINT AS l_suppkey FROM range(70000)"
        duckdb.execute(f"COPY ({keys}) TO '{top}/lineitem.parquet/part-{i}.parquet' (ROW_GROUP_SIZE 4096)")
    duckdb.execute(f"COPY (SELECT range AS o_orderkey FROM range(10000)) TO '{top}/orders.parquet'")
    return top


@pytest.mark.parametrize("name", ["accessibility_review", "depth_faults", "tag_role_counts", "tag_summaries"])
def test_sql_takes_the_first_of_the_table_whatever_its_threads(spark, repeated_lines, name):
    from quireframe.plans.queries import QUERIES, SQL

    got = QUERIES[name](spark, str(repeated_lines))
    got.write.parquet(out := f"{repeated_lines}/{name}")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    with duckdb.connect() as c:
        c.execute("SET threads = 8")
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{repeated_lines}/lineitem.parquet/*.parquet'")
        c.execute(f"CREATE VIEW orders AS SELECT * FROM '{repeated_lines}/orders.parquet'")
        for _ in range(5):
            c.execute(f"CREATE OR REPLACE TABLE want AS SELECT {columns} FROM ({SQL[name]})")
            for one, other in (("want", f"'{out}/*.parquet'"), (f"'{out}/*.parquet'", "want")):
                assert not c.execute(f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {other} LIMIT 3").fetchall()


def test_the_classifier_of_rows_that_repeat_is_that_of_each_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quireframe.llm import quality_classifier as Q

    monkeypatch.setattr(Q, "SAMPLE_ROWS", 20)
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "junk $$ ").otherwise("a sound sentence of words "), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4)).alias("text"))
    labels = docs.select("doc_id", F.expr("int(doc_id % 2)").alias("quality"))
    times = spark.range(7).drop("id")
    assert Q.fit(docs.crossJoin(times), labels.crossJoin(times)) == Q.fit(docs, labels)
    two = docs.unionByName(docs.withColumn("text", F.concat(F.lit("~ "), "text")))
    assert Q.fit(two, labels) == Q.fit(docs, labels)  # one text of each key, the smallest
