"""What the corpus operators share: word splitting, written tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_recording: list[list[str]] = []

#: One or more separators: space and the controls tab to carriage return. Words are what lies between them.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for a null text or one without a word."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes as a long; 0 for null."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Where a session names none, one is made under the local temporary folder
    and set if driver and executors are one process (tests, a notebook); on a cluster that is an error, as each machine
    would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quireframe-")
        spark.sparkContext.setCheckpointDir(named)
    return os.path.join(named, "quireframe-" + spark.sparkContext.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; those who ``record`` are told of it."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    for paths in _recording:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, a lost executor costs
    one re-read of a file."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are taken in the shared folder meanwhile."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete what lies at ``paths`` in the shared folder. Nothing that reads it can run afterwards."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once all that is made of them is written too."""
    for t in tables:
        delete(t.sparkSession, [t._written_to])


def broadcast_if_small(df: DataFrame, limit: int, most_bytes: int = 64 << 20) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it has at most ``limit`` rows, and at most ``most_bytes`` in its strings
    and binaries; beyond that the join shuffles, and adaptive execution splits its hot keys. The result is the same
    either way."""
    long = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    n, size = df.limit(limit + 1).agg(F.count("*"), F.sum(sum(long, F.lit(0)).cast("long"))).first()
    return F.broadcast(df) if n <= limit and (size or 0) <= most_bytes else df


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's place (long, from 0) in an order of all rows, which are dealt out by ranges of it: each task
    numbers its own, and prefix sums over the tasks' counts, a row each, do the rest. Ties are numbered in any order."""
    part, keys = f"_{name}_part", [c.alias(f"_{name}_{i}") for i, c in enumerate(order)]
    by = [f"_{name}_{i}" for i in range(len(keys))]
    dealt = written(df.select("*", *keys).repartitionByRange(*by).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(counts.select(part, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base")))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*by)) - 1
    return dealt.withColumn(name, place.cast("long")).join(base, part).withColumn(name, F.col(name) + F.col("_base")).drop(part, "_base", *by)
