"""Range sharding by sampled splitters (operator 2).

A size-weighted sample of keys gives quantile boundaries; records are partitioned into many fine ranges, ranges that
come out overfull are subdivided by a denser sample of their own, and exact byte sums of the ranges say where the
shards end. Inside a range, prefix sums give each record its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm.shared import n_bytes, written

SHARDS = 16
#: Fine ranges aimed at; more where they would hold over MAX_ROWS_PER_RANGE rows each, fewer for small tables. They
#: bound what the driver holds: a few numbers for each range and each sampled key.
RANGES = 512
MAX_ROWS_PER_RANGE = 2_000_000
MIN_ROWS_PER_RANGE = 64
SAMPLES_PER_RANGE = 24
#: A range is overfull when it holds this many times its share of the bytes.
OVERFULL = 2.0
ROUNDS = 3
SEED = 20_011


def _uniform(key: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the key alone, so that a rerun or a retried task draws the same sample."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _splitters(ranged: DataFrame, share: float, salt: int) -> set:
    """Keys that cut each range of ``ranged`` (key, size, range) into pieces of about ``share`` bytes, from a sample in
    which a record's chance follows its size: SAMPLES_PER_RANGE keys are expected for each piece."""
    each = F.lit(share / SAMPLES_PER_RANGE)
    drawn = ranged.filter(_uniform(F.col("key"), salt) < F.col("size") / each)
    out, last, seen = set(), None, 0.0
    for k in drawn.select("range", "key", F.greatest(F.col("size"), each).alias("bytes")).orderBy("range", "key").collect():
        if k["range"] != last:
            last, seen = k["range"], 0.0
        seen += k["bytes"]
        if seen > share:
            out.add(tuple(k["key"]))
            seen = 0.0
    return out


def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("h", "d", "r"), key, strict=True)])


def _range_of(key: Column, splitters: list) -> Column:
    """Number of splitters at or below the key, by binary search."""
    if not splitters:
        return F.lit(0)
    table, n = F.array(*[_literal(s) for s in splitters]), len(splitters)
    steps = [1 << b for b in reversed(range(n.bit_length()))]
    step = lambda at, by: F.when((at + by <= n) & (F.get(table, at + by - 1) <= key), at + by).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _sums(ranged: DataFrame) -> list:
    return ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").collect()


def range_shards(records: DataFrame, key: Column, size: Column, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """``records`` with size, shard (int) and slot (long, gapless from 0 within the shard).

    ``key`` is a struct of three longs that orders the records; shards are consecutive pieces of that order whose
    bytes are as equal as whole records allow: a record lies in the shard in which its middle byte falls. Equal keys
    are ordered arbitrarily. A shard may be empty where there are fewer records than shards. An empty table gives no
    rows. Columns named size, shard or slot are replaced.
    """
    names = {"size", "shard", "slot", "key", "range"}
    sized = written(records.select(*[records[f"`{c}`"] for c in records.columns if c.lower() not in names], key.alias("key"), size.alias("size")), "sized")
    whole = sized.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = whole["bytes"] or 0
    if not total:
        return sized.drop("key").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    share = total / max(1, min(max(ranges, whole["rows"] // MAX_ROWS_PER_RANGE), whole["rows"] // MIN_ROWS_PER_RANGE))
    splitters: list = []
    ranged = sized.withColumn("range", F.lit(0))
    sums = [{"range": 0, "bytes": total, "rows": whole["rows"]}]
    for again in range(ROUNDS):
        over = [s["range"] for s in sums if s["bytes"] > OVERFULL * share and s["rows"] > MIN_ROWS_PER_RANGE]
        finer = sorted(_splitters(ranged.filter(F.col("range").isin(over)), share, SEED + again).union(splitters)) if over else splitters
        if len(finer) == len(splitters):
            break
        splitters = finer
        ranged = sized.withColumn("range", _range_of(F.col("key"), splitters))
        sums = _sums(ranged)
    bases, b, r = [], 0, 0
    for s in sums:
        bases.append((s["range"], b, r))
        b, r = b + s["bytes"], r + s["rows"]
    spark = records.sparkSession
    base = F.broadcast(spark.createDataFrame(bases, "range int, base_bytes long, base_rows long"))  # one row per range
    within = Window.partitionBy("range").orderBy("key")
    placed = ranged.withColumn("_end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(within))
    placed = placed.join(base, "range")
    middle = 2 * (F.col("base_bytes") + F.col("_end")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * total))).cast("int")
    placed = placed.select(*sized.columns, shard.alias("shard"), (F.col("base_rows") + F.col("_n") - 1).alias("_place"))
    placed = written(placed, "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("_place").alias("_first")))  # one row per shard
    return placed.join(first, "shard").withColumn("slot", F.col("_place") - F.col("_first")).drop("_place", "_first", "key")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Every row of ``docs`` in a shard by the law ``bytes``, without its text.

    Records are ordered by a hash of their text, then key, then a hash of all columns: equal texts lie side by side
    and so share a shard unless a shard ends among them, and a group of copies of any size is cut between its keys.
    Rows equal in every column are told apart by a number that a written table fixes, so that repeats at will are cut too.
    Keys of any type are taken (those that are no whole numbers by a hash). Shard ends come from exact prefix sums; the
    sampled splitters deal out the ranges in which these are taken. Size is the UTF-8 bytes plus 1; a null text counts
    as empty, a null key comes before all others. An empty table gives no rows.
    """
    t, k = docs[f"`{text}`"], docs[f"`{key}`"]
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = k.cast("long") if whole else F.xxhash64(k)
    slim = docs.select(
        k.alias("doc_id"),
        F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"),
        (n_bytes(t) + 1).alias("_size"),
        F.struct(F.xxhash64(F.coalesce(t, F.lit(""))).alias("h"), number.alias("d"), F.monotonically_increasing_id().alias("r")).alias("_key"),
    )
    out = range_shards(slim, F.col("_key"), F.col("_size"), shards).drop("_size", "_key")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
