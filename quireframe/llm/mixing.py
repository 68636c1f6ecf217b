"""Mixing sources to target weights by pivotal dependent rounding (operator 7).

A source's target over its size is each document's expected number of copies. The whole part is taken; the fractional
parts are rounded by the pivotal method: two documents transfer mass at random until one holds 0 or 1. Chunks of documents are folded
side by side, each leaves one residual, and the residuals meet in the next level of a reduction tree. Mass is counted in
words, so that each transfer keeps a source's expected words and only its last residual moves the sum: by half the size
of one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.llm.shared import broadcast_if_small, n_words, ranked, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
#: Documents folded in one chunk, about; a level of the tree shrinks the residuals by this factor.
CHUNK = 256
#: Rows that repeat are numbered so many at a time.
SHARE_ROWS = 8_192
#: Sources up to this number are broadcast (about 50 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 200_000
#: Rows up to this number are told by a broadcast how often they are taken (12 bytes each), so that texts stay where they
#: lie; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
SEED = 70_007
TINY = 1e-9


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target.

    Sources in code point order, null last, take the weights in turn and divide ``share`` times all sizes by them; a
    target above ``cap`` times its source's size is set to that and the excess reshared by weight until none is above.
    Sources may be many: they are numbered by ranges of their order, and a round of resharing is one aggregation.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    s = ranked(sizes, F.col("source").isNull(), F.encode("source", "UTF-8"), name="_rank").withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(cap)).drop("_rank")
    s = written(s, "mix-weights")
    level, full = 0.0, -1
    while True:  # the level, the target per weight, only rises; each round but the last caps a source more
        capped = F.col("_cap") <= F.col("_w") * level
        r = s.agg(F.sum("source_size").alias("all"), F.count_if(capped).alias("full"), F.sum(F.when(capped, F.col("_cap"))).alias("given"), F.sum(F.when(~capped, F.col("_w"))).alias("weight")).first()
        if r["full"] == full or not r["weight"]:
            break
        full, level = r["full"], max(level, (r["all"] * float(share) - (r["given"] or 0.0)) / r["weight"])
    return s.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * level).alias("target"))


def _unit(*parts) -> Column:
    """A number in [0, 1) drawn from the contents of the rows."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _transfer(state: Column, b: Column) -> Column:
    """One pivotal step between the open element of ``state`` and ``b``: words move from one to the other, in a random
    direction that keeps both expectations, until one holds 0 or 1 copies and is settled."""
    a = state["open"]
    to_a = F.least((1 - a["p"]) * a["s"], b["p"] * b["s"])
    to_b = F.least(a["p"] * a["s"], (1 - b["p"]) * b["s"])
    up = _unit(a["h"], b["h"], F.lit(SEED)) * (to_a + to_b) < to_b
    moved = F.when(up, to_a).otherwise(-to_b)
    a_settles = F.when(up, (1 - a["p"]) * a["s"] <= b["p"] * b["s"]).otherwise(a["p"] * a["s"] <= (1 - b["p"]) * b["s"])
    p = F.when(a_settles, b["p"] - moved / b["s"]).otherwise(a["p"] + moved / a["s"])
    # When a settles it got all it could take (1) or gave all it had (0); when b does, the other way round.
    copies = F.when(a_settles == up, 1).otherwise(0)
    stays, settled = F.when(a_settles, b).otherwise(a), F.when(a_settles, a).otherwise(b)
    still = F.struct(stays["h"].alias("h"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), stays["s"].alias("s"), stays["row"].alias("row"))
    return F.struct(still.alias("open"), F.concat(state["done"], F.array(F.struct(settled["row"].alias("row"), copies.alias("up")))).alias("done"))


def _fold(elements: DataFrame) -> DataFrame:
    """``elements`` (source, chunk, e) folded chunk by chunk: source, chunk, open (the residual) and done."""
    lists = elements.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("e")).alias("all"))
    first = F.get("all", 0)
    none = F.filter(F.array(F.struct(first["row"].alias("row"), F.lit(0).alias("up"))), lambda x: F.lit(False))
    folded = F.aggregate(F.slice("all", 2, F.size("all")), F.struct(first.alias("open"), none.alias("done")), _transfer)
    return lists.select("source", "chunk", folded.alias("f")).select("source", "chunk", "f.open", "f.done")


def pivotal_rounding(rows: DataFrame) -> DataFrame:
    """``rows`` (source, row, size over 0, p in 0 to 1, parts) with up, 0 or 1: one row each of row and up.

    ``row`` tells the rows apart and must be orderable; draws depend on the contents of the rows alone, so reruns
    agree. ``parts`` is the number of first-level chunks of the source. The sum of p * size of a source is kept but
    for its last residual, which goes to the nearer whole number.
    """
    h = F.xxhash64("row", F.lit(SEED))
    e = F.struct(h.alias("h"), "p", F.col("size").cast("double").alias("s"), "row")
    level = rows.select("source", F.pmod(h, F.col("parts")).alias("chunk"), e.alias("e"))
    chunks = rows.agg(F.max("parts")).first()[0] or 1
    settled = []
    while True:
        folded = written(_fold(level), "mix-level")
        settled.append(folded.select(F.explode("done").alias("d")).select("d.*"))
        if chunks <= 1:
            break
        level = folded.select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), F.col("open").alias("e"))
        chunks = -(-chunks // CHUNK)
    out = folded.select("open.row", (F.col("open.p") >= 0.5).cast("int").alias("up"))
    for s in settled:
        out = out.unionByName(s)
    return out


def mix_rows(slim: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``slim`` (row, source, size) with source_size, target and copies (int, at most MAX_COPIES).

    Rows of size 0 are taken no time; a source without words has target 0. An empty table gives no rows.
    """
    sources = written(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("_n")), "mix-sources")
    targets = source_targets(sources.drop("_n"), weights, share).withColumnRenamed("source", "_source")
    targets = targets.join(sources.select(F.col("source").alias("_s"), F.ceil(F.col("_n") / CHUNK).alias("parts")), F.col("_s").eqNullSafe(F.col("_source"))).drop("_s")
    targets = broadcast_if_small(written(targets, "mix-targets"), BROADCAST_SOURCES)
    both = slim.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.when(F.col("size") > 0, F.floor(ratio + TINY)).otherwise(0).cast("int")
    both = both.withColumn("_base", base).withColumn("p", F.when(F.col("size") > 0, ratio - F.col("_base")).otherwise(0.0))
    both = written(both, "mix-rows")
    whole = both.filter(F.col("p") <= TINY).withColumn("copies", F.col("_base"))
    open_ = both.filter(F.col("p") > TINY)
    packed = open_.select("source", "size", "p", "parts", F.struct("row", "source", "size", "source_size", "target", "_base").alias("row"))
    rounded = pivotal_rounding(packed).select("row.*", "up").withColumn("copies", F.col("_base") + F.col("up"))
    cols = ["row", "source", "size", "source_size", "target", "copies"]
    return whole.select(*cols).unionByName(rounded.select(*cols))


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, size (words), source_size, target and taken (words taken, repeats counted).

    A null text has no word and, as any row without words, is taken no time; a null source is a source. Rows that repeat
    or have a null key are rows of their own. An empty table gives no rows.
    """
    slim = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{source}`"].alias("source"), n_words(docs[f"`{text}`"]).alias("size"))
    mixed = mix_rows(written(_told_apart(slim), "mix-sizes"))
    return mixed.select(F.col("row.key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _told_apart(slim: DataFrame) -> DataFrame:
    """``slim`` (key, source, size) as row (key and number), source and size. Rows that repeat are the same to the mix, so they
    are counted, which tasks first do each for its own, and numbered from 0; many are numbered a share at a time, the shares
    dealt out, so that neither a task nor a chunk has all of them."""
    counted = slim.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    shares = counted.withColumn("share", F.explode(F.expr(f"sequence(0, (n - 1) div {SHARE_ROWS})")))
    dealt = shares.filter(f"n <= {SHARE_ROWS}").unionByName(shares.filter(f"n > {SHARE_ROWS}").repartition("key", "size", "share"))
    number = F.explode(F.expr(f"sequence(share * {SHARE_ROWS}, least((share + 1) * {SHARE_ROWS}, n) - 1)"))
    return dealt.select("key", "source", "size", number.alias("number")).select(F.struct("key", "number").alias("row"), "source", "size")


def take_documents(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0, 1 or 2 times), with the columns of ``docs``.

    The rows are written once with a number each, so that rows that repeat are told apart. Rows without words are taken
    no time; a null source is a source. An empty table gives no rows.
    """
    numbered = written(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs[f"`{source}`"].alias("source"), n_words(docs[f"`{text}`"]).alias("size"), F.monotonically_increasing_id().alias("row")), "mix-docs")
    copies = mix_rows(numbered.select("row", "source", "size")).filter("copies > 0").select("row", "copies")
    return numbered.join(broadcast_if_small(written(copies, "mix-copies"), BROADCAST_ROWS), "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("doc.*")
