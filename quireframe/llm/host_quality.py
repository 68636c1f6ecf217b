"""Host-level quality rules (operator 1).

Each document is measured natively; failures are summed per host with map-side partial sums, the hosts' failure
rates are shrunk towards an empirical beta prior, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm.shared import broadcast_if_small, words, written

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Hosts up to this number are broadcast (about 40 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 200_000


def with_base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null or empty text has no word: all counts are 0 and it fails. Whole texts are read, however long; the work
    per text is that of sorting its windows, and only texts in which some window repeats are sorted.
    Columns of these names in ``docs`` are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    taken = {c.lower() for c in names}
    rest = [f"`{c}`" for c in docs.columns if c.lower() not in taken]
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(*[docs[c] for c in rest], words(t).alias("_w"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_l"))
    step = step.select(
        *rest,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    at = lambda a, i: F.get(F.col(a), i)
    windows = F.when(
        F.size("_h") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[at("_h", i + k) for k in range(WINDOW)])),
    )
    step = step.withColumn("_g", windows).drop("_h")
    # The windows that occur more than once, as (hash, place) in order; null where all differ.
    ordered = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    step = step.withColumn("_s", ordered).drop("_g")
    same = lambda x, i, by: F.coalesce(F.get(F.col("_s"), i + by)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1))), lambda x: x["i"]))
    step = step.withColumn("_p", places).drop("_s")
    # Places p1 < p2 < ... cover min(5, gap) words each, the last 5.
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return step.withColumn("base_failed", failed).select(*rest, *names)


def host_counts(measured: DataFrame, host: str = "host") -> DataFrame:
    """One row per host (null is one host): n_docs and n_failed, summed within each task before the shuffle."""
    failed = F.col("base_failed").cast("long")
    return measured.groupBy(measured[f"`{host}`"].alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"))


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host_counts`` with each host's shrunk failure rate and host_kept (the rate is at most ``max_rate``).

    The beta prior is fitted to all hosts by the method of moments: its mean is the failure rate of all documents,
    its weight follows from how far the hosts' rates spread beyond what their sizes explain. Where they do not (or
    there is one host), the weight is the mean host's size. An empty table gives no rows.
    """
    rate = F.col("n_failed") / F.col("n_docs")
    all_hosts = counts.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n_docs") * rate * rate).alias("sq"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
    )
    n, mean = F.col("n"), F.col("f") / F.col("n")
    noise = mean * (1 - mean)
    between = F.greatest(F.col("sq") / n - mean * mean, F.lit(0.0))
    spread = (between - noise * (F.col("hosts") - 1) / n) / F.greatest(1 - F.col("nn") / (n.cast("double") * n), F.lit(1e-12))
    weight = F.when((spread > 0) & (noise > spread), noise / spread - 1).otherwise(n / F.col("hosts"))
    prior = all_hosts.select(mean.alias("prior_mean"), weight.alias("prior_weight")).first()  # two numbers
    m, w = F.lit(prior["prior_mean"] or 0.0), F.lit(prior["prior_weight"] or 0.0)
    shrunk = (F.col("n_failed") + m * w) / (F.col("n_docs") + w)
    return counts.withColumn("shrunk_rate", shrunk).withColumn("host_kept", shrunk <= max_rate)


def join_verdicts(measured: DataFrame, hosts: DataFrame, host: str = "host") -> DataFrame:
    """``measured`` with shrunk_rate, host_kept and kept. Few hosts are broadcast after a count; many are joined by
    shuffle on the host, where adaptive execution splits a hot one."""
    v = hosts.select(F.col("host").alias("_host"), "shrunk_rate", "host_kept")
    v = broadcast_if_small(v, BROADCAST_HOSTS)
    joined = measured.join(v, measured[f"`{host}`"].eqNullSafe(v["_host"]), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def score_documents(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures and verdict of every row of ``docs``, without its text.

    The measures are taken once and written to the shared folder; the hosts' sums and the result read that table.
    Rows that repeat and null keys keep a row each. An empty table gives no rows.
    """
    d = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{host}`"].alias("host"), docs[f"`{text}`"].alias("text"))
    measured = written(with_base_measures(d).drop("text"), "host-quality")
    return join_verdicts(measured, written(host_verdicts(host_counts(measured), max_rate), "hosts"))


def keep_documents(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose host is kept, with the columns of ``docs``.

    The documents are measured once and written with their base verdict; the hosts' sums and the result read that
    table. (A filter on the measures themselves would be pushed below them and evaluate them again and again.)
    """
    both = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{host}`"].alias("host"), docs[f"`{text}`"].alias("text"))
    measured = written(with_base_measures(both).select("row", "host", "base_failed"), "host-quality")
    hosts = written(host_verdicts(host_counts(measured), max_rate), "hosts")
    return join_verdicts(measured, hosts).filter("kept").select("row.*")
