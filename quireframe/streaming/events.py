"""Event-time helpers and stateful operators, for batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """Counts and sums by hour and type; with ``late``, a watermark that closes an hour on a stream."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def stable_files(snapshots: DataFrame, processed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Watch folder: poll and name of files whose signature is that of the poll before and was no candidate yet. A file
    that vanishes for a poll starts anew. Files that are ``processed`` with that signature (name, signature) are left out,
    and of a poll's files the first ``most`` by name are taken."""
    w = Window.partitionBy("name").orderBy("poll")
    same = (F.lag("signature").over(w) == F.col("signature")) & (F.lag("poll").over(w) == F.col("poll") - 1)
    run = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w)
    each = snapshots.withColumn("_run", run).withColumn("_n", F.row_number().over(Window.partitionBy("name", "_run").orderBy("poll")))
    found = each.filter("_n = 2").select("poll", "name", "signature")
    if processed is not None:
        found = found.join(processed.select("name", "signature"), ["name", "signature"], "left_anti").select("poll", "name", "signature")
    if most is not None:
        found = found.withColumn("_k", F.row_number().over(Window.partitionBy("poll").orderBy("name"))).filter(F.col("_k") <= most).drop("_k")
    return found


def stable_files_stream(snapshots: DataFrame) -> DataFrame:
    """The same on a stream: state per name is the last poll, its signature and whether it was reported. A name that gives no
    poll for an hour of processing time is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        poll, signature, reported = state.get if state.exists else (-2, "", False)
        out = []
        for rows in batches:
            for r in rows.sort_values("poll").itertuples():
                same = r.poll == poll + 1 and r.signature == signature
                if same and not reported:
                    out.append((r.poll, key[0], r.signature))
                poll, signature, reported = r.poll, r.signature, same
        state.update((int(poll), signature, bool(reported)))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(out, columns=["poll", "name", "signature"])

    return snapshots.groupBy("name").applyInPandasWithState(step, "poll int, name string, signature string", "poll int, signature string, reported boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
