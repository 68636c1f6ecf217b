"""N-gram Jaccard join by parity sketches (operator 6).

Texts are sets of word shingles. Each set is cut into blocks by a hash; a block is a small parity sketch that each member
toggles, so sets that differ in few members agree in some block. Sets are joined on agreeing blocks per size band. What
shares a block is compared by whole sketches, whose Hamming distance bounds the symmetric difference from below, and what
that leaves together exactly. Equal sets are one node from the start.

Blocks are taken a share at a time. What the first share has connected thins out the rest by identities alone, so that
sketches and members travel for few of the blocks that a large group of near copies has in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm.components import connected
from quireframe.llm.shared import broadcast_if_small, delete, discard, recorded, written
from quireframe.llm.shingles import block_keys, linked, parity, shingle_set, signature, sketch_bits
from quireframe.session import ship_code

SIZE, PERCENT = 3, 90
#: Sets, and members of these, that one unit of work compares; a larger group of candidates is cut into pairs of parts, so that all its pairs
#: are compared in bounded memory.
UNIT = 4_096
UNIT_MEMBERS = 4_000_000
#: One block in so many is taken in a round; the last round takes all.
SHARES = (64, 8, 1)
#: Units of up to so many rows in all are taken in one round.
ONE_ROUND = 200_000
#: Texts whose sets are wanted, up to this number, are found by a broadcast of their hashes (16 bytes each).
BROADCAST_TEXTS = 1_000_000
#: Nodes up to this number are broadcast with their roots, and rows of units with theirs (32 to 48 bytes each).
BROADCAST_NODES = 400_000
#: Texts that a task works on together.
AT_ONCE = 1_000
#: Sets that a task remembers having listed.
REMEMBERED = 500_000


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    ship_code(docs.sparkSession)
    x = F.coalesce(docs[f"`{text}`"], F.lit(""))
    return docs.select(docs[f"`{key}`"].alias("doc_id"), F.xxhash64(x).alias("t"), x.alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of a piece is small."""
    return (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE))


def _half(identity: bytes) -> int:
    return int.from_bytes(identity[:8], "little", signed=True)


def _listed(slim: DataFrame, size: int) -> DataFrame:
    """doc_id, t (hash of the text), n (members), id (the set's identity, null for the empty set) and c, half of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _texts(batches):
            n, ids = [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), size)
                n.append(len(s))
                ids.append(signature(s) if len(s) else None)
            c = pa.array([None if x is None else _half(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), c], ["doc_id", "t", "n", "id", "c"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, t long, n long, id binary, c long")


def _keys(slim: DataFrame, size: int, percent: int) -> DataFrame:
    """c and key: the blocks of each set, once a task for equal sets. They are made anew rather than stored with the
    sets, as they are as many bytes as the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _texts(batches):
            c, keys = [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), size)
                if (k := _half(signature(s))) not in seen:
                    seen.add(k)
                    keys.append(block_keys(s, percent))
                    c.append(np.full(len(keys[-1]), k, dtype=np.int64))
            if len(seen) > REMEMBERED:
                seen.clear()
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)), pa.array(np.concatenate(keys))], ["c", "key"])

    return slim.select("text").mapInArrow(run, "c long, key long")


def _members(keys: DataFrame) -> DataFrame:
    """key and c of the blocks that several sets have; the others are dropped after the one shuffle of all blocks. Of
    blocks with the same members one stays."""
    of_key = Window.partitionBy("key")
    shared = keys.select("key", "c", F.min("c").over(of_key).alias("lo"), F.max("c").over(of_key).alias("hi")).filter("lo < hi")
    every = written(shared.select("key", "c").distinct(), "nd-shared")
    h = lambda seed: F.sum(F.xxhash64("c", F.lit(seed)).cast("decimal(38,0)"))
    blocks = every.groupBy("key").agg(F.count("*").alias("size"), h(0).alias("h1"), h(1).alias("h2"))
    once = blocks.groupBy("size", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    members = written(every.join(once, "key", "left_semi"), "nd-members")
    discard(every)
    return members


def _sets(slim: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """num (a number of its own), id, c, n, members (array) and sketch of the sets of ``wanted`` (t, k: the text and key of
    one row of each): a second reading, of these rows only. Rows that repeat both are told apart no further, so that a set
    can be there twice; then one of each is kept by a shuffle."""
    w = broadcast_if_small(wanted, BROADCAST_TEXTS)
    slim = slim.join(w, (slim["t"] == w["t"]) & slim["doc_id"].eqNullSafe(w["k"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _texts(batches):
            ids, sets, sketches = [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), size)
                ids.append(signature(s))
                sets.append(s.view(np.int64))
                sketches.append(parity(s, sketch_bits(len(s))).tobytes())
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(list(map(_half, ids)), pa.int64()), n, pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "c", "n", "members", "sketch"])

    found = slim.mapInArrow(run, "id binary, c long, n long, members array<long>, sketch binary")
    sets = written(found.withColumn("num", F.monotonically_increasing_id()), "nd-sets")
    if sets.count() > wanted.count():
        every, sets = sets, written(sets.dropDuplicates(["id"]), "nd-sets")
        discard(every)
    return sets


def _in_parts(each: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of units (num, n, root) with the part of its unit that each set is in: units of too many sets, or too many
    members of these, have several."""
    parts = each.groupBy(*unit).agg(F.greatest(F.ceil(F.count("*") / UNIT), F.ceil(F.sum("n") / UNIT_MEMBERS)).cast("int").alias("parts"))
    parts = broadcast_if_small(written(parts.filter("parts > 1"), "nd-parts"), BROADCAST_NODES)
    cut = each.join(parts, unit, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return cut.select(F.xxhash64(*unit).alias("unit"), F.pmod(F.xxhash64("num", *unit), "parts").cast("int").alias("part"), "parts", "num", "root")


def _links(units: DataFrame, sets: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links a, b that connect the sets of each unit as all its links would, but for what ``root`` says is connected. Parts
    meet two and two: a row goes to each pair of parts that its own belongs to. Units are read one after the other from
    sorted partitions."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    of_set = ["n", "sketch", *(["members"] if exact else [])]
    rows = units.withColumn("other", other).select("unit", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "num", "root")
    rows = broadcast_if_small(written(rows, "nd-rows"), BROADCAST_NODES)
    rows = sets.select("num", *of_set).join(rows, "num").repartition("unit", "low", "high").sortWithinPartitions("unit", "low", "high", "num")

    def pairs(t: pa.Table) -> np.ndarray:
        num, part, n, root = (t[x].to_numpy() for x in ("num", "part", "n", "root"))
        sketches = [np.frombuffer(x, np.uint64) for x in t["sketch"].to_pylist()]
        whole = [np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in t["members"]] if exact else None
        at = linked(n, sketches, percent, root, whole, part == part[0] if part.min() != part.max() else None)
        return num[np.array(at, dtype=np.int64).reshape(-1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None or not len(t):
                continue
            keys = np.column_stack([t[x].to_numpy() for x in ("unit", "low", "high")])
            starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(t)]
            whole = starts if b is None else starts[:-1]  # the last unit may go on in the next batch
            out = [pairs(t.slice(x, y - x)) for x, y in zip(whole[:-1], whole[1:], strict=True) if y - x > 1]
            held = t.slice(starts[-2])
            if out:
                found = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _roots(links: DataFrame) -> DataFrame:
    """node and root of what ``links`` connect."""
    return written(connected(links), "nd-roots")


def _contracted(each: DataFrame, unit: list[str], sets: DataFrame, percent: int, exact: bool) -> DataFrame:
    """node and root of what the links of all units (``unit``, num, n) connect. Units are taken a share at a time; of those
    that follow only the ones that hold sets not connected yet are compared, which their numbers alone tell."""
    roots = None
    for share in SHARES if each.count() > ONE_ROUND else (1,):
        some = each.filter(F.pmod(F.xxhash64(*unit), F.lit(share)) == 0)
        if roots is None:
            some = some.withColumn("root", F.col("num"))
        else:
            known = broadcast_if_small(roots.select(F.col("node").alias("num"), "root"), BROADCAST_NODES)
            some = some.join(known, "num", "left").withColumn("root", F.coalesce("root", "num"))
            open_ = some.groupBy(*unit).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select(*unit)
            some = some.join(broadcast_if_small(written(open_, "nd-units-open"), BROADCAST_NODES), unit, "left_semi")
        some = written(some, "nd-open")
        links = _links(_in_parts(some, unit), sets, percent, exact)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = _roots(links)
        discard(some)
    return roots


def _components(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """``document_components`` with root, which tells components apart (null: the empty set), as a written table."""
    slim = _slim(docs, key, text)
    with recorded() as paths:
        listed = written(_listed(slim, size), "nd-listed")
        members = _members(_keys(slim, size, percent))
        wanted = listed.select("c", "id", "t", "doc_id").join(members.select("c").distinct(), "c", "left_semi")
        wanted = wanted.groupBy("id").agg(F.min(F.struct("t", "doc_id")).alias("r")).select("r.t", F.col("r.doc_id").alias("k"))
        sets = _sets(slim, written(wanted, "nd-wanted"), size)
        each = written(members.join(sets.select("c", "num", "n"), "c").select("key", "num", "n"), "nd-units")
        discard(members)
        # Sketches thin out what shares a block; what they leave together is compared exactly, each set once, or block by
        # block where a group is too large for one unit.
        near = _contracted(each, ["key"], sets, percent, exact=False).select(F.col("node").alias("num"), F.col("root").alias("group"))
        near = near.join(sets.select("num", "n"), "num")
        sizes = near.groupBy("group").agg(((F.count("*") > UNIT) | (F.sum("n") > UNIT_MEMBERS)).alias("large"))
        near = written(near.join(sizes, "group"), "nd-near")
        few = near.filter(~F.col("large")).select(F.xxhash64("group").alias("unit"), F.lit(0).alias("part"), F.lit(1).alias("parts"), "num", F.col("num").alias("root"))
        roots = _roots(_links(few, sets, percent, exact=True))
        if near.filter("large").limit(1).count():
            many = written(each.join(near.filter("large").select("num", "group"), "num"), "nd-many")
            discard(each)
            roots = roots.unionByName(_contracted(many, ["key", "group"], sets, percent, exact=True))
        named = sets.select("num", "id")
        roots = roots.join(named.withColumnRenamed("num", "node"), "node").select("id", F.col("root").alias("num")).join(named.select("num", F.col("id").alias("root")), "num").select("id", "root")
        known = broadcast_if_small(written(roots, "nd-linked"), BROADCAST_NODES)
        rows = listed.select("doc_id", "t", F.col("n").alias("n_shingles"), "id")
        rows = rows.join(known, "id", "left").withColumn("root", F.coalesce("root", "id")).drop("id")
        least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
        least = written(least.select("root", "least"), "nd-least")
        joined = rows.join(broadcast_if_small(least, BROADCAST_NODES), "root", "left")
        out = written(joined.select("doc_id", "t", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "root"), "nd-components")
    delete(docs.sparkSession, [p for p in paths if p != out._written_to])
    return out


def document_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Every row of ``docs``: doc_id, t (hash of its text), n_shingles and component_id, the smallest doc_id that links
    reach from it, its own included.

    Two rows link when their sets of ``size``-word shingles share ``percent`` hundredths of their union. A text without
    words (or null) has an empty set and links with nothing. Rows that repeat a doc_id are rows of their own; a null
    doc_id is no component's smallest unless all are null. An empty table gives no rows. No link is lost: nothing is
    capped or sampled. Sets are told apart by 128 bits of hash.
    """
    return _components(docs, key, text, size, percent).drop("root")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each component, that of the smallest key (a null key is the largest), and of
    the smallest hash of its text where several rows share that key; all columns as they are.

    Rows that repeat both the key and the text of the one that stays go too, whatever their other columns hold. Null and
    empty texts, and texts without words, are in no component and all stay. An empty table gives no rows.
    """
    found = _components(docs, key, text, size, percent)
    place = F.struct(F.col("doc_id").isNull().alias("no_key"), "doc_id", "t")
    first = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    first = broadcast_if_small(written(first, "nd-first"), BROADCAST_NODES)
    gone = found.join(first, "root").filter(place != F.col("first")).select("doc_id", "t").distinct()
    x = F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit("")))
    g = broadcast_if_small(written(gone, "nd-gone"), BROADCAST_TEXTS)
    left = docs.join(g, docs[f"`{key}`"].eqNullSafe(g["doc_id"]) & (x == g["t"]), "left_anti")
    kept = found.filter("root IS NOT NULL").join(first, "root").filter(place == F.col("first"))
    twice = written(kept.groupBy("doc_id", "t").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", "t"), "nd-again")
    if not twice.limit(1).count():
        return left
    same = lambda d: d[f"`{key}`"].eqNullSafe(twice["doc_id"]) & (F.xxhash64(F.coalesce(d[f"`{text}`"], F.lit(""))) == twice["t"])
    again = left.join(twice, same(left), "left_semi").dropDuplicates([key, text])
    return left.join(twice, same(left), "left_anti").unionByName(again)
