"""Concatenate-and-cut packing (operator 5).

Pass one tokenizes each document once and writes its ids with their place in the partition's token stream; the
partitions' totals, summed up in order, turn places into global offsets. Pass two cuts the stream at every multiple of
the sequence length: a document that crosses a cut lies in several pieces, and each sequence's boundary records say
which piece lies where.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm.bpe import SPLIT, Vocabulary
from quireframe.llm.shared import broadcast_if_small, written
from quireframe.session import ship_code

LENGTH = 2048
END_ID = 1
BYTES_PER_ID = 4
#: Partition totals up to this number are broadcast (16 bytes each).
BROADCAST_PARTITIONS = 1_000_000

_of_worker: dict[str, Callable[[str], bytes]] = {}
_run_of_space = re.compile(r"\s\s")


def _encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids (little-endian, unsigned, 32 bits) by the tokenizer file at ``path``.

    A byte-level vocabulary whose ids follow the order of its merges is given to the faster of the two libraries, which
    then makes the same ids; any other file goes to the ``tokenizers`` library.
    """
    vocabulary = Vocabulary(path)
    if not vocabulary.ids_follow_merges:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    import tiktoken

    made = {"mergeable_ranks": vocabulary.token_bytes, "special_tokens": vocabulary.added}
    exact = tiktoken.Encoding("exact", pat_str=SPLIT, **made)
    # Without a run of white space the look-ahead never matters, and a pattern without one is matched faster.
    single = tiktoken.Encoding("single", pat_str=SPLIT.replace(r"\p{White_Space}+(?!\P{White_Space})|", ""), **made)
    return lambda text: (exact if _run_of_space.search(text) else single).encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def encode(text: str, path: str) -> bytes:
    """The ids of a text as the library gives them, without begin, end or added special tokens; strings of special
    tokens inside the text become these, which is the library's default."""
    if path not in _of_worker:
        _of_worker[path] = _encoder(path)
    return _of_worker[path](text)


def token_stream(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (binary, with ``end_id`` last), doc_tokens, part and place: where in its partition's stream the
    document starts. A null text is an empty one: its only id is ``end_id``."""
    ship_code(docs.sparkSession)
    end = np.uint32(end_id).astype("<u4").tobytes()

    slim = docs.select(docs[f"`{key}`"].alias("doc_id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [encode(t, path) + end for t in b.column("text").to_pylist()]
            n = np.fromiter((len(x) // BYTES_PER_ID for x in ids), dtype="int64", count=len(ids))
            ends = place + np.cumsum(n)
            columns = [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array([part] * len(ids), pa.int32()), pa.array(ends - n)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "doc_tokens", "part", "place"])
            place = int(ends[-1]) if len(ends) else place

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids binary, doc_tokens long, part int, place long")


def with_offsets(stream: DataFrame) -> DataFrame:
    """``stream`` with the global offset of each document: prefix sums over the partitions' totals."""
    totals = stream.groupBy("part").agg(F.sum("doc_tokens").alias("n"))  # one row a task
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    base = broadcast_if_small(written(base, "pack-bases"), BROADCAST_PARTITIONS)
    return stream.join(base, "part").withColumn("at", F.col("base") + F.col("place")).drop("part", "place", "base")


def cut(stream: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces of ``with_offsets``: doc_id, start, length, ids, doc_tokens, sequence_id and offset."""
    first, last = F.col("at"), F.col("at") + F.col("doc_tokens") - 1
    each = stream.withColumn("sequence_id", F.explode(F.sequence(F.floor(first / length), F.floor(last / length))))
    begins = F.greatest(first, F.col("sequence_id") * length)
    ends = F.least(last + 1, (F.col("sequence_id") + 1) * length)
    each = each.withColumn("start", begins - first).withColumn("length", ends - begins).withColumn("offset", begins - F.col("sequence_id") * length)
    ids = F.substring(F.col("ids"), (F.col("start") * BYTES_PER_ID + 1).cast("int"), (F.col("length") * BYTES_PER_ID).cast("int"))
    return each.withColumn("ids", ids).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """All documents, concatenated in the order in which they are stored and cut every ``length`` ids: the pieces.

    A null text is an empty one, whose only id is the end's. Rows that repeat or share a key, null ones too, are packed once
    each. An empty table gives no rows. Only the last sequence can be
    short; it is the one that ``sequences`` pads.
    """
    return cut(with_offsets(written(token_stream(docs, path, key, text), "tokens")), length)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """One row per sequence: its ids (binary, padded to ``length`` ids unless their number is a power of two) and the
    boundary records of its pieces in order. A sequence has at most ``length`` pieces."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    each = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    each = each.withColumn("n", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(length) - F.col("n")).cast("int")))
    ids = F.when(F.bit_count("n") == 1, ids).otherwise(F.concat(ids, pad))
    records = F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length")))
    return each.select("sequence_id", F.col("n").alias("n_tokens"), ids.alias("ids"), records.alias("boundaries"))
