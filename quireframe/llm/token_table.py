"""Byte-pair encoding and decoding by a table of distinct words (operator 11).

Rows are cut into words, and runs of rows are put together as blocks. A block keeps its distinct words once, and of each row
only their numbers, in order. All blocks' distinct words are dealt out by a hash into cells; a cell encodes each of its words
once, whatever blocks it comes from, and hands each block the ids of its words in the order in which they came. Numbers then
tell where ids go. So what is shuffled is some compressed bytes a word, not a row a word, and a word that every text holds is
met once a block. Decoding joins ids with the vocabulary's pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireframe.llm.bpe import Vocabulary, split_words
from quireframe.llm.shared import new_path
from quireframe.session import ship_code

#: A block ends with the row that brings it to so many words or distinct words.
BLOCK_WORDS, BLOCK_DISTINCT = 2_000_000, 250_000
#: Words of all blocks that a cell has, about.
CELL_WORDS = 200_000
#: Longer texts are split into words a stretch at a time.
STRETCH = 1 << 20

_of_worker: dict[str, object] = {}


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """``text`` cut where a character that is no white space meets a blank, tab or line end: no word goes on there, and what is
    before or after does not change how the other side is split. Without such a place a stretch goes on."""
    start = 0
    while len(text) - start > most:
        at = start + most
        while at < len(text) and not (text[at] in " \t\n\r" and not text[at - 1].isspace()):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


def words_of(text: str, vocabulary: Vocabulary, most: int = STRETCH) -> Iterator[list[str]]:
    """The words that are merged each for itself, in order, a stretch at a time; an added token is a word."""
    for i, part in enumerate(vocabulary.parts(text)):
        if i % 2:
            yield [part]
        elif part:
            for stretch in stretches(part, most):
                yield split_words(stretch)


def _vocabulary(path: str) -> Vocabulary:
    key = "vocabulary " + path
    if key not in _of_worker:
        _of_worker[key] = Vocabulary(path)
    return _of_worker[key]


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _of_worker:
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _of_worker[path] = made
    return _of_worker[path]


def packed(arrays: list[np.ndarray], rest: bytes = b"") -> bytes:
    """Whole numbers below 2^32, several arrays of one length, and bytes, compressed. Numbers are written a byte of all of them
    after the other, as the higher ones are mostly zero."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(n, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([n, len(arrays)], "<u4").tobytes(), *planes, rest]))


def unpacked(data: bytes) -> tuple[list[np.ndarray], bytes]:
    """What ``packed`` was given."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, k = np.frombuffer(raw, "<u4", 2).tolist()
    planes = np.frombuffer(raw, np.uint8, 4 * n * k, 8).reshape(k, 4, n)
    return [np.ascontiguousarray(p.T).view("<u4").reshape(n) for p in planes], raw[8 + 4 * n * k :]


def packed_words(words: list[bytes]) -> bytes:
    return packed([np.fromiter(map(len, words), np.int64, len(words))], b"".join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    (lengths,), joined = unpacked(data)
    ends = np.cumsum(lengths, dtype=np.int64)
    return [joined[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def blocks(rows: DataFrame, path: str, most: int = BLOCK_WORDS, distinct: int = BLOCK_DISTINCT, stretch: int = STRETCH) -> DataFrame:
    """Blocks of ``rows`` (key, text), written: block (long), words (packed, the distinct ones, most frequent first), n_words,
    numbers (packed, the word that stands at each place), keys and counts (arrays, one entry for each row)."""
    schema = T.StructType().add("block", "long").add("words", "binary").add("n_words", "long").add("numbers", "binary").add("keys", T.ArrayType(rows.schema["key"].dataType)).add("counts", T.ArrayType(T.LongType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        number: dict[str, int] = {}
        numbers, keys, counts, total = [], [], [], 0
        at = TaskContext.get().partitionId() << 33
        of_keys = None

        def block() -> pa.RecordBatch:
            all_numbers = np.concatenate([np.zeros(0, np.int32), *numbers])
            order = np.argsort(-np.bincount(all_numbers, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = list(number)
            words = [words[i].encode() for i in order.tolist()]
            columns = [[at], [packed_words(words)], [len(words)], [packed([rank[all_numbers]])], [keys], [counts]]
            types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(of_keys), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

        for batch in batches:
            of_keys = batch.schema.field("key").type
            for k, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                n = 0
                for found in words_of(text.as_py() or "", vocabulary, stretch):
                    numbers.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
                    n += len(found)
                keys.append(k)
                counts.append(n)
                total += n
                if total >= most or len(number) >= distinct or len(keys) >= most:
                    yield block()
                    number.clear()
                    numbers, keys, counts, total = [], [], [], 0
                    at += 1
        if keys:
            yield block()

    return _dealt_by(rows.select("key", "text").mapInArrow(cut, schema), "block")


def _dealt_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table in the shared folder that is dealt into buckets by ``key`` as a shuffle would be, so that what is joined
    on it comes to it and it need not be shuffled itself."""
    spark = df.sparkSession
    path = new_path(spark, "blocks")
    name = "blocks_" + path[-12:]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).option("compression", "none").format("parquet").saveAsTable(name)
    return spark.table(name)


def cells(cut: DataFrame, n: int) -> DataFrame:
    """The distinct words of each block dealt out into ``n`` cells by a hash: cell, block, words (packed), places (packed, where
    they stand among the block's)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                words = unpacked_words(data.as_py())
                cell = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % n
                order = np.argsort(cell, kind="stable")
                starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
                for i in np.split(order, starts[1:]) if len(order) else ():
                    row = [[int(cell[i[0]])], [block], [packed_words([words[x] for x in i.tolist()])], [packed([np.diff(i, prepend=0)])]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["cell", "block", "words", "places"])

    return cut.select("block", "words").mapInArrow(deal, "cell long, block long, words binary, places binary")


def encoded_cells(dealt: DataFrame, path: str) -> DataFrame:
    """For each block of each cell: block, places (as in ``cells``), ids (packed: how many ids each word has, then the ids). A
    cell's distinct words are encoded once each by the vocabulary's library."""

    def encode(cell: pa.Table) -> pa.Table:
        lists = [unpacked_words(x) for x in cell.column("words").to_pylist()]
        number: dict[bytes, int] = {}
        numbers = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in lists]
        words = [w.decode() for w in number]
        ids: list[list[int]] = []
        for start in range(0, len(words), 10_000):
            ids += [e.ids for e in _tokenizer(path).encode_batch_fast(words[start : start + 10_000], add_special_tokens=False)]
        many, flat = _joined(ids)
        out = []
        for of_block in numbers:
            n, i = _taken(many, flat, of_block)
            out.append(packed([n], packed([i])))
        return pa.table([cell.column("block"), cell.column("places"), pa.array(out, pa.binary())], ["block", "places", "ids"])

    return dealt.groupBy("cell").applyInArrow(encode, "block long, places binary, ids binary")


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many each list has, and all of them one after the other."""
    many = np.fromiter(map(len, ids), np.int64, len(ids))
    return many, np.fromiter((i for some in ids for i in some), np.uint32, int(many.sum()))


def _taken(many: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of those that ``many`` and ``flat`` tell, in the same form."""
    n = many[which]
    begins = np.cumsum(many) - many
    at = np.repeat(begins[which] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return n, flat[at]


def joined_back(cut: DataFrame, encoded: DataFrame) -> DataFrame:
    """key and ids (binary) of each row of the blocks ``cut``."""
    key = cut.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("key", key), T.StructField("ids", T.BinaryType())])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        places, many, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for p, x in zip(right.column("places").to_pylist(), right.column("ids").to_pylist(), strict=True):
            (n,), rest = unpacked(x)
            places.append(np.cumsum(unpacked(p)[0][0], dtype=np.int64))
            many.append(n.astype(np.int64))
            flat.append(unpacked(rest)[0][0])
        order = np.argsort(np.concatenate(places))
        (numbers,), _ = unpacked(left.column("numbers")[0].as_py())
        n, ids = _taken(np.concatenate(many), np.concatenate(flat), order[numbers])
        counts = np.array(left.column("counts")[0].as_py(), dtype=np.int64)
        # Bytes up to the end of each word, and so up to the end of each row.
        words_end = np.concatenate(([0], np.cumsum(n) * 4))
        data, offsets = ids.tobytes(), words_end[np.concatenate(([0], np.cumsum(counts)))]
        out = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.table([left.column("keys").combine_chunks().flatten(), pa.array(out, pa.binary())], ["key", "ids"])

    left = cut.select("block", "numbers", "keys", "counts")
    right = encoded.select(F.col("block").alias("of_block"), "places", "ids")
    return left.groupBy("block").cogroup(right.groupBy("of_block")).applyInArrow(gather, schema)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = BLOCK_WORDS, distinct: int = BLOCK_DISTINCT, cell: int = CELL_WORDS, stretch: int = STRETCH) -> DataFrame:
    """doc_id and ids (binary, 4 bytes each, little-endian) of every row, over whole texts.

    Ids are those of the library for the file at ``path`` without special tokens around a text; strings of added tokens
    inside it are one id each. A null or empty text has no ids; rows that repeat or have a null key keep a row each; an empty
    table gives no rows. ``most``, ``distinct``, ``cell`` and ``stretch`` bound memory and change no result."""
    ship_code(docs.sparkSession)
    cut = blocks(docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text")), path, most, distinct, stretch)
    words = cut.agg(F.sum("n_words")).first()[0] or 0
    encoded = encoded_cells(cells(cut, max(1, -(-words // cell))), path)
    return joined_back(cut, encoded).withColumnRenamed("key", "doc_id")


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``encoded`` (doc_id, ids: binary as above, or an array of int) with decoded (string): each id joined with its piece, in
    order, in the task that holds the row, as the pieces are as many as the vocabulary has whatever the table; bytes that are
    no UTF-8 are replaced. An id that the vocabulary lacks, or a null one, decodes to nothing, as do null and empty ids. No
    shuffle."""
    ship_code(encoded.sparkSession)
    rows = encoded.select(encoded[f"`{key}`"].alias("doc_id"), encoded[f"`{ids}`"].alias("ids"))
    of_key, of_ids = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        known = {i: b for b, i in vocabulary.token_bytes.items()} | {i: s.encode() for s, i in vocabulary.added.items()}
        piece = [known.get(i, b"") for i in range(max(known, default=-1) + 2)]  # the last one is for ids beyond it
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = []
                for row in some.column("ids"):
                    row = row.as_py() or b""
                    row = np.frombuffer(row, "<u4") if isinstance(row, bytes) else np.array([i for i in row if i is not None and i >= 0], np.int64)
                    texts.append(b"".join(map(piece.__getitem__, np.minimum(row, len(piece) - 1).tolist())).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(decode, f"doc_id {of_key}, ids {of_ids}, decoded string")


def digest_documents(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens (long) and the digests of ids and decoded text of ``decode_documents``."""
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
