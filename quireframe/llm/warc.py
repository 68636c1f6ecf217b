"""WARC archives: writing captures, reading records and assembling transactions (operator 4).

Each page becomes a request, a response (or revisit) and a metadata record. Reading gives one row per record; the records
of one capture find each other through their concurrent-to identifiers and come out as one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.llm.shared import broadcast_if_small, delete, new_path, recorded, written
from quireframe.session import ship_code

#: Bytes after which a file ends, and after which a split of it does, so that a reader's task holds a bounded part of one.
FILE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
#: Payloads with copies up to this number are broadcast (about 70 bytes each); more are joined by shuffle.
BROADCAST_PAYLOADS = 200_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The digits of base 32 in numbers and in digests.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SPLIT = "file string, start long, length long, captures long"

RECORD = (
    "record_type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, "
    "content_type string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def base32_sha1(text: Column) -> Column:
    """SHA-1 of a text's UTF-8 bytes in upper-case base 32: 160 bits are 32 digits, made 60 bits at a time."""
    h = F.sha1(text)
    part = lambda at, n: F.lpad(F.conv(F.substring(h, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), DIGITS, BASE32)


def _urn(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind} "), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC record as a gzip member of its own. A header whose value is null is left out."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("Content-Length", str(len(block)))] if v is not None)
    whole = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31) if len(whole) > 1024 else zlib.compressobj(6, zlib.DEFLATED, 26, 3)
    return pack.compress(whole) + pack.flush()


def _capture(k: str | None, uri: str | None, payload: bytes, digest: str, of: str | None, ids: tuple[str, str, str]) -> bytes:
    """The request, response (revisit of ``of``) and metadata records of a page."""
    request, answer, metadata = ids
    _, host, at = re.match(r"([a-z]+://([^/?#]*)|)([^#]*)", uri or "", re.DOTALL).groups() if re.match("[a-z]+://", uri or "") else (None, "", "")
    get = f"GET {at if at.startswith('/') else '/' + at} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target, same, kind = ("WARC-Target-URI", uri), ("WARC-Concurrent-To", answer), ("Content-Type", "application/http; msgtype=response")
    sha = ("WARC-Payload-Digest", f"sha1:{digest}")
    if of is None:
        second = _record("response", [("WARC-Record-ID", answer), target, sha, kind], http + payload)
    else:
        second = _record("revisit", [("WARC-Record-ID", answer), target, sha, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", of), kind], http)
    first = _record("request", [("WARC-Record-ID", request), target, same, ("Content-Type", "application/http; msgtype=request")], get)
    last = _record("metadata", [("WARC-Record-ID", metadata), target, same, ("Content-Type", "application/warc-fields")], b"" if k is None else f"page-id: {k}\r\n".encode())
    return first + second + last


def _at(uri: str) -> tuple[FileSystem, str]:
    """The file system and path of a URI; that of a plain path is the local one."""
    return FileSystem.from_uri(re.sub(r"^(?:file:)?/+", "file:///", uri))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write each row of ``pages`` as a capture into gzip files under ``path``, a member for each record, and return their
    splits: file, start, length and captures.

    Payloads are the UTF-8 bytes of ``html`` (null: none). Of the rows with equal payloads the one with the largest key
    is written as response, the others as revisit of it; among rows that share that key too, one is the response. A
    null key is the smallest. Rows are numbered once, in a written table, and told apart by that number. An empty table
    gives no files.

    Tasks write files of their own, named by attempt, where pyarrow's file systems reach; the splits that a task returns
    when it ends tell which files count, so that a lost or repeated attempt leaves nothing that is read.
    """
    ship_code(pages.sparkSession)
    payload = F.coalesce(pages[f"`{html}`"], F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(pages[f"`{url}`"], "\r", "%0D"), "\n", "%0A")
    rows = pages.select(pages[f"`{key}`"].alias("k"), uri.alias("uri"), payload.cast("binary").alias("p"), base32_sha1(payload).alias("d"), F.octet_length(payload).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "warc-pages")
    same = rows.groupBy("d", "n").agg(F.max(F.struct("k", "row")).alias("top"), F.count("*").alias("c")).filter("c > 1")
    same = written(same.select("d", "n", F.col("top.row").alias("of")), "warc-copies")
    both = rows.join(broadcast_if_small(same, BROADCAST_PAYLOADS), ["d", "n"], "left")
    revisit = F.when(F.col("of") != F.col("row"), _urn("response", F.col("of")))
    each = both.select(F.col("k").cast("string"), "uri", "p", "d", revisit.alias("of"), *[_urn(x, F.col("row")).alias(x) for x in ("request", "response", "metadata")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _at(path)
        fs.create_dir(root, recursive=True)
        out, name, task = None, "", TaskContext.get().taskAttemptId()
        files = at = start = n = 0

        def split() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "start": [start], "length": [at - start], "captures": [n]})

        for b in batches:
            for k, u, p, d, of, *ids in zip(*(b.column(c).to_pylist() for c in ("k", "uri", "p", "d", "of", "request", "response", "metadata")), strict=True):
                if out is None:
                    name, at, start, n = f"{task:08d}-{files:05d}.warc.gz", 0, 0, 0
                    out, files = fs.open_output_stream(f"{root}/{name}", compression=None), files + 1
                made = _capture(k, u, p, d, of, ids)
                out.write(made)
                at, n = at + len(made), n + 1
                if at >= FILE_BYTES:
                    out.close()
                    out = None
                if out is None or at - start >= SPLIT_BYTES:
                    yield split()
                    start, n = at, 0
        if out is not None:
            out.close()
            if n:
                yield split()

    return written(each.mapInArrow(run, SPLIT), "warc-splits")


def _blocks(source: io.RawIOBase) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a file or split, gzip (one or many members) or plain, read as it unpacks."""
    stream = io.BufferedReader(source, 1 << 16)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(_Unpacked(stream), 1 << 16)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        headers = []
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.append((name.strip().lower(), value.strip()))
        length = int(next((v for k, v in headers if k == "content-length"), "0"))
        yield headers, stream.read(length)


class _Split(io.RawIOBase):
    """``length`` bytes of an open file from ``start``."""

    def __init__(self, file, start: int, length: int):
        self.file, self.left = file, length
        file.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.file.read(min(len(buffer), self.left)) if self.left else b""
        buffer[: len(got)] = got
        self.left -= len(got)
        return len(got)


class _Unpacked(io.RawIOBase):
    """The plain bytes of a gzip stream, a buffer at a time."""

    def __init__(self, packed: io.BufferedReader):
        self.packed, self.unpack, self.rest = packed, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.unpack.eof:
                self.rest, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            give = self.rest or self.packed.read1(1 << 16)
            if not give:
                return 0
            out = self.unpack.decompress(give, len(buffer))
            self.rest = self.unpack.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)


def _parsed(headers: list[tuple[str, str]], block: bytes, with_payload: bool) -> dict:
    first = dict(reversed(headers))
    kind = first.get("warc-type", "")
    out = {"record_type": kind, "record_id": first.get("warc-record-id"), "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"], "refers_to": first.get("warc-refers-to"), "target_uri": first.get("warc-target-uri"), "content_type": first.get("content-type")}
    declared = (first.get("warc-payload-digest") or "").rpartition(":")[2] or None
    if kind in ("response", "revisit") and (out["content_type"] or "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            out |= {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload if with_payload else None}
        else:  # its payload lies elsewhere: the digest is declared, and the HTTP headers keep the length
            n = next((x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            out |= {"payload_bytes": int(n) if n is not None else None, "payload_digest": declared}
    elif out["content_type"] == "application/warc-fields":
        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x)
        out["fields"] = [(k.strip(), v.strip()) for k, _, v in pairs]
    return out


def read_archive(spark: SparkSession, path: str, with_payload: bool = True, splits: DataFrame | None = None) -> DataFrame:
    """One row per record of the files under ``path``: its type, identifiers, links, declared fields and, for responses,
    bytes and SHA-1 of the payload as read (revisits: as declared), and the payload if asked for.

    With ``splits`` (as ``write_archive`` gives them) these are read, a task each; else each file is a task's, which reads it
    as a stream."""
    ship_code(spark)
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    if splits is None:
        splits = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("start"), "length")
    tasks = max(1, min(splits.count(), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, length in zip(*(b.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                fs, at = _at(file)
                held, size = [], 0
                with fs.open_input_file(at) as f:
                    for headers, block in _blocks(_Split(f, start, length)):
                        held.append(_parsed(headers, block, with_payload))
                        size += len(held[-1].get("payload") or b"")
                        if len(held) >= 5000 or size > 1 << 24:
                            yield _batch(held)
                            held, size = [], 0
                yield _batch(held)

    def _batch(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in held], k) for n, k in zip(names, kinds, strict=True)], names)

    return splits.select("file", "start", "length").repartition(tasks).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (a response or revisit record), request, metadata, n_requests
    and n_metadata.

    Requests and metadata belong to the capture whose response they name as concurrent to, or whose response names
    them. Where several do, the one with the smallest identifier is shown and all are counted, so that no identifier
    can gather an unbounded row. A record that names none, or a response that is missing, gives a capture with what
    there is. Identifiers are unique by the format's rule. No records give no rows.
    """
    is_answer = F.col("record_type").isin("response", "revisit")
    whole = F.struct(*[F.col(c) for c in records.columns])
    answers = records.filter(is_answer).select(F.col("record_id").alias("_id"), whole.alias("response"))
    others = records.filter(F.col("record_type").isin("request", "metadata"))
    linked = others.select(F.explode_outer("concurrent_to").alias("to"), "record_id", "record_type", "target_uri", "fields")
    named = records.filter(is_answer).select(F.col("record_id").alias("of"), F.explode("concurrent_to").alias("record_id"))
    back = others.select("record_id", "record_type", "target_uri", "fields").join(named, "record_id").select(F.col("of").alias("to"), "record_id", "record_type", "target_uri", "fields")
    linked = linked.join(named.select("record_id").distinct().withColumn("_named", F.lit(True)), "record_id", "left").filter(F.col("to").isNotNull() | F.col("_named").isNull()).drop("_named").unionByName(back)
    of = lambda kind: F.when(F.col("record_type") == kind, F.struct("record_id", "target_uri", F.map_entries("fields").alias("fields")))
    parts = linked.groupBy(F.coalesce("to", "record_id").alias("_to")).agg(F.min(of("request")).alias("request"), F.min(of("metadata")).alias("metadata"), F.count(of("request")).alias("n_requests"), F.count(of("metadata")).alias("n_metadata"))
    both = answers.join(parts, F.col("_id") == F.col("_to"), "full_outer")
    return both.select(F.coalesce("_id", "_to").alias("capture_id"), "response", "request", "metadata", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def capture_digests(captures: DataFrame, key_type: str = "long") -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type and refers_to, the page of the response that a
    revisit names (null for responses, and where that response is in no archive). Captures without a response give no
    row, a null key comes back null, and rows that repeat keep a row each; no captures give no rows."""
    page = F.get(F.filter("metadata.fields", lambda x: x["key"] == "page-id"), 0)["value"].cast(key_type)
    slim = captures.filter(F.col("response").isNotNull()).select("capture_id", page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("_refers"))
    first = slim.filter(F.col("record_type") == "response").select(F.col("capture_id").alias("_refers"), F.col("page_id").alias("refers_to"))
    return slim.join(first, "_refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder, read them back and assemble their captures.

    A null html is an empty payload, a null url and a null key are left out of the records; rows that repeat are captures
    each. An empty table gives no rows. What lies in the shared folder goes but for the captures.
    """
    spark = pages.sparkSession
    with recorded() as paths:
        path = new_path(spark, "warc")
        splits = write_archive(pages, path, key, url, html)
        records = written(read_archive(spark, path, with_payload=False, splits=splits), "warc-records")
        captures = written(assemble(records), "warc-captures")
    delete(spark, [p for p in paths if p != captures._written_to])
    return captures
