"""Readers of files: directories, office archives, RTF, drawings and project bundles. Files come as rows of ``binaryFile`` or of any
table with their bytes; what lies in one is read in the task that holds it."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireframe.functions.values import canonical_json
from quireframe.operators.text import ENTITIES, MARKUP
from quireframe.session import ship_to_active

MOST_ENTRY_BYTES = 256 << 20


def directory(spark: SparkSession, path: str, ending: str = ".pdf") -> DataFrame:
    """The files of a directory with an ending, in any case, by name: name, size and signature (of size and time)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    each = files.select(name.alias("name"), F.col("length").alias("size"), F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("signature"))
    return each.filter(F.lower("name").endswith(ending)).orderBy("name")


def latest_objects(versions: DataFrame) -> DataFrame:
    """A repository's listing: of versions (name, version, digest, deleted) the newest of each name that is not deleted."""
    w = Window.partitionBy("name").orderBy(F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1 AND NOT coalesce(deleted, false)").select("name", "version", "digest")


def put_results(current: DataFrame, puts: DataFrame) -> DataFrame:
    """Puts (name, expected, digest) against a listing: created where there is no such name and none is expected, replaced where
    the digest is the one expected, same where it is the one put, else conflict."""
    both = puts.join(current.select("name", F.col("digest").alias("_is")), "name", "left")
    status = F.when(F.col("_is").isNull() & F.col("expected").isNull(), "created").when(F.col("_is") == F.col("digest"), "same").when(F.col("_is") == F.col("expected"), "replaced").otherwise("conflict")
    return both.select("name", "digest", status.alias("status"))


_MARKUP = [(re.compile(pattern, re.A), plain) for pattern, plain in MARKUP]


def markup_text(xml: str) -> str:
    """Text of markup, as ``text.html_text`` reads it."""
    t = xml
    for pattern, plain in _MARKUP:
        t = pattern.sub(plain, t)
    t = re.sub("&(?:amp|lt|gt|quot|apos);", lambda m: dict(ENTITIES)[m[0]], re.sub(r"<!\[CDATA\[([\s\S]*?)\]\]>", r"\1", t))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[\t ]+", "\n", t.replace("\r", ""))).strip()


def _parts(xml: str, tag: str) -> list[str]:
    return re.findall(rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>", xml, re.I)


def _text(xml: str, tag: str) -> str:
    return "".join(markup_text(x) for x in _parts(xml, tag))


def _numbered(names: list[str], pattern: str) -> list[str]:
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"\d+", n)[0]))


def office_text(data: bytes, ending: str) -> str | None:
    """The text of a file by its ending: .txt and .csv as they are, .rtf, .html, and the archives .docx (paragraphs), .pptx
    (slides in order), .xlsx (rows of cells parted by tabs, sheets in order) and .odt, .odp and .ods. None for another ending,
    or an archive that is damaged or lacks its text."""
    if ending in (".txt", ".csv"):
        return data.decode("utf-8", "replace").removeprefix("\ufeff")
    if ending == ".rtf":
        return rtf_text(data.decode("utf-8", "replace").removeprefix("\ufeff"))
    if ending in (".html", ".htm"):
        return markup_text(data.decode("utf-8", "replace").removeprefix("\ufeff"))
    if ending not in (".docx", ".pptx", ".xlsx", ".odt", ".odp", ".ods"):
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [i.filename for i in z.infolist() if i.file_size <= MOST_ENTRY_BYTES]
            read = lambda n: z.read(n).decode("utf-8", "replace")
            if ending == ".docx":
                return "\n".join(t for p in _parts(read("word/document.xml"), "w:p") if (t := _text(p, "w:t")))
            if ending == ".pptx":
                slides = []
                for n in _numbered(names, r"ppt/slides/slide\d+\.xml"):
                    source = read(n)
                    slides.append("\n".join([_text(p, "a:t") for p in _parts(source, "a:p")] or [_text(source, "a:t")]))
                return "\n".join(s for s in slides if s)
            if ending == ".xlsx":
                shared = [_text(s, "t") for s in _parts(read("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
                sheets = [_sheet(read(n), shared) for n in _numbered(names, r"xl/worksheets/sheet\d+\.xml")]
                return "\n\n".join(s for s in sheets if s) if sheets else None
            return markup_text(read("content.xml"))
    except (zipfile.BadZipFile, KeyError, ValueError, OSError, NotImplementedError):
        return None


def _sheet(xml: str, shared: list[str]) -> str:
    rows = []
    for row in _parts(xml, "row"):
        cells = []
        for head, cell in re.findall(r"<c\b([^>]*)>([\s\S]*?)</c>", row, re.I):
            kind = re.search(r'\bt="([^"]+)"', head)
            raw = _text(cell, "v") or _text(cell, "t")
            cells.append((shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else "") if kind and kind[1] == "s" else raw)
        rows.append("\t".join(cells))
    return "\n".join(rows)


def rtf_text(source: str) -> str:
    """Text of RTF: escaped characters are read, paragraphs and lines become line breaks, tabs tabs; other words and braces
    go."""
    t = re.sub(r"\\u(-?\d+)\??", lambda m: chr((int(m[1]) + 65_536) % 65_536), source, flags=re.A)
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), t)
    t = re.sub(r"\\tab\b ?", "\t", re.sub(r"\\(?:par|line)\b ?", "\n", t, flags=re.I | re.A), flags=re.I | re.A)
    t = re.sub(r"[{}]", "", re.sub(r"\\([{}\\])", r"\1", re.sub(r"\\[a-z]+-?\d* ?", "", t, flags=re.I | re.A)))
    t = t.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def file_text(data: Column, ending: Column) -> Column:
    """``office_text`` of files' bytes as a column."""
    ship_to_active()

    def run(files: pa.Array, endings: pa.Array) -> pa.Array:
        return pa.array([None if d is None or e is None else office_text(d, e.lower()) for d, e in zip(files.to_pylist(), endings.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(data, ending)


ENTITY = "array<struct<type:string,x1:double,y1:double,x2:double,y2:double>>"


def drawing_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """The lines of drawings: doc_id, ordinal (from 1), x1, y1, x2 and y2. A text that begins with a brace is JSON with entities,
    of which the lines are read; any other is DXF: pairs of lines, a code and a value, of which the LINE entities are read
    (codes 10, 20, 11 and 21). A line that lacks a number is none."""
    ship_to_active()

    def entities(text: str) -> list[dict]:
        t = text.removeprefix("\ufeff")
        out = []
        if t.lstrip().startswith("{"):
            try:
                found = json.loads(t).get("entities") or []
            except (ValueError, AttributeError):
                return []
            out = [{k: e.get(k) for k in ("x1", "y1", "x2", "y2")} for e in found if isinstance(e, dict) and e.get("type") == "line"]
        else:
            lines = re.split(r"\r?\n", t)
            pairs = [(lines[i].strip(), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
            names, current = {"10": "x1", "20": "y1", "11": "x2", "21": "y2"}, None
            for code, value in pairs:
                if code == "0":
                    current = {} if value == "LINE" else None
                    if current is not None:
                        out.append(current)
                elif current is not None and code in names:
                    try:
                        current[names[code]] = float(value)
                    except ValueError:
                        current[names[code]] = None
        good = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < float("inf")
        return [{k: float(e[k]) for k in ("x1", "y1", "x2", "y2")} for e in out if all(good(e.get(k)) for k in ("x1", "y1", "x2", "y2"))]

    kind = pa.list_(pa.struct([(k, pa.float64()) for k in ("x1", "y1", "x2", "y2")]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([entities(t or "") for t in texts.to_pylist()], kind)

    found = F.arrow_udf(run, "array<struct<x1:double,y1:double,x2:double,y2:double>>")(F.col(column))
    each = docs.select("doc_id", F.posexplode(found).alias("i", "e"))
    return each.select("doc_id", (F.col("i") + 1).alias("ordinal"), "e.*")


MAGIC = b"QFBUNDLE"


def bundle(manifest: dict, payload: bytes) -> bytes:
    """A project bundle: a mark, the length of the manifest, the manifest as canonical JSON with the payload's size and digest,
    and the payload."""
    head = canonical_json(manifest | {"size": len(payload), "sha256": hashlib.sha256(payload).hexdigest()}).encode()
    return MAGIC + len(head).to_bytes(4, "big") + head + payload


def bundle_status(data: bytes) -> tuple[str, str | None]:
    """What a bundle's bytes are: sound, or no-bundle, truncated, not-canonical, trailing, or damaged; and its manifest."""
    n = len(MAGIC)
    if data[:n] != MAGIC:
        return "no-bundle", None
    size = int.from_bytes(data[n : n + 4], "big")
    head, payload = data[n + 4 : n + 4 + size], data[n + 4 + size :]
    if len(head) < size:
        return "truncated", None
    try:
        said = json.loads(head)
        if canonical_json(said).encode() != head:
            return "not-canonical", None
        if len(payload) != said["size"]:
            return ("truncated" if len(payload) < said["size"] else "trailing"), head.decode()
        return ("sound" if hashlib.sha256(payload).hexdigest() == said["sha256"] else "damaged"), head.decode()
    except (ValueError, KeyError, TypeError, UnicodeDecodeError):
        return "not-canonical", None


def bundles(data: Column) -> Column:
    """``bundle_status`` of bytes as a struct of status and manifest."""
    ship_to_active()

    def run(files: pa.Array) -> pa.Array:
        found = [bundle_status(d) if d is not None else (None, None) for d in files.to_pylist()]
        return pa.array([{"status": s, "manifest": m} for s, m in found], pa.struct([("status", pa.string()), ("manifest", pa.string())]))

    return F.arrow_udf(run, "struct<status:string,manifest:string>")(data)
