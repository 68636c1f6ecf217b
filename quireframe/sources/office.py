"""Office files as a Spark format: ``spark.read.format("office")`` and ``df.write.format("office")``.

A reader lists a folder once, deals its files out by their bytes, and opens them in tasks. A writer's tasks put files aside; they
come to their place, with a manifest, when all tasks are done, and go when one fails.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of the files of one partition, about.
PARTITION_BYTES = 32 << 20
MANIFEST = "_manifest.json"
#: The parts that make an archive a text document or a workbook of one sheet, but for its contents.
_RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/%s" Target="%s"/></Relationships>'
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>%s</Types>'
_PART = '<Override PartName="/%s" ContentType="application/vnd.openxmlformats-officedocument.%s+xml"/>'


def _legal(text: str) -> str:
    """``text`` without what XML cannot hold, escaped."""
    if text.isascii() and text.isprintable():
        return escape(text)
    return escape("".join(c for c in text if c in "\t\n" or " " <= c <= "퟿" or "" <= c <= "�" or c >= "\U00010000"))


def docx(text: str) -> bytes:
    """A text document with a paragraph for each line."""
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_legal(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>'
    types = _TYPES % (_PART % ("word/document.xml", "wordprocessingml.document.main"))
    return _zipped({"[Content_Types].xml": types, "_rels/.rels": _RELATIONS % ("officeDocument", "word/document.xml"), "word/document.xml": body})


def xlsx(text: str) -> bytes:
    """A workbook of one sheet: a row for each line, a cell for what lies between tabs."""
    rows = "".join(f'<row r="{i}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{_legal(c)}</t></is></c>' for c in line.split("\t")) + "</row>" for i, line in enumerate(text.split("\n"), 1))
    sheet = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>'
    book = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Text" sheetId="1" r:id="rId1"/></sheets></workbook>'
    types = _TYPES % (_PART % ("xl/workbook.xml", "spreadsheetml.sheet.main") + _PART % ("xl/worksheets/sheet1.xml", "spreadsheetml.worksheet"))
    return _zipped({"[Content_Types].xml": types, "_rels/.rels": _RELATIONS % ("officeDocument", "xl/workbook.xml"), "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": _RELATIONS % ("worksheet", "worksheets/sheet1.xml"), "xl/worksheets/sheet1.xml": sheet})


def _zipped(parts: dict[str, str]) -> bytes:
    """An archive that is the same whenever it is made."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


MAKERS = {"docx": docx, "xlsx": xlsx}


def _at(path: str) -> tuple:
    """The file system of a path and the place in it. Its module is loaded where files are touched only, as it starts threads."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Office(DataSource):
    """Format ``office``. Reading gives path, size and text (null where a file is damaged or of another kind); option ``contents``
    false leaves texts null and opens no file; ``partition_bytes`` bounds a partition, but for a larger file. Writing takes
    key and text, a file for each row, by option ``kind`` (docx or xlsx); a null text is empty, and a null or repeated key an
    error. Only a path that all executors share, and that pyarrow's file systems reach, will do."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return "path string, size long, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.contents = str(options.get("contents", "true")).lower() == "true"

    def partitions(self) -> list[_Files]:
        from pyarrow.fs import FileSelector

        where, root = _at(self.path)
        listed = sorted((f.path, f.size) for f in where.get_file_info(FileSelector(root, recursive=True)) if f.is_file and not any(x.startswith(("_", ".")) for x in f.path[len(root) :].split("/")))
        out, held, total = [], [], 0
        for path, size in listed:
            if held and total + size > self.most:
                out.append(_Files(held))
                held, total = [], 0
            held.append((path, size))
            total += size
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        from quireframe.sources.files import office_text

        where, _ = _at(self.path)
        for path, size in partition.files:
            text = None
            if self.contents:
                with where.open_input_stream(path) as f:
                    text = office_text(f.read(), "." + path.rsplit(".", 1)[-1].lower())
            yield path, size, text


@dataclass
class _Done(WriterCommitMessage):
    files: list[tuple[str, int]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind = options["path"], options.get("kind", "docx")
        if self.kind not in MAKERS:
            raise ValueError(f"no files of kind {self.kind} are made")
        self.key, self.text = schema.names.index("key"), schema.names.index("text")
        self.aside = f"_aside-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Done:
        where, root = _at(self.path)
        # Of a task that runs twice each attempt has a folder; the one that is committed is named in its message.
        own = f"{self.aside}/{uuid.uuid4().hex}"
        where.create_dir(f"{root}/{own}", recursive=True)
        made = []
        for r in rows:
            if r[self.key] is None:
                raise ValueError("a file needs a key")
            name, data = f"{r[self.key]}.{self.kind}", MAKERS[self.kind](r[self.text] or "")
            with where.open_output_stream(f"{root}/{own}/{name}") as f:
                f.write(data)
            made.append((f"{own}/{name}", len(data)))
        return _Done(made)

    def commit(self, messages: list[_Done | None]) -> None:
        where, root = _at(self.path)
        made = [f for m in messages if m for f in m.files]
        names = sorted((path.rsplit("/", 1)[1], size) for path, size in made)
        if len({n for n, _ in names}) < len(names):
            self.abort(messages)
            raise ValueError("a key is repeated")
        for path, _ in made:
            where.move(f"{root}/{path}", f"{root}/{path.rsplit('/', 1)[1]}")
        # The manifest comes last: a folder without one is not whole.
        with where.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"files": len(names), "bytes": sum(s for _, s in names), "kind": self.kind}, sort_keys=True).encode())
        self._clear()

    def abort(self, messages: list[_Done | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, root = _at(self.path)
        if where.get_file_info(f"{root}/{self.aside}").type.name == "Directory":
            where.delete_dir(f"{root}/{self.aside}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    from quireframe.session import ship_code

    ship_code(spark)
    spark.dataSource.register(Office)
