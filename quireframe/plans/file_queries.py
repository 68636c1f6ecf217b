"""Registered queries of rasters and files, with their SQL. Files are made of a table's rows and read again."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import rasters as W
from quireframe.plans.queries import _t, query
from quireframe.session import shared_folder, ship_to_active
from quireframe.sources import files as Z
from quireframe.sources import office


def _raster(width: int, height: int, *pixels: tuple) -> Column:
    """A raster of pixels of four numbers or columns each."""
    two = lambda v: F.lpad(F.hex(v if isinstance(v, Column) else F.lit(v)), 2, "0")
    return F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), F.unhex(F.concat(*[two(v) for p in pixels for v in p])).alias("pixels"))


def _grey(v: Column | int, alpha: int = 255) -> tuple:
    return (v, v, v, alpha)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS width, CASE WHEN p_partkey % 3 = 0 THEN (p_size <> 10)::INT ELSE (p_size <> 10)::INT + 1 END::BIGINT AS changed, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS compared, p_partkey % 3 = 0 AS mismatch, CASE WHEN p_partkey % 3 = 0 THEN abs(p_size - 10)::DOUBLE ELSE (abs(p_size - 10) + 7) / 2 END::DOUBLE AS mean_delta, CASE WHEN p_partkey % 3 = 0 THEN abs(p_size - 10) ELSE greatest(abs(p_size - 10), 7) END::INT AS max_delta FROM part")
def pixel_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    a, b = _raster(2, 1, _grey(s), (0, 0, 0, 255)), _raster(2, 1, _grey(10), (0, 7, 0, 252))
    d = W.pixel_difference(a, F.when(F.col("p_partkey") % 3 == 0, _raster(1, 1, _grey(10))).otherwise(b))
    return _t(spark, sf_dir, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.width", "d.changed", "d.compared", "d.mismatch", "d.mean_delta", "d.max_delta")


@query("SELECT l_returnflag, sum(changed)::BIGINT AS changed, (2 * count(*))::BIGINT AS compared, max(delta)::INT AS max_delta FROM (SELECT l_returnflag, (l_quantity <> 10)::INT AS changed, abs(l_quantity - 10) AS delta FROM lineitem) GROUP BY 1")
def pixel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.pixel_difference(_raster(2, 1, _grey(F.col("l_quantity").cast("int")), _grey(0)), _raster(2, 1, _grey(10), _grey(0)))
    each = _t(spark, sf_dir, "lineitem").select("l_returnflag", d.alias("d"))
    return each.groupBy("l_returnflag").agg(F.sum("d.changed").alias("changed"), F.sum("d.compared").alias("compared"), F.max("d.max_delta").alias("max_delta"))


@query("""WITH g AS (SELECT p_partkey, p_size * 5 AS v FROM part), a AS (SELECT *, floor(255 * (255 - v) / 255.0 + 0.5) AS aa FROM g)
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN floor(255 * 127 / 255.0 * 0 + ((0 * 128 + floor((255 * aa + 255 * (255 - aa)) / 255.0 + 0.5) * 127) / 255.0) + 0.5)::INT END AS red, CASE WHEN p_partkey % 5 <> 0 THEN floor((255 * 128 + floor((0 * aa + 255 * (255 - aa)) / 255.0 + 0.5) * 127) / 255.0 + 0.5)::INT END AS green FROM a""")
def red_cyan_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey pixel in red, a black one in cyan at half its density; rasters of other sizes give none."""
    o = W.red_cyan_overlay(_raster(1, 1, _grey(F.col("p_size") * 5)), F.when(F.col("p_partkey") % 5 == 0, _raster(1, 2, _grey(0), _grey(0))).otherwise(_raster(1, 1, _grey(0))), 0.5)
    at = lambda i: F.conv(F.hex(F.substring(o["pixels"], i, 1)), 16, 10).cast("int")
    return _t(spark, sf_dir, "part").select("p_partkey", at(1).alias("red"), at(2).alias("green"))


@query("SELECT p_partkey, CASE WHEN p_size * 5 >= 128 THEN 'FF' ELSE '00' END AS bilevel, CASE WHEN p_size = 1 THEN '000000FF000000FF' ELSE '000000FFFFFFFFFF' END AS stretched FROM part")
def ocr_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    first = F.hex(F.substring(W.ocr_cleanup(_raster(1, 1, _grey(s * 5)), "bilevel")["pixels"], 1, 1))
    return _t(spark, sf_dir, "part").select("p_partkey", first.alias("bilevel"), F.hex(W.ocr_cleanup(_raster(2, 1, _grey(1, 9), _grey(s)), "document")["pixels"]).alias("stretched"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS \"left\", CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS touched, p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AS verified FROM part")
def redaction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    before = _raster(2, 1, _grey(50), _grey(60))
    after = _raster(2, 1, _grey(F.when(k % 3 == 0, 50).otherwise(0)), _grey(F.when(k % 4 == 0, 61).otherwise(60)))
    box = F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(1).alias("right"), F.lit(1).alias("bottom")))
    c = W.redaction_check(F.struct(before.alias("before"), after.alias("after")), box)
    return _t(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.left", "c.touched", "c.verified")


@query("SELECT p_partkey, p_partkey % 4 <> 0 AS read, CASE WHEN p_partkey % 4 <> 0 THEN upper(lpad(to_hex(p_size), 2, '0')) || '0102FF09080706' END AS pixels FROM part")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters written as PNG and read again; a quarter of the files have a byte too many."""
    png = W.png_encoded(_raster(2, 1, (F.col("p_size"), 1, 2, 255), (9, 8, 7, 6)))
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(png, F.unhex(F.lit("00")))).otherwise(png).alias("png"))
    back = W.png_decoded(F.col("png"))
    return rows.select("p_partkey", back.alias("b")).select("p_partkey", F.col("b").isNotNull().alias("read"), F.hex("b.pixels").alias("pixels"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, page_id % 3 + 1 AS version FROM pages WHERE page_id % 5 <> 0".replace("regexp_extract(url, '([^/]*)$', 1)", "'f' || page_id"))
def repository_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("name"))
    v = p.withColumn("version", F.explode(F.sequence(F.lit(1), F.col("page_id") % 3 + 1)))
    v = v.select("name", "version", F.lit("d").alias("digest"), ((F.substring("name", 2, 9).cast("long") % 5 == 0) & (F.col("version") == F.substring("name", 2, 9).cast("long") % 3 + 1)).alias("deleted"))
    return Z.latest_objects(v).select(F.substring("name", 2, 9).cast("long").alias("page_id"), "name", "version")


@query("SELECT p_partkey::VARCHAR AS name, CASE p_partkey % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'same' WHEN 2 THEN 'replaced' ELSE 'conflict' END AS status FROM part")
def repository_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), k.alias("k"))
    now = p.filter("k != 0").select("name", F.lit("old").alias("digest"))
    puts = p.select("name", F.when(F.col("k") == 2, "old").when(F.col("k") == 3, "older").alias("expected"), F.when(F.col("k") == 1, "old").otherwise("new").alias("digest"))
    return Z.put_results(now, puts).select("name", "status")


def _archives(name: Column, text: Column) -> Column:
    """Archives of three kinds around a text."""
    ship_to_active()

    def make(names: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for n, t in zip(names.to_pylist(), texts.to_pylist(), strict=True):
            parts = {
                ".docx": {"word/document.xml": f"<w:p a='1'><w:r><w:t>{t}</w:t><w:t> &amp; co</w:t></w:r></w:p><w:p/><w:p><w:t></w:t></w:p><w:p><w:t>end</w:t></w:p>"},
                ".pptx": {"ppt/slides/slide10.xml": "<a:p><a:t>ten</a:t></a:p>", "ppt/slides/slide2.xml": f"<a:p><a:t>{t}</a:t></a:p><a:p><a:t>two</a:t></a:p>"},
                ".xlsx": {"xl/sharedStrings.xml": f"<si><t>{t}</t></si><si><t>b</t></si>", "xl/worksheets/sheet1.xml": '<row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c t="s"><v>1</v></c><c t="s"><v>9</v></c></row>'},
                ".odt": {"content.xml": f"<text:p>{t}</text:p><text:p>a<text:tab/>b</text:p>"},
            }.get(n)
            if parts is None:
                out.append((t + "\r\n" if n == ".txt" else "{\\rtf1\\ansi " + t + "\\par \\u233?\\tab x\\{\\}}").encode() if n in (".txt", ".rtf") else b"PK damaged")
                continue
            b = io.BytesIO()
            with zipfile.ZipFile(b, "w") as z:
                for k, v in parts.items():
                    z.writestr(k, v)
            out.append(b.getvalue())
        return pa.array(out, pa.binary())

    return F.arrow_udf(make, "binary")(name, text)


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_name || '& co' || chr(10) || 'end' WHEN 1 THEN p_name || chr(10) || 'two' || chr(10) || 'ten' WHEN 2 THEN p_name || chr(9) || '7' || chr(10) || 'b' || chr(9) WHEN 3 THEN p_name || chr(10) || 'a' || chr(9) || 'b' WHEN 4 THEN p_name || chr(13) || chr(10) WHEN 5 THEN p_name || chr(10) || 'é' || chr(9) || 'x' END AS text FROM part""")
def office_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*[F.lit(x) for x in (".docx", ".pptx", ".xlsx", ".odt", ".txt", ".rtf", ".DOCX")]), F.col("p_partkey") % 7)
    data = _archives(F.when(F.col("p_partkey") % 7 == 6, ".bad").otherwise(ending), F.col("p_name"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", ending.alias("ending"), data.alias("data"))
    return rows.select("p_partkey", Z.file_text(F.col("data"), F.col("ending")).alias("text"))


@query("SELECT p_partkey AS doc_id, 1 AS ordinal, p_size::DOUBLE AS x1, 2.5::DOUBLE AS y1, 3.0::DOUBLE AS x2, 4.0::DOUBLE AS y2 FROM part UNION ALL SELECT p_partkey, 2, 0, 0, p_size, 1 FROM part WHERE p_partkey % 2 = 0")
def drawing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, nl = F.col("p_size").cast("string"), F.lit("\n")
    dxf = F.concat_ws("\n", F.lit("0"), F.lit("SECTION"), F.lit("0"), F.lit("LINE"), F.lit(" 10"), s, F.lit("20"), F.lit("2.5"), F.lit("11"), F.lit("3"), F.lit("21"), F.lit("4"), F.lit("0"), F.lit("CIRCLE"), F.lit("10"), F.lit("9"), F.lit("0"), F.lit("LINE"), F.lit("10"), F.lit("0"), F.lit("20"), F.lit("0"), F.lit("11"), s, F.lit("21"), F.lit("1"), F.lit("0"), F.lit("LINE"), F.lit("10"), F.lit("x"), F.lit("0"), F.concat(F.lit("EOF"), nl))
    text = F.concat(F.lit(' {"entities": [{"type":"rect"}, {"type":"line","x1":'), s, F.lit(',"y1":2.5,"x2":3,"y2":4}, {"type":"line","x1":1}]}'))
    return Z.drawing_lines(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 2 == 0, dxf).otherwise(text).alias("text")))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'no-bundle' WHEN 2 THEN 'truncated' WHEN 3 THEN 'trailing' WHEN 4 THEN 'damaged' ELSE 'sound' END AS status FROM part")
def bundle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_to_active()

    def make(names: pa.Array) -> pa.Array:
        return pa.array([Z.bundle({"kind": "project", "name": n}, n.encode() * 9) for n in names.to_pylist()], pa.binary())

    b, k = F.arrow_udf(make, "binary")(F.col("p_name")), F.col("p_partkey") % 6
    one = lambda x: F.unhex(F.lit(x))
    rows = _t(spark, sf_dir, "part").select("p_partkey", b.alias("b"))
    cut = F.expr("substring(b, 1, length(b) - 1)")
    data = F.when(k == 1, F.concat(one("00"), F.col("b"))).when(k == 2, cut).when(k == 3, F.concat(F.col("b"), one("00"))).when(k == 4, F.concat(cut, one("00"))).otherwise(F.col("b"))
    return rows.select("p_partkey", Z.bundles(data)["status"].alias("status"))


@query("SELECT p_partkey, p_name || chr(10) || p_type || chr(10) || p_brand AS text FROM part")
def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text document of each part, written as files and read back as a format."""
    office.register(spark)
    at = f"{shared_folder(spark)}/office-{uuid.uuid4().hex[:12]}"
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws("\n", "p_name", "p_type", "p_brand").alias("text"))
    # A file costs far more than its row's bytes, by which a table is dealt out to tasks.
    part = part.repartition(spark.sparkContext.defaultParallelism)
    part.write.format("office").mode("append").option("kind", "docx").save(at)
    read = spark.read.format("office").load(at)
    return read.select(F.regexp_extract("path", r"([0-9]+)\.docx$", 1).cast("long").alias("p_partkey"), "text")
