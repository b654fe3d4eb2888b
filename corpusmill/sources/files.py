"""Sources: collections, journals, ledgers, archives and documents as DataFrames with fixed schemas."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLLECTION = ("author", "book", "text", "segmented", "sha256")
JOURNAL = "filename string, author string, sha256 string, encoding string, pages long, text string, scan_counts map<string,long>, source_url string, collected_at string"
CRAWL = "u string, c array<string>"
SEARCH = "url string, title string, keyword string, page int"


def collection(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet collection whose files may lack columns: those read as empty strings."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in COLLECTION])


def journal(spark: SparkSession, path: str, schema: str = JOURNAL) -> DataFrame:
    """JSON lines; blank and torn ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def crawl_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, place`` from crawl journal lines ``{u, c}``."""
    rows = journal(spark, path, CRAWL).where("u is not null")
    return rows.select(F.col("u").alias("src"), F.posexplode(F.filter("c", lambda x: x.isNotNull())).alias("place", "dst"))


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """A saved JSON list of results."""
    return spark.read.schema(SEARCH).option("multiLine", True).json(path)


def loose_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of text files, in no order: Spark cuts a large file into parts, so none is held whole."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, k, line`` of text files, lines numbered in order from 0; no file is held whole.

    Lines are numbered in each part that Spark cuts a file into; parts are few, so the lines before each are added up in a small table.
    """
    part = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part")]
    rows = spark.read.option("lineSep", "\n").text(path).select(*part, F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    parts = rows.groupBy("path", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("part")) - F.col("n")
    parts = parts.select("path", "part", "first", before.alias("before"))
    return rows.join(F.broadcast(parts), ["path", "part"]).select("path", (F.col("id") - F.col("first") + F.col("before")).cast("int").alias("k"), "line")


def failed_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``stamp, status, url, detail`` from tab-separated lines, one of each status and URL."""
    return spark.read.schema("stamp string, status string, url string, detail string").csv(path, sep="\t", quote="").where("url is not null").dropDuplicates(["status", "url"])


def uploaded_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each 64-digit hash."""
    rows = spark.read.schema("sha256 string, name string, remote string, bytes long, stamp string").csv(path, sep="\t", quote="").where("length(sha256) = 64")
    return rows.groupBy("sha256").agg(F.max_by(F.struct("name", "remote", "bytes", "stamp"), "stamp").alias("e")).select("sha256", "e.*")


def downloaded_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``sha256, identity`` from space-separated lines; the identity may be missing."""
    rows = spark.read.text(path)
    return rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("sha256"), F.nullif(F.regexp_extract("value", r"^\S+\s+(.*)$", 1), F.lit("")).alias("identity")).where("sha256 <> ''")


def line_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines without blanks and ``#`` comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')").distinct()


def timeline(spark: SparkSession, path: str, year: int) -> DataFrame:
    """``ts, event, detail`` from ``MM-DD HH:MM:SS event detail`` lines of one year."""
    part = lambda k: F.regexp_extract("value", r"^(\d\d-\d\d \d\d:\d\d:\d\d)\s+(\S+)\s*(.*)$", k)
    rows = spark.read.text(path).where(part(1) != "")
    return rows.select(F.to_timestamp(F.concat(F.lit(f"{year}-"), part(1)), "yyyy-MM-dd HH:mm:ss").alias("ts"), part(2).alias("event"), part(3).alias("detail"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """``key, value, note, reversed`` from ``Key = form # note`` lines; pairs the other way round are turned."""
    part = lambda k: F.trim(F.regexp_extract("value", r"^([^=#]+)=([^#]+)(?:#(.*))?$", k))
    rows = spark.read.text(path).where(part(1) != "").select(part(1).alias("a"), part(2).alias("b"), F.nullif(part(3), F.lit("")).alias("note"))
    turned = F.col("a").rlike("[က-႟]") & ~F.col("b").rlike("[က-႟]")
    return rows.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("key"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("value"), "note", turned.alias("reversed"))


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, length, content`` of all files that aren't hidden."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", "content").where(~F.col("path").rlike(r"/(\.|__pycache__/)"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def by_file(files_: DataFrame, read, schema: str) -> DataFrame:
    """Rows of ``read(content)`` for each file, with its path; an unreadable file gives none."""

    names = files_.sparkSession.createDataFrame([], schema).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = list(read(bytes(content)))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                    rows = []
                if rows:
                    yield pd.DataFrame([(path, *r) for r in rows], columns=["path", *names])

    return files_.select("path", "content").mapInPandas(run, f"path string, {schema}")


def zip_members(content: bytes, most: int = 1 << 30) -> Iterator[tuple]:
    """Name, size, crc and whether it is a PDF of each file in an archive; refuses one that would grow beyond ``most``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
        if sum(m.file_size for m in members) > most:
            raise ValueError("too large")
        for m in members:
            yield m.filename, m.file_size, m.CRC, m.filename.lower().endswith(".pdf")


ZIP = "name string, size long, crc long, pdf boolean"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes, most: int = 1 << 28) -> Iterator[tuple]:
    """Number and text of each paragraph of a word-processing document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.getinfo("word/document.xml").file_size > most:
            raise ValueError("too large")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for k, p in enumerate(root.iter(f"{_W}p")):
        yield k, "".join("\t" if x.tag == f"{_W}tab" else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab"))


DOCX = "k long, paragraph string"


def headings(paragraphs: DataFrame) -> DataFrame:
    """``path, k, tag, heading`` of the paragraphs that begin with ``[ZH]`` or ``[MY]``."""
    mark = r"^\[(ZH|MY)\]\s?"
    found = paragraphs.where(F.col("paragraph").rlike(mark))
    return found.select("path", "k", F.regexp_extract("paragraph", mark, 1).alias("tag"), F.regexp_replace("paragraph", mark, "").alias("heading"))


def pdf_objects(content: bytes) -> Iterator[tuple]:
    """Number, generation and dictionary text of each plain object of a PDF file."""
    if b"%PDF-" not in content[:1024]:
        raise ValueError("no PDF")
    for m in re.finditer(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", content, re.S):
        yield int(m[1]), int(m[2]), m[3].split(b"stream", 1)[0].strip().decode("latin-1")


PDF = "number long, generation long, dictionary string"


def sitemap_locations(xml: DataFrame, column: str = "xml") -> DataFrame:
    """``loc`` of each entry of a sitemap or an index of sitemaps, and which of both it was."""
    index = F.col(column).rlike(r"<(\w+:)?sitemapindex\b")
    return xml.select(F.explode(F.expr(f"xpath({column}, '//*[local-name()=\"loc\"]/text()')")).alias("loc"), index.alias("is_index"))


def parquet_codecs(spark: SparkSession, path: str) -> DataFrame:
    """``path, codec, rows`` of each Parquet file: the codec of its first column chunk and the rows its footer names."""
    import pyarrow.parquet as pq

    def read(content: bytes) -> Iterator[tuple]:
        meta = pq.ParquetFile(io.BytesIO(content)).metadata
        yield meta.row_group(0).column(0).compression if meta.num_row_groups else None, meta.num_rows

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return by_file(found, read, "codec string, rows long")


def mapped_rows(spark: SparkSession, path: str) -> DataFrame:
    """``text, ascii, id`` from ``"text":"ascii":"id"`` lines; a byte order mark, comments and other lines go."""
    part = lambda k: F.regexp_extract("value", r'^\ufeff?\s*"([^"]*)"\s*:\s*"([^"]*)"\s*:\s*"([^"]*)"\s*$', k)
    rows = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return rows.select(part(1).alias("text"), part(2).alias("ascii"), part(3).alias("id")).where("id <> ''")


def json_members(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The members of a file that is one JSON array, a row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
