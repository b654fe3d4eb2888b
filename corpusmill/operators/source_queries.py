"""Round trips: tables written in the formats of the sources and read back by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, load
from ..plans.storage import new_path
from ..sources import files, sinks

C = Catalog()


def _lines(rows: DataFrame, line, name: str) -> str:
    """The path of a folder of text files with one ``line`` a row."""
    path = new_path(rows.sparkSession, name)
    rows.select(line.alias("value")).where("value is not null").write.text(path)
    return path


@C.add("line_scan", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY line")
def line_scan(spark, sf):
    path = _lines(load(spark, sf, "documents"), F.col("text"), "lines")
    return files.loose_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@C.add("whole_file_read", "SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def whole_file_read(spark, sf):
    path = _lines(load(spark, sf, "documents"), F.col("text"), "whole")
    return spark.read.text(path, wholetext=True).agg(F.sum(F.octet_length("value")).alias("bytes"))


@C.add("output_hash_scan", "SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, TRUE AS hashed FROM documents WHERE text IS NOT NULL")
def output_hash_scan(spark, sf):
    path = _lines(load(spark, sf, "documents"), F.col("text"), "hashed")
    return files.file_hashes(spark, path).where("path like '%.txt'").agg(F.sum("length").alias("bytes"), F.bool_and(F.length("sha256") == 64).alias("hashed"))


@C.add("journal_scan", "SELECT CAST(doc_id AS VARCHAR) AS filename, source AS author, n_chars AS pages, md5(text) AS digest FROM documents")
def journal_scan(spark, sf):
    """JSON lines with blank and torn ones among them."""
    d = load(spark, sf, "documents")
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("filename"), F.col("source").alias("author"), F.col("n_chars").alias("pages"), "text"))
    torn = d.where("doc_id % 5 = 0").select(F.when(F.col("doc_id") % 2 == 0, "").otherwise('{"filename": "half').alias("value"))
    path = new_path(spark, "journal")
    d.select(good.alias("value")).union(torn).write.text(path)
    return files.journal(spark, path).select("filename", "author", "pages", F.md5("text").alias("digest"))


_CHILDREN = "list_filter([url || '/a', CASE WHEN page_id % 3 = 0 THEN NULL ELSE url || '/b' END, url || '/c'], lambda x: x IS NOT NULL)"


def _crawl(spark, sf) -> str:
    p = load(spark, sf, "pages")
    child = F.array(F.concat("url", F.lit("/a")), F.when(F.col("page_id") % 3 != 0, F.concat("url", F.lit("/b"))), F.concat("url", F.lit("/c")))
    return _lines(p, F.to_json(F.struct(F.col("url").alias("u"), child.alias("c"))), "crawl")


@C.add("crawl_journal_scan", f"SELECT url AS src, unnest(c) AS dst, CAST(unnest(range(len(c))) AS INT) AS place FROM (SELECT url, {_CHILDREN} AS c FROM pages)")
def crawl_journal_scan(spark, sf):
    return files.crawl_edges(spark, _crawl(spark, sf)).select("src", "dst", "place")


@C.add("crawl_resume_scan", f"SELECT url AS page, CAST(sum(len({_CHILDREN})) AS BIGINT) AS children FROM pages GROUP BY url")
def crawl_resume_scan(spark, sf):
    """Finished pages with the number of children each has."""
    return files.crawl_edges(spark, _crawl(spark, sf)).groupBy(F.col("src").alias("page")).agg(F.count(F.lit(1)).alias("children"))


@C.add("collection_scan", "SELECT '' AS author, source || '-' || doc_id AS book, md5(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE '' END AS sha256 FROM documents")
def collection_scan(spark, sf):
    """Files with and without a column read as one collection; what is missing is empty."""
    d = load(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("-"), "doc_id").alias("book"), "text")
    path = new_path(spark, "collection")
    sinks.write_collection(d.where("doc_id % 2 = 0").select("book", "text", F.sha2("text", 256).alias("sha256")), f"{path}/part=0")
    sinks.write_collection(d.where("doc_id % 2 = 1").select("book", "text"), f"{path}/part=1")
    return files.collection(spark, path).select("author", "book", F.md5("text").alias("digest"), "sha256")


@C.add("footer_row_count", "SELECT 'ZSTD' AS codec, count(*) AS rows FROM documents")
def footer_row_count(spark, sf):
    """Codec and rows by the footers of a stored collection."""
    path = new_path(spark, "footers")
    sinks.write_collection(load(spark, sf, "documents").select("doc_id", "text"), path, 3)
    return files.parquet_codecs(spark, path).groupBy("codec").agg(F.sum("rows").alias("rows"))


@C.add("collection_rewrite", "SELECT count(*) AS rows, count(*) AS stored FROM conversations")
def collection_rewrite(spark, sf):
    c = load(spark, sf, "conversations")
    path = new_path(spark, "rewrite")
    stored = sinks.rewrite_collection(c, path, 3)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(stored).cast("bigint").alias("stored"))


@C.add("failed_ledger_scan", "SELECT DISTINCT event_type AS status, 'http://h/' || user_id AS url FROM events")
def failed_ledger_scan(spark, sf):
    line = F.concat_ws("\t", F.col("ts").cast("string"), "event_type", F.concat(F.lit("http://h/"), "user_id"), F.lit("x"))
    return files.failed_ledger(spark, _lines(load(spark, sf, "events"), line, "failed")).select("status", "url")


@C.add("uploaded_ledger_scan", "SELECT sha256(event_type || user_id) AS sha256, arg_max(CAST(event_id AS VARCHAR), lpad(CAST(event_id AS VARCHAR), 12, '0')) AS name, max(lpad(CAST(event_id AS VARCHAR), 12, '0')) AS stamp FROM events WHERE event_id % 7 <> 0 GROUP BY ALL")
def uploaded_ledger_scan(spark, sf):
    """The last entry of each digest; lines without one are passed over."""
    digest = F.when(F.col("event_id") % 7 == 0, "short").otherwise(F.sha2(F.concat("event_type", "user_id"), 256))
    line = F.concat_ws("\t", digest, F.col("event_id").cast("string"), F.lit("r"), F.lit("1"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return files.uploaded_ledger(spark, _lines(load(spark, sf, "events"), line, "uploaded")).select("sha256", "name", "stamp")


@C.add("downloaded_ledger_scan", "SELECT sha256(p_name || p_partkey) AS sha256, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS identity FROM part")
def downloaded_ledger_scan(spark, sf):
    """Lines of a digest with or without an identity."""
    line = F.concat(F.sha2(F.concat("p_name", "p_partkey"), 256), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    return files.downloaded_ledger(spark, _lines(load(spark, sf, "part"), line, "downloaded"))


@C.add("line_set_scan", "SELECT DISTINCT p_brand AS value FROM part")
def line_set_scan(spark, sf):
    """Distinct lines without comments and blanks."""
    p = F.col("p_partkey") % 4
    line = F.when(p == 0, F.concat(F.lit("# "), "p_name")).when(p == 1, F.lit("  ")).otherwise(F.lit(None))
    d = load(spark, sf, "part")
    path = new_path(spark, "lineset")
    d.select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("value")).union(d.select(line).where("p_partkey % 4 < 2")).write.text(path)
    return files.line_set(spark, path)


@C.add("timeline_scan", "SELECT date_trunc('second', ts) AS ts, event_type AS event, 'user ' || user_id AS detail, count(*) AS n FROM events GROUP BY ALL")
def timeline_scan(spark, sf):
    """Log lines with month, day and time, of one year."""
    line = F.concat(F.date_format("ts", "MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(" user "), "user_id")
    rows = files.timeline(spark, _lines(load(spark, sf, "events"), line, "timeline"), 2024)
    return rows.groupBy(F.col("ts").cast("timestamp_ntz").alias("ts"), "event", "detail").agg(F.count(F.lit(1)).alias("n"))


@C.add("name_list_scan", "SELECT 'Brand ' || p_partkey AS key, 'က' || p_partkey AS value, CASE WHEN p_partkey % 2 = 0 THEN 'note' END AS note, p_partkey % 3 = 0 AS reversed FROM part")
def name_list_scan(spark, sf):
    """``Key = form # note`` lines, some the other way round, prose among them."""
    key, form = F.concat(F.lit("Brand "), "p_partkey"), F.concat(F.lit("က"), "p_partkey")
    pair = F.when(F.col("p_partkey") % 3 == 0, F.concat(form, F.lit(" = "), key)).otherwise(F.concat(key, F.lit(" = "), form))
    p = load(spark, sf, "part")
    path = new_path(spark, "names")
    p.select(F.concat(pair, F.when(F.col("p_partkey") % 2 == 0, " # note").otherwise("")).alias("value")).union(p.limit(5).select(F.lit("prose without a pair"))).write.text(path)
    return files.key_values(spark, path)


@C.add("mapped_row_scan", "SELECT 'က' || p_partkey AS text, p_brand AS ascii, 'A' || p_partkey AS id FROM part")
def mapped_row_scan(spark, sf):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat_ws(":", q(F.concat(F.lit("က"), "p_partkey")), q(F.col("p_brand")), q(F.concat(F.lit("A"), "p_partkey")))
    p = load(spark, sf, "part")
    path = new_path(spark, "mapped")
    p.select(line.alias("value")).union(p.limit(3).select(F.lit('# "a":"b":"c"'))).union(p.limit(3).select(F.lit('"a":"b"'))).write.text(path)
    return files.mapped_rows(spark, path)


@C.add("json_array_members", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def json_array_members(spark, sf):
    """Files that are one JSON array each, a row a member."""
    n = load(spark, sf, "nation")
    one = n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))).alias("value"))
    path = new_path(spark, "members")
    one.select("value").repartition(5, F.rand(1)).write.option("maxRecordsPerFile", 1).text(path)
    return files.json_members(spark, path, "name string, region int")


@C.add("saved_results_scan", "SELECT url, CAST(page_id AS VARCHAR) AS title, CAST(page_id % 9 AS INT) AS page FROM pages")
def saved_results_scan(spark, sf):
    p = load(spark, sf, "pages").select("url", F.col("page_id").cast("string").alias("title"), F.lit("k").alias("keyword"), (F.col("page_id") % 9).cast("int").alias("page"))
    path = new_path(spark, "results")
    p.groupBy(F.crc32(F.encode("title", "utf-8")) % 4).agg(F.to_json(F.collect_list(F.struct("url", "title", "keyword", "page"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.search_results(spark, path).select("url", "title", "page")


@C.add("sitemap_scan", "SELECT url AS loc, page_id % 2 = 0 AS is_index, count(*) AS n FROM pages GROUP BY ALL")
def sitemap_scan(spark, sf):
    """Entries of sitemaps and of indexes of them, with and without a namespace."""
    index = F.col("page_id") % 2 == 0
    loc = F.concat(F.lit("<loc>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</loc>"))
    xml = F.when(index, F.concat(F.lit("<sitemapindex><sitemap>"), loc, F.lit("</sitemap></sitemapindex>"))).otherwise(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url>'), loc, F.lit("</url></urlset>")))
    rows = files.sitemap_locations(load(spark, sf, "pages").select(xml.alias("xml")))
    return rows.groupBy("loc", "is_index").agg(F.count(F.lit(1)).alias("n"))


@C.add("segmented_writer", r"SELECT line, count(*) AS n FROM (SELECT array_to_string(list_filter(string_split(unnest(string_split(text, chr(10))), ' '), lambda x: trim(x) <> ''), '  ') AS line FROM documents WHERE text IS NOT NULL) GROUP BY line")
def segmented_writer(spark, sf):
    """Token lines written by the sink and read back."""
    t = load(spark, sf, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).select(F.split("line", " ").alias("tokens"))
    path = new_path(spark, "segmented")
    sinks.write_lines(t, "tokens", path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@C.add("ordered_json_writer", "SELECT count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def ordered_json_writer(spark, sf):
    path = new_path(spark, "orders")
    sinks.write_json_in_order(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", path)
    return spark.read.schema("o_orderkey long").json(path).agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
