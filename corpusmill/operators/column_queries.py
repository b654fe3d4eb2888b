"""One query for each column function of scripts, links, formats and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clusters, legacy_rules, links, script, splitters
from ..plans.catalog import Catalog, load
from ..sources import sinks
from .text_queries import prefix_pairs

C = Catalog()
_MM = script.as_myanmar_sql("coalesce(text, '')")
_CHARS = f"(SELECT DISTINCT unnest(string_split({_MM}, '')) AS ch FROM documents)"


def _text(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", script.as_myanmar(F.coalesce("text", F.lit(""))).alias("t"))


def _chars(spark, sf) -> DataFrame:
    return _text(spark, sf).select(F.explode(F.split("t", "")).alias("ch")).where("ch <> ''").distinct()


# ---- script


@C.add("base_consonants", f"SELECT ch, regexp_matches(ch, '[{script.BASE}]') AS base FROM {_CHARS} WHERE ch <> ''")
def base_consonants(spark, sf):
    return _chars(spark, sf).select("ch", script.is_base(F.col("ch")).alias("base"))


@C.add("dependent_marks", f"SELECT ch, regexp_matches(ch, '[{script.MARK_ORDER}]') AS mark FROM {_CHARS} WHERE ch <> ''")
def dependent_marks(spark, sf):
    return _chars(spark, sf).select("ch", script.is_mark(F.col("ch")).alias("mark"))


@C.add("script_characters", f"SELECT ch, regexp_matches(ch, '[က-႟]') AS script FROM {_CHARS} WHERE ch <> ''")
def script_characters(spark, sf):
    return _chars(spark, sf).select("ch", script.is_script(F.col("ch")).alias("script"))


def _rate(name: str) -> None:
    @C.add(f"{name}_rate", f"SELECT doc_id, round({name}, 9) AS rate FROM ({script.structural_score_sql(_MM)})")
    def rate(spark, sf):
        return _text(spark, sf).select("doc_id", F.round(clusters.structural_score(F.col("t"))[name], 9).alias("rate"))


for _name in ("orphan", "disorder", "duplicate"):
    _rate(_name)

_P = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 2 THEN '-Infinity'::DOUBLE WHEN event_id % 11 = 3 THEN 'Infinity'::DOUBLE ELSE value / 100 END"


def _probabilities(spark, sf) -> DataFrame:
    k = F.col("event_id") % 11
    p = F.when(k == 0, F.lit(None)).when(k == 1, float("nan")).when(k == 2, float("-inf")).when(k == 3, float("inf")).otherwise(F.col("value") / 100)
    return load(spark, sf, "events").select("event_id", p.alias("p"))


@C.add("detect_threshold", f"SELECT event_id, CASE WHEN p IS NULL OR isnan(p) OR p = '-Infinity'::DOUBLE THEN 'UNKNOWN' WHEN p > 0.5 THEN 'FIRST' ELSE 'SECOND' END AS category FROM (SELECT event_id, {_P} AS p FROM events)")
def detect_threshold(spark, sf):
    return _probabilities(spark, sf).select("event_id", script.encoding_category(F.col("p")).alias("category"))


@C.add("category_normaliser", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE event_type END AS category FROM events")
def category_normaliser(spark, sf):
    other = F.when(F.col("event_type") == "error", "OTHER").otherwise(F.col("event_type"))
    return load(spark, sf, "events").select("event_id", script.known_category(other).alias("category"))


@C.add("safe_probabilities", f"SELECT event_id, CASE WHEN p IS NULL OR isnan(p) OR isinf(p) THEN 0 ELSE round(p, 9) END AS p FROM (SELECT event_id, {_P} AS p FROM events)")
def safe_probabilities(spark, sf):
    return _probabilities(spark, sf).select("event_id", F.round(script.safe_probability(F.col("p")), 9).alias("p"))


@C.add("digit_translation", f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '-x' AS plain FROM orders WHERE translate('၁', '{script.DIGITS}', '0123456789') = '1'")
def digit_translation(spark, sf):
    shown = F.translate(F.concat(F.col("o_orderkey").cast("string"), F.lit("-x")), "0123456789", script.DIGITS)
    return load(spark, sf, "orders").select("o_orderkey", script.to_arabic_digits(shown).alias("plain"))


_WORDS = r"(SELECT DISTINCT unnest(regexp_split_to_array(coalesce(text, ''), '\s+')) AS w FROM documents)"


def _words(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("w")).where("w <> ''").distinct()


@C.add("hash_tokens", f"SELECT w, regexp_full_match(w, '[A-Za-z0-9._-]{{1,128}}') AND NOT contains(w, '..') AS ok FROM {_WORDS} WHERE w <> ''")
def hash_tokens(spark, sf):
    return _words(spark, sf).select("w", links.is_token(F.col("w")).alias("ok"))


@C.add("token_class_of_words", rf"SELECT w, CASE WHEN regexp_full_match(w, '[0-9][0-9.,/\-]*') THEN 'number' WHEN regexp_full_match(w, '[!-/:-@\[-`{{-~]+') THEN 'pan' WHEN regexp_full_match(w, '[A-Za-z]+') THEN 'en' ELSE '?' END AS class FROM {_WORDS} WHERE w <> ''")
def token_class_of_words(spark, sf):
    return _words(spark, sf).select("w", script.token_class(F.col("w")).alias("class"))


@C.add("legacy_conversion")
def legacy_conversion(spark, sf):
    """Every text through the ordered rules from the legacy encoding; other letters of the rules never meet here, so tests have them."""
    return _text(spark, sf).select("doc_id", F.md5(script.converted(F.col("t"), legacy_rules.RULES)).alias("digest"))


# ---- files and agents


@C.add("pdf_signatures", "SELECT doc_id, CASE WHEN doc_id % 2000 <= 1019 THEN CAST(doc_id % 2000 AS INT) END AS at FROM documents")
def pdf_signatures(spark, sf):
    head = F.concat(F.repeat(F.lit("x"), (F.col("doc_id") % 2000).cast("int")), F.lit("%PDF-1.7"), "text")
    return load(spark, sf, "documents").select("doc_id", links.pdf_offset(F.coalesce(head, F.lit(""))).alias("at")).where("doc_id is not null")


_AGENT = "CASE user_id % 5 WHEN 0 THEN 'Wget/1.2' WHEN 1 THEN 'Mozilla Googlebot/2' WHEN 2 THEN 'JAVA/17' WHEN 3 THEN NULL ELSE 'Mozilla/5.0' END"


def _agents(spark, sf) -> DataFrame:
    k = F.col("user_id") % 5
    return load(spark, sf, "events").select("event_id", "event_type", F.when(k == 0, "Wget/1.2").when(k == 1, "Mozilla Googlebot/2").when(k == 2, "JAVA/17").when(k == 3, F.lit(None)).otherwise("Mozilla/5.0").alias("agent"))


@C.add("downloader_agents", f"SELECT event_id, coalesce(regexp_matches(lower({_AGENT}), 'wget|java/[0-9]'), FALSE) AS downloader, coalesce(regexp_matches(lower({_AGENT}), 'googlebot'), FALSE) AS friendly FROM events")
def downloader_agents(spark, sf):
    return _agents(spark, sf).select("event_id", links.is_downloader(F.col("agent")).alias("downloader"), links.is_friendly(F.col("agent")).alias("friendly"))


@C.add("document_requests", "SELECT event_id, CASE event_type WHEN 'view' THEN TRUE WHEN 'click' THEN FALSE ELSE event_id % 2 = 0 END AS document FROM events")
def document_requests(spark, sf):
    dest = F.when(F.col("event_type") == "view", "Document").when(F.col("event_type") == "click", "image").otherwise("")
    accept = F.when(F.col("event_id") % 2 == 0, "text/html,*/*").otherwise(F.lit(None))
    return load(spark, sf, "events").select("event_id", links.is_document_request(dest, accept).alias("document"))


# ---- links: pages under hosts and queries of many kinds

_HOSTS = ("example.org", "www.example.org", "drive.google.com", "x.mega.nz", "www.mediafire.com", "evil-mega.nz", "sub.wiki.example", "video.example", "TERABOX.com")
_TAILS = ("", "?q=1", "/search/a", "/b.PDF", "?id=1&utm_source=z", "?share=x", "/file/d/abcdefghij12345/view", "?id=abcdefghij12345&fbclid=2", "/c.docx?x=1#f", "?AMP=1")
_SQL_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_URLS = f"(SELECT page_id, 'https://' || {_SQL_LIST(_HOSTS)}[page_id % {len(_HOSTS)} + 1] || '/p' || (page_id % 13) || {_SQL_LIST(_TAILS)}[page_id % {len(_TAILS)} + 1] AS u, lower({_SQL_LIST(_HOSTS)}[page_id % {len(_HOSTS)} + 1]) AS h, {_SQL_LIST(_TAILS)}[page_id % {len(_TAILS)} + 1] AS tail, page_id % 13 AS k FROM pages)"


def _urls(spark, sf) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("page_id") % len(xs) + 1).cast("int"))
    u = F.concat(F.lit("https://"), pick(_HOSTS), F.lit("/p"), F.col("page_id") % 13, pick(_TAILS))
    return load(spark, sf, "pages").select("page_id", u.alias("u"))


def _url(name: str, sql: str, column: str):
    """Register a query of one function of the URLs above."""

    def add(f) -> None:
        @C.add(name, f"SELECT page_id, {sql} AS {column} FROM {_URLS}")
        def query(spark, sf):
            return _urls(spark, sf).select("page_id", f(F.col("u")).alias(column))

    return add


_IN = lambda *ds: "(" + " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in ds) + ")"
_PROVIDER = f"CASE WHEN {_IN('drive.google.com')} THEN 'drive' WHEN {_IN('mega.nz')} THEN 'mega' WHEN {_IN('mediafire.com')} THEN 'mediafire' WHEN {_IN('terabox.com')} THEN 'terabox' END"
_DOC = "(tail = '/b.PDF' OR starts_with(tail, '/c.docx'))"
FAMILIES = {"wiki": ("wiki.example",), "video": ("video.example", "film.example"), "files": ("mega.nz",)}

_url("url_hostname", "h", "host")(links.host)
_url("url_site_key", "regexp_replace(h, '^www\\.', '')", "site")(links.site_key)
_url("domain_suffix_match", _IN("mega.nz"), "matched")(lambda u: links.in_domain(links.host(u), "mega.nz"))
_url("site_exclusion", f"CASE WHEN {_IN('wiki.example')} THEN 'wiki' WHEN {_IN('video.example', 'film.example')} THEN 'video' WHEN {_IN('mega.nz')} THEN 'files' END", "reason")(lambda u: links.exclusion(links.host(u), FAMILIES))
_url("search_pages", "tail IN ('?q=1', '/search/a')", "search")(links.is_search)
_url("document_paths", _DOC, "document")(links.is_document)
_url("provider_kinds", _PROVIDER, "provider")(links.provider)
_url("download_likeness", f"({_DOC} OR {_PROVIDER} IS NOT NULL)", "download")(links.looks_like_download)
_url("drive_ids", "CASE WHEN contains(tail, 'abcdefghij12345') THEN 'abcdefghij12345' END", "drive_id")(links.drive_id)
_url("guarded_urls", "CASE WHEN tail IN ('?share=x', '?AMP=1') THEN NULL ELSE 'https://' || h || '/p' || k || replace(replace(regexp_replace(tail, '#.*$', ''), '&utm_source=z', ''), '&fbclid=2', '') END", "guarded")(links.guard)
_url("url_path_chain", "CASE WHEN starts_with(tail, '/') THEN '/p' || k || '/' || string_split(regexp_replace(tail, '[?#].*$', ''), '/')[2] ELSE '/p' || k END", "second")(lambda u: F.element_at(F.slice(links.ancestors(u), 1, 2), -1))


@C.add("url_variant_forms", f"""
SELECT page_id, unnest(list_distinct(['https://' || h || '/p' || k || t, 'https://' || h || '/p' || k || regexp_replace(t, '\\?.*$', ''), 'https://' || h || '/p' || k || replace(replace(t, '&utm_source=z', ''), '&fbclid=2', '')])) AS variant
FROM (SELECT page_id, h, k, regexp_replace(tail, '#.*$', '') AS t FROM {_URLS})""")
def url_variant_forms(spark, sf):
    return _urls(spark, sf).select("page_id", F.explode(links.variants(F.col("u"))).alias("variant"))


@C.add("prefix_children", f"SELECT a.page_id AS parent, b.page_id AS child FROM {_URLS} a JOIN {_URLS} b ON a.h = b.h AND a.k = b.k AND NOT starts_with(a.tail, '/') AND starts_with(b.tail, '/')")
def prefix_children(spark, sf):
    """Pairs of one host where the second path extends the first; joined by the paths in front of each slash."""
    return prefix_pairs(_urls(spark, sf), "u")


@C.add("query_children", f"SELECT a.page_id AS parent, b.page_id AS child FROM {_URLS} a JOIN {_URLS} b ON a.h = b.h AND a.k = b.k AND NOT starts_with(a.tail, '/') AND starts_with(b.tail, '?') AND a.tail <> b.tail")
def query_children(spark, sf):
    """Pairs of one host and path where the second has another query."""
    p = _urls(spark, sf).select("*", links.host(F.col("u")).alias("h"), links.part(F.col("u"), 5).alias("path"))
    a, b = p.alias("a"), p.alias("b")
    same = (F.col("a.h") == F.col("b.h")) & (F.col("a.path") == F.col("b.path")) & links.is_query_child(F.col("b.u"), F.col("a.u"))
    return a.join(b, same).select(F.col("a.page_id").alias("parent"), F.col("b.page_id").alias("child"))


# ---- formats of token lines



def _tokens(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "[ \n]").alias("w"))


_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]'), lambda x: trim(x) <> '')"


@C.add("syllable_lines", f"SELECT doc_id, md5(array_to_string({_W}, '  ')) AS digest FROM documents")
def syllable_lines(spark, sf):
    return _tokens(spark, sf).select("doc_id", F.md5(sinks.line_format(F.col("w"))).alias("digest"))


_TAGS = lambda w: f"CASE length({w}) % 3 WHEN 0 THEN '' WHEN 1 THEN '{{n}}' ELSE '{{n,v}}' END"


def _tagged(w: Column) -> Column:
    k = F.length(w) % 3
    tags = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("n"))).otherwise(F.array(F.lit("n"), F.lit("v")))
    return F.struct(F.translate(w, "{}", "()").alias("surface"), tags.alias("tags"))


@C.add("tagged_lines", f"SELECT doc_id, md5(array_to_string(list_transform({_W}, lambda x: translate(x, '{{}}', '()') || {_TAGS('x')}), '  ')) AS digest FROM documents")
def tagged_lines(spark, sf):
    some = F.filter("w", lambda x: F.trim(x) != "")
    return _tokens(spark, sf).select("doc_id", F.md5(sinks.tagged_format(F.transform(some, _tagged))).alias("digest"))


@C.add("tagged_round_trip", f"SELECT doc_id, len({_W}) AS tokens, coalesce(CAST(list_sum(list_transform({_W}, lambda x: length(x) % 3)) AS BIGINT), 0) AS tags FROM documents")
def tagged_round_trip(spark, sf):
    """Tagged lines parsed again: as many tokens and tags as were written."""
    some = F.filter("w", lambda x: F.trim(x) != "")
    back = _tokens(spark, sf).select("doc_id", sinks.parse_tagged(sinks.tagged_format(F.transform(some, _tagged))).alias("b"))
    return back.select("doc_id", F.size("b").cast("bigint").alias("tokens"), F.aggregate("b", F.lit(0), lambda a, x: a + F.size(x["tags"])).cast("bigint").alias("tags"))


@C.add("positional_encoding", f"SELECT doc_id, k, w[1] AS first, length(w) - 1 AS rest FROM (SELECT doc_id, unnest({_W}) AS w, unnest(range(1, len({_W}) + 1)) AS k FROM documents)")
def positional_encoding(spark, sf):
    p = _tokens(spark, sf).select("doc_id", F.posexplode(sinks.position_format(F.col("w"))).alias("k", "p"))
    return p.select("doc_id", (F.col("k") + 1).cast("bigint").alias("k"), F.col("p.index").alias("first"), F.col("p.syllable").cast("bigint").alias("rest"))


@C.add("chapter_specs", "SELECT p_partkey, unnest(list_distinct(list_concat(range(p_size, p_size + 3), [p_size + 1, p_size + 9]))) AS chapter FROM part WHERE p_partkey % 5 <> 0")
def chapter_specs(spark, sf):
    """``a-b, c`` specifications as numbers; reversed ranges give none."""
    n = F.col("p_size")
    spec = F.when(F.col("p_partkey") % 5 == 0, F.concat(n + 2, F.lit("-"), n)).otherwise(F.concat(n, F.lit("-"), n + 2, F.lit(", "), n + 1, F.lit(",,"), n + 9))
    return load(spark, sf, "part").select("p_partkey", F.explode(links.ranges_of(spec)).alias("chapter"))


@C.add("markdown_rows", "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_partkey % 3 = 0")
def markdown_rows(spark, sf):
    """Cells of table lines; rules and other lines have none."""
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("|  "), "p_name", F.lit(" | "), "p_size", F.lit("|  "))).when(k == 1, "| --- | :-: |").otherwise(F.col("p_name"))
    c = load(spark, sf, "part").select("p_partkey", splitters.table_row(line).alias("c")).where("c is not null")
    return c.select("p_partkey", F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(1)).alias("size"))
