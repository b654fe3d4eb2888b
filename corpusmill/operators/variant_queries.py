"""Queries over normaliser variants, legacy layouts, readings, variants of words and files in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clusters, layout, legacy_rules, script, tries
from ..plans.catalog import Catalog, load
from ..plans.storage import new_path
from ..sources import files, pdf, sinks, writers
from .repair_queries import lexicon

C = Catalog()
_T = "coalesce(text, '')"
_MM = script.as_myanmar_sql(_T)


def _docs(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))


def _texts(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", script.as_myanmar(F.coalesce("text", F.lit(""))).alias("t"))


# ---- normaliser variants


@C.add("wrapped_blocks", rf"""
SELECT doc_id, md5(array_to_string(list_transform(parts, lambda p, k: CASE WHEN k % 2 = 0 THEN '{{' || regexp_replace(p, ' +', ' ', 'g') || '}}' ELSE p END), '')) AS digest
FROM (SELECT doc_id, string_split_regex(regexp_replace(translate({_T}, '{{}}', ''), '{layout.BLOCK}', '{{\1}}\2', 'g'), '[{{}}]') AS parts FROM documents)""")
def wrapped_blocks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(layout.wrap_blocks(F.col("t"))).alias("digest"))


@C.add("deleted_blocks", rf"SELECT doc_id, md5(regexp_replace({_T}, '{layout.BLOCK}', '\2', 'g')) AS digest FROM documents")
def deleted_blocks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(layout.delete_blocks(F.col("t"))).alias("digest"))


def _replaced_sql(t: str) -> str:
    for k in sorted(layout.IMPOSTERS, key=len, reverse=True):
        t = f"replace({t}, '{k}', '{layout.IMPOSTERS[k]}')"
    return t


@C.add("imposters_in_turn", f"SELECT doc_id, md5({_replaced_sql(_MM)}) AS digest FROM documents")
def imposters_in_turn(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5(layout.replace_in_turn(F.col("t"), layout.IMPOSTERS)).alias("digest"))


@C.add("normaliser_modes")
def normaliser_modes(spark, sf):
    """Each text by the three modes of the normaliser; half of a text keeps its Latin letters."""
    half = F.concat(F.col("t"), F.lit(" "), F.reverse("raw"))
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw")).withColumn("t", script.as_myanmar(F.col("raw"))).select("doc_id", half.alias("t"))
    m = d.select("doc_id", layout.every_mode(F.col("t")).alias("m"))
    return m.select("doc_id", *[F.md5(F.col(f"m.{name}")).alias(name) for name in layout.MODES[:-1]])


@C.add("normalised_scan")
def normalised_scan(spark, sf):
    """Lines of a file by the mapper's normaliser, equal ones counted."""
    path = new_path(spark, "normalised")
    _texts(spark, sf).select("t").write.text(path)
    lines = files.loose_lines(spark, path).select(layout.mapper_normalise(F.col("line")).alias("line"))
    return lines.groupBy(F.md5("line").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


# ---- legacy layouts and readings


@C.add("digit_letters")
def digit_letters(spark, sf):
    """Digits and letters of one shape told apart by their neighbours; t and k of the texts stand for such letters."""
    return _texts(spark, sf).select("doc_id", F.md5(layout.digit_letters(F.translate("t", "တစ", "ရ၀"))).alias("digest"))


@C.add("legacy_layouts")
def legacy_layouts(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5(layout.legacy_layout(F.col("t"))).alias("digest"))


@C.add("chosen_readings")
def chosen_readings(spark, sf):
    """As it is, converted from the legacy encoding, or from back to front; every third text is written from back to front."""
    d = _texts(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.reverse("t")).otherwise(F.col("t")).alias("t"))
    kinds = (("own", F.col("t")), ("converted", script.converted(F.col("t"), legacy_rules.RULES)), ("reversed", F.reverse("t")))
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("kind"), text.alias("text")) for k, (name, text) in enumerate(kinds)])
    r = layout.choose_readings(d.select("doc_id", F.inline(rows)))
    return r.select("doc_id", "kind", F.md5("text").alias("digest"), F.round("score", 9).alias("score"))


_HEADS = ("", "﻿", " \n\t", "<!-- a <b> -->\n", "<!-- open ", "text ", "<!-- a --><!-- b -->")
_HEAD_SQL = "[" + ", ".join("'" + h.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for h in _HEADS) + "]"
_PAGE_SQL = f"lower(left({_HEAD_SQL}[page_id % {len(_HEADS)} + 1] || html, 1024))"


@C.add("page_signatures", f"SELECT page_id, coalesce(regexp_matches(regexp_replace({_PAGE_SQL}, '{layout.LEAD}', ''), '{layout.PAGE}'), FALSE) AS page FROM pages")
def page_signatures(spark, sf):
    """Whether pages behind heads of several kinds are taken for HTML."""
    heads = F.array(*[F.lit(h) for h in _HEADS])
    start = F.element_at(heads, (F.col("page_id") % len(_HEADS) + 1).cast("int"))
    return load(spark, sf, "pages").select("page_id", layout.looks_like_page(F.concat(start, "html")).alias("page"))


# ---- variants of words


def sole_words(tokens: DataFrame, words: DataFrame, damaged) -> DataFrame:
    """``token, word, n``: tokens (``token, n``) that exactly one word could have become.

    ``damaged`` gives, from a word, an array of the tokens that damage makes of it.  Variants are made of
    the words, which are few, and not of the tokens, which are many and may be long; tokens that are
    words are left alone.
    """
    made = words.select("word", F.explode(damaged(F.col("word"))).alias("token")).distinct()
    unknown = tokens.join(words.select(F.col("word").alias("token")), "token", "left_anti")
    found = unknown.join(made, "token").groupBy("token", "n").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("word"))
    return found.where("words = 1").select("token", "word", "n")


def _places(word: Column, mark: str, least: int) -> Column:
    k = F.sequence(F.lit(least), F.greatest(F.length(word), F.lit(least)))
    return F.filter(k, lambda i: F.substring(word, i, F.lit(1)).rlike(f"[{mark}]"))


def without_a_mark(word: Column) -> Column:
    """The word with one mark behind its first letter dropped."""
    return F.transform(_places(word, script.MARK_ORDER, 2), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def with_an_i(word: Column) -> Column:
    """The word with an i put before one of its u."""
    return F.transform(_places(word, "ု", 1), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit("ိ"), F.substring(word, i, F.length(word))))


def _damaged_tokens(spark, sf, pattern: str, by: str) -> tuple[DataFrame, DataFrame]:
    d = _texts(spark, sf)
    t = d.select(F.explode(F.split("t", r"\s+")).alias("token")).where("token <> ''")
    t = t.select(F.when(F.length("token") % 3 == 1, F.regexp_replace("token", pattern, by)).otherwise(F.col("token")).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")), lexicon(d)


def _sole_sql(pattern: str, by: str, variant: str, least: int, mark: str) -> str:
    by = by.replace("$", "\\")
    return rf"""
WITH d AS (SELECT doc_id, {_MM} AS t FROM documents),
w AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(t, '\s+'))) AS word FROM d) WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= 3),
k AS (SELECT token, count(*) AS n FROM (SELECT CASE WHEN length(token) % 3 = 1 THEN regexp_replace(token, '{pattern}', '{by}') ELSE token END AS token FROM (SELECT unnest(regexp_split_to_array(t, '\s+')) AS token FROM d) WHERE token <> '') GROUP BY token),
v AS (SELECT DISTINCT word, {variant} AS token FROM (SELECT word, unnest(range({least}, length(word) + 1)) AS i FROM w) WHERE substr(word, i, 1) SIMILAR TO '[{mark}]')
SELECT token, min(word) AS word, n FROM k JOIN v USING (token) WHERE token NOT IN (SELECT word FROM w) GROUP BY token, n HAVING count(*) = 1"""


_DROP = (f"^(.[^{script.MARK_ORDER}]*)[{script.MARK_ORDER}](.*)$", "$1$2")
_PUT = ("^([^ု]*)ု(.*)$", "$1ို$2")


@C.add("lost_mark_words", _sole_sql(*_DROP, "substr(word, 1, i - 1) || substr(word, i + 1)", 2, script.MARK_ORDER))
def lost_mark_words(spark, sf):
    """Tokens that are one word of the lexicon less a mark; a third of the tokens had their first mark taken."""
    return sole_words(*_damaged_tokens(spark, sf, *_DROP), without_a_mark)


@C.add("spurious_i_words", _sole_sql(*_PUT, "substr(word, 1, i - 1) || 'ိ' || substr(word, i)", 1, "ု"))
def spurious_i_words(spark, sf):
    """Tokens that are one word of the lexicon with an i before its u; a third of the tokens were given one."""
    return sole_words(*_damaged_tokens(spark, sf, *_PUT), with_an_i)


@C.add("cluster_counts", f"""
SELECT doc_id, CAST(len(c) AS INT) AS clusters, CAST(coalesce(list_sum(list_transform(c, lambda x: length(x))), 0) AS INT) AS covered
FROM (SELECT doc_id, regexp_extract_all({_MM}, '[က-ဪဿ](?:[{script.MARK_ORDER}]|္[က-ဪ])*') AS c FROM documents)""")
def cluster_counts(spark, sf):
    """Clusters of each text and the characters that they cover, by their spans."""
    d = _texts(spark, sf).select("doc_id", clusters.spans(F.col("t")).alias("s"))
    return d.select("doc_id", F.size("s").alias("clusters"), F.aggregate("s", F.lit(0), lambda n, x: n + x["b"] - x["a"]).alias("covered"))


_SHORT = "CASE WHEN i % 4 = 0 AND length(w) > 3 THEN [left(w, 2), substr(w, 3)] ELSE [w] END"


@C.add("fragment_classes", rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_T}, '\s+'), lambda x: x <> '') AS ws FROM documents),
lex AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(ws)) AS word FROM d) WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= 3),
p AS (SELECT doc_id, unnest(flatten(list_transform(ws, lambda w, i: {_SHORT.replace("i %", "(i - 1) %")}))) AS token, unnest(range(len(flatten(list_transform(ws, lambda w, i: {_SHORT.replace("i %", "(i - 1) %")}))))) AS k FROM d),
l AS (SELECT token, lag(token, 1) OVER w || token AS t1, lag(token, 2) OVER w || lag(token, 1) OVER w || token AS t2, lag(token, 3) OVER w || lag(token, 2) OVER w || lag(token, 1) OVER w || token AS t3 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT class, count(*) AS n FROM (
  SELECT CASE WHEN token IN (SELECT word FROM lex) THEN 'word'
    WHEN coalesce(t1 IN (SELECT word FROM lex), FALSE) OR coalesce(t2 IN (SELECT word FROM lex), FALSE) OR coalesce(t3 IN (SELECT word FROM lex), FALSE) THEN 'unit'
    WHEN regexp_full_match(token, '[A-Za-z]+') THEN 'loan' ELSE 'unknown' END AS class FROM l) GROUP BY class""")
def fragment_classes(spark, sf):
    """Tokens that are words, end a word that up to three tokens before begin, are Latin, or unknown; every fourth word was cut in two.

    Joins stay inside a text: its tokens are an array, so what stands before a token needs no window.
    """
    d = _docs(spark, sf).select("doc_id", F.filter(F.split("t", r"\s+"), lambda x: x != "").alias("ws"))
    path = new_path(spark, "lexicon")
    lexicon(d.select("doc_id", F.array_join("ws", " ").alias("t"))).write.parquet(path)
    words = spark.read.schema("word string").parquet(path)
    cut = F.flatten(F.transform("ws", lambda w, i: F.when((i % 4 == 0) & (F.length(w) > 3), F.array(F.left(w, F.lit(2)), F.substring(w, F.lit(3), F.length(w)))).otherwise(F.array(w))))
    at = d.select(cut.alias("p")).select("p", F.posexplode("p").alias("k", "token"))
    back = lambda n: F.when(F.col("k") >= n, F.array_join(F.slice("p", F.col("k") - n + 1, n + 1), ""))
    at = at.select("token", *[back(n).alias(f"t{n}") for n in (1, 2, 3)])
    few = words.count() <= tries.MOST
    # a lexicon of that size is shared, so that no token is exchanged; else equal tokens behind equal ones are looked up once
    at = at.withColumn("n", F.lit(1).cast("bigint")) if few else at.groupBy("token", "t1", "t2", "t3").agg(F.count(F.lit(1)).alias("n"))
    for c in ("token", "t1", "t2", "t3"):
        known = words.select(F.col("word").alias(c), F.lit(True).alias(f"is_{c}"))
        at = at.join(F.broadcast(known) if few else known.hint("merge"), c, "left")
    is_ = lambda c: F.coalesce(f"is_{c}", F.lit(False))
    kind = F.when(is_("token"), "word").when(is_("t1") | is_("t2") | is_("t3"), "unit").when(F.col("token").rlike(r"^[A-Za-z]+\z"), "loan").otherwise("unknown")
    return at.groupBy(kind.alias("class")).agg(F.sum("n").alias("n"))


# ---- files in memory and sinks


def _named(spark, sf) -> DataFrame:
    return _docs(spark, sf).select("doc_id", "source", F.col("doc_id").cast("string").alias("path"), F.regexp_replace("t", r"[\x00-\x08\x0b-\x1f\x{FFFE}\x{FFFF}]", "").alias("t"))


_CLEAN = rf"regexp_replace({_T}, '[\x00-\x08\x0b-\x1f\x{{FFFE}}\x{{FFFF}}]', '', 'g')"
_LINES = f"(SELECT doc_id, source, string_split({_CLEAN}, chr(10)) AS ls FROM documents)"


@C.add("docx_paragraph_scan", f"SELECT doc_id, CAST(unnest(range(len(ls))) AS BIGINT) AS k, md5(unnest(ls)) AS digest FROM {_LINES}")
def docx_paragraph_scan(spark, sf):
    """Texts written as word-processing documents, a paragraph a line, and read back."""
    d = _named(spark, sf).select("path", writers.docx(F.split("t", "\n")).alias("content"))
    return files.by_file(d, files.docx_paragraphs, files.DOCX).select(F.col("path").cast("bigint").alias("doc_id"), "k", F.md5("paragraph").alias("digest"))


@C.add("docx_heading_scan", f"SELECT doc_id, k, CASE WHEN k % 3 = 0 THEN 'ZH' ELSE 'MY' END AS tag, md5(h) AS digest FROM (SELECT doc_id, CAST(unnest(range(len(ls))) AS BIGINT) AS k, unnest(ls) AS h FROM {_LINES}) WHERE k % 3 < 2")
def docx_heading_scan(spark, sf):
    """Paragraphs that begin with a heading's mark, in order."""
    marked = F.transform(F.split("t", "\n"), lambda x, k: F.concat(F.when(k % 3 == 0, "[ZH] ").when(k % 3 == 1, "[MY] ").otherwise("- "), x))
    d = _named(spark, sf).select("path", writers.docx(marked).alias("content"))
    return files.headings(files.by_file(d, files.docx_paragraphs, files.DOCX)).select(F.col("path").cast("bigint").alias("doc_id"), "k", "tag", F.md5("heading").alias("digest"))


_PAGES_SQL = f"(SELECT doc_id, source, list_filter(ls, lambda x: trim(x) <> '') AS ls FROM {_LINES})"


def _pdfs(spark, sf) -> DataFrame:
    """A file a text: a page for every twenty lines that aren't blank, the source as its title."""
    d = _named(spark, sf).withColumn("ls", F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""))
    n = F.ceil(F.size("ls") / 20).cast("int")
    pages = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice("ls", k * 20 + 1, F.lit(20))))
    return d.select("path", writers.pdf(pages, F.col("source")).alias("content"))


@C.add("pdf_page_scan", f"""
SELECT doc_id, k AS page, md5(array_to_string(ls[k * 20 + 1 : k * 20 + 20], chr(10))) AS digest
FROM (SELECT doc_id, ls, CAST(unnest(range(CAST(ceil(len(ls) / 20) AS BIGINT))) AS BIGINT) AS k FROM {_PAGES_SQL})""")
def pdf_page_scan(spark, sf):
    """The text of each page of PDF files, found by their page tree and read by their fonts' maps."""
    return files.by_file(_pdfs(spark, sf), pdf.pages, pdf.PAGES).select(F.col("path").cast("bigint").alias("doc_id"), "page", F.md5("text").alias("digest"))


@C.add("pdf_object_scan", f"SELECT doc_id, CAST(5 + 2 * ceil(len(ls) / 20) AS BIGINT) AS objects, CAST(ceil(len(ls) / 20) AS BIGINT) AS pages FROM {_PAGES_SQL}")
def pdf_object_scan(spark, sf):
    o = files.by_file(_pdfs(spark, sf), files.pdf_objects, files.PDF)
    page = F.col("dictionary").rlike(r"/Type /Page\b(?!s)").cast("int")
    return o.groupBy(F.col("path").cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("objects"), F.sum(page).alias("pages"))


@C.add("pdf_metadata", "SELECT doc_id, 'Title' AS field, source AS value FROM documents WHERE source IS NOT NULL AND source <> ''")
def pdf_metadata(spark, sf):
    m = files.by_file(_pdfs(spark, sf), pdf.metadata, pdf.METADATA).where("value <> ''")
    return m.select(F.col("path").cast("bigint").alias("doc_id"), "field", "value")


@C.add("zip_member_scan", f"""
SELECT source, doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.txt' END AS name, CAST(octet_length(encode({_T})) AS BIGINT) AS size, doc_id % 3 = 0 AS pdf
FROM documents WHERE source IS NOT NULL""")
def zip_member_scan(spark, sf):
    """Members of archives, from their directories; an archive holds at most a hundred ids of one source."""
    name = F.concat("doc_id", F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(".txt"))
    member = F.struct(name.alias("name"), F.encode("t", "utf-8").alias("data"))
    d = _docs(spark, sf).groupBy("source", F.coalesce(F.floor(F.col("doc_id") / 100), F.pmod(F.xxhash64("t"), F.lit(1 << 20))).alias("part")).agg(F.collect_list(member).alias("members"))
    d = d.select(F.col("source").alias("path"), writers.archive(F.col("members")).alias("content")).where("path is not null")
    return files.by_file(d, files.zip_members, files.ZIP).select(F.col("path").alias("source"), "name", "size", "pdf")


@C.add("journal_append", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS records FROM events GROUP BY event_type")
def journal_append(spark, sf):
    """Records appended in two writes; each is whole, and none is there twice."""
    e, path = load(spark, sf, "events").select("event_id", "event_type"), new_path(spark, "journal")
    for k in (0, 1):
        sinks.append_json(e.where(F.col("event_id") % 2 == k), path)
    j = spark.read.schema("event_id bigint, event_type string").json(path)
    return j.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("records"))


@C.add("memory_export", "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def memory_export(spark, sf):
    """Rows exported in order of their ids and read back."""
    c, path = load(spark, sf, "conversations"), new_path(spark, "memory")
    key = F.format_string("%012d-%06d", F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"))
    sinks.write_json_in_order(c.select(key.alias("id"), "conv_id", "turn", "text"), "id", path)
    return spark.read.schema("conv_id bigint, turn int, text string").json(path).select("conv_id", "turn", F.md5("text").alias("digest"))
