"""Queries over the script, number and identity functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clusters, links, script
from ..plans.catalog import Catalog, load

C = Catalog()
_MM = script.as_myanmar_sql("coalesce(text, '')")


def _docs(spark, sf) -> DataFrame:
    return load(spark, sf, "documents")


@C.add("structural_score", f"""
SELECT doc_id, round(CASE WHEN marks > 0 THEN 1 - greatest(orphan, disorder) ELSE 0 END, 9) AS score, round(orphan, 9) AS orphan,
  round(disorder, 9) AS disorder, round(duplicate, 9) AS duplicate, marks,
  round(CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[က-႟]')) / length(t) ELSE 0 END, 9) AS ratio
FROM ({script.structural_score_sql(_MM)})""")
def structural_score(spark, sf):
    s = clusters.with_structural_score(_docs(spark, sf), script.as_myanmar(F.col("text")))
    return s.select("doc_id", *[F.round(c, 9).alias(c) for c in ("score", "orphan", "disorder", "duplicate", "ratio")], "marks")


@C.add("structural_quality_gate", f"""
SELECT lang, route, count(*) AS n FROM (
  SELECT d.lang, CASE WHEN s.marks < 50 THEN 'thin' WHEN 1 - greatest(orphan, disorder) >= 0.85 THEN 'clean' WHEN orphan > disorder THEN 'orphans' ELSE 'order' END AS route
  FROM ({script.structural_score_sql(_MM)}) s JOIN documents d USING (doc_id)) GROUP BY ALL""")
def structural_quality_gate(spark, sf):
    s = clusters.with_structural_score(_docs(spark, sf).select("lang", "text"), script.as_myanmar(F.col("text")))
    route = F.when(F.col("marks") < 50, "thin").when(F.col("score") >= 0.85, "clean").when(F.col("orphan") > F.col("disorder"), "orphans").otherwise("order")
    return s.groupBy("lang", route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@C.add("character_classes", f"""
SELECT ch, bool_or(ch SIMILAR TO '[{script.BASE}]') AS base, bool_or(ch SIMILAR TO '[{script.MARK_ORDER}]') AS mark, bool_or(ch SIMILAR TO '[က-႟]') AS script, count(*) AS n
FROM (SELECT unnest(string_split({_MM}, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch""")
def character_classes(spark, sf):
    ch = _docs(spark, sf).select(F.explode(F.split(script.as_myanmar(F.col("text")), "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return ch.select("ch", script.is_base(F.col("ch")).alias("base"), script.is_mark(F.col("ch")).alias("mark"), script.is_script(F.col("ch")).alias("script"), "n")


@C.add("scan_counts", f"""
SELECT doc_id, len(regexp_extract_all(regexp_replace(t, '[{script.SCAN_BASE}][{script.MARK_ORDER}]*', '', 'g'), '[{script.MARK_ORDER}]')) AS orphan,
  {" + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in script.IMPOSSIBLE[:-1])}
   + CAST(len(regexp_extract_all(t, 'င်္')) - len(regexp_extract_all(t, 'င်္[က-အ]')) AS BIGINT) AS impossible,
  len(regexp_extract_all(t, '္')) - len(regexp_extract_all(t, '္[က-ဧ]')) AS virama,
  len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: regexp_full_match(w, '[{script.MARK_ORDER}္]+'))) AS stray
FROM (SELECT doc_id, {_MM} AS t FROM documents)""")
def scan_counts(spark, sf):
    d = _docs(spark, sf).select("doc_id", script.as_myanmar(F.coalesce("text", F.lit(""))).alias("t"))
    c = script.scan_counts(F.col("t"))
    return d.select("doc_id", *[c[k].alias(k) for k in ("orphan", "impossible", "virama", "stray")])


@C.add("scan_lookaround_counts")
def scan_lookaround_counts(spark, sf):
    """The two rules that need lookarounds or back references."""
    c = script.scan_counts(script.as_myanmar(F.col("text")))
    return _docs(spark, sf).select("doc_id", *[c[k].alias(k) for k in ("repeat", "digit")])


_RUNS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')"
_COMMON = ", ".join(f"'{w}'" for w in script.COMMON_ENGLISH)


@C.add("english_letter_runs", f"""
SELECT doc_id, len(r) AS runs, coalesce(CAST(list_sum(list_transform(r, lambda w: length(w))) AS BIGINT), 0) AS letters,
  coalesce(list_max(list_transform(r, lambda w: length(w))), 0) AS max_run,
  round(CASE WHEN len(g) > 0 THEN len(list_filter(g, lambda w: w IN ({_COMMON}))) / len(g) ELSE 0 END, 9) AS common_ratio
FROM (SELECT doc_id, {_RUNS} AS r, list_filter(list_transform({_RUNS}, lambda w: lower(w)), lambda w: length(w) >= 2) AS g FROM documents)""")
def english_letter_runs(spark, sf):
    f = script.english_facts(F.col("text"))
    return _docs(spark, sf).select("doc_id", *[(F.round(v, 9) if k == "common_ratio" else v).alias(k) for k, v in f.items()])


_PAIRS = ", ".join(f"'{p}'" for p in script.NEVER_PAIRS)
_FOUR = "|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyz")


@C.add("english_verdict", f"""
WITH w AS (SELECT doc_id, contains(coalesce(text, ''), ' ') AS spaced, unnest({_RUNS}) AS w FROM documents),
l AS (SELECT doc_id, spaced, w, lower(w) AS low, length(w) AS n, list_transform(range(1, length(w)), lambda i: substr(lower(w), i, 2)) AS twos FROM w),
x AS (SELECT doc_id, spaced, n, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS long, CASE WHEN n >= 2 AND low IN ({_COMMON}) THEN 1 ELSE 0 END AS common,
    CASE WHEN NOT (n <= 6 AND w = upper(w)) AND n >= 3 AND low NOT IN ('{"', '".join(script.VOWELLESS)}') AND NOT regexp_matches(low, '[aeiouy]') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(low, '{_FOUR}') THEN 2 ELSE 0 END + len(list_filter(twos, lambda p: p IN ({_PAIRS})))
    + len(list_filter(twos, lambda p: p[1] = 'q' AND p[2] <> 'u')) + CASE WHEN ends_with(low, 'q') THEN 1 ELSE 0 END
    + CASE WHEN n > 16 THEN 1 ELSE 0 END + CASE WHEN n > 20 THEN 1 ELSE 0 END + CASE WHEN n > 45 THEN 2 ELSE 0 END AS faults FROM l),
f AS (SELECT doc_id, bool_or(spaced) AND count(*) > 1 AS spaces, count(*) AS runs, sum(n) AS letters, max(n) AS longest, sum(faults) / sum(n) AS broken,
    CASE WHEN sum(long) > 0 THEN sum(common) / sum(long) ELSE 0 END AS ratio FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN letters >= 12 THEN CASE
    WHEN ratio >= 0.15 AND broken <= 0.02 AND longest <= 20 THEN 'english' WHEN ratio >= 0.08 AND spaces AND broken <= 0.01 AND longest <= 16 THEN 'english'
    WHEN broken > 0.03 AND ratio < 0.05 THEN 'not-english' WHEN NOT spaces AND longest > 20 AND ratio < 0.05 THEN 'not-english'
    WHEN ratio > 0 AND ratio < 0.05 AND broken > 0.015 THEN 'not-english' WHEN ratio = 0 AND letters >= 24 AND runs >= 4 THEN 'not-english' END END AS verdict
FROM documents d LEFT JOIN f USING (doc_id)""")
def english_verdict(spark, sf):
    return _docs(spark, sf).select("doc_id", script.english_verdict(F.col("text")).alias("verdict"))


_TOKENS = "SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[0-9][0-9./,-]*')) AS token FROM documents"


@C.add("number_class", f"""
WITH t AS ({_TOKENS}), g AS (SELECT token, regexp_replace(token, '[^0-9]', '', 'g') AS d, list_filter(regexp_split_to_array(token, '[.\\-/,]'), lambda x: x <> '') AS groups FROM t)
SELECT token, CASE WHEN starts_with(d, '09') AND length(d) BETWEEN 8 AND 11 THEN 'phone'
  WHEN len(groups) = 3 AND regexp_matches(token, '[.\\-/]') THEN 'exactdate'
  WHEN len(groups) = 1 AND length(groups[1]) = 4 AND (CAST(groups[1] AS INT) BETWEEN 1200 AND 1400 OR CAST(groups[1] AS INT) BETWEEN 1900 AND 2100) THEN 'year'
  WHEN contains(token, '/') THEN 'addr' ELSE 'count' END AS number_class FROM g""")
def number_class(spark, sf):
    t = _docs(spark, sf).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9][0-9./,-]*"), F.lit(0))).alias("token")).distinct()
    return t.select("token", script.number_class(F.col("token")).alias("number_class"))


@C.add("token_classes", r"""
SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(w, '[0-9][0-9.,/\-]*') THEN 'number' WHEN regexp_full_match(w, '[!-/:-@\[-`{-~]+') THEN 'pan' WHEN regexp_full_match(w, '[A-Za-z]+') THEN 'en' ELSE '?' END AS class
FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '\s+')) AS w FROM documents) WHERE w <> '') GROUP BY class""")
def token_classes(spark, sf):
    w = _docs(spark, sf).select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("w")).where("w <> ''")
    return w.groupBy(script.token_class(F.col("w")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@C.add("drop_impossible_marks", f"SELECT doc_id, md5(regexp_replace({_MM}, 'ေ[ိုူံ]+', 'ေ', 'g')) AS digest FROM documents")
def drop_impossible_marks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(script.drop_impossible_marks(script.as_myanmar(F.coalesce("text", F.lit(""))))).alias("digest"))


@C.add("overprint_collapse", r"""
SELECT w, unit, n FROM (SELECT w, n, CASE WHEN k BETWEEN 2 AND 9 AND w = repeat(left(w, 1), k) THEN left(w, 1) WHEN k IN (4, 6, 8) AND w = repeat(left(w, 2), k // 2) THEN left(w, 2)
    WHEN k IN (6, 9) AND w = repeat(left(w, 3), k // 3) THEN left(w, 3) ELSE w END AS unit
  FROM (SELECT w, length(w) AS k, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '\s+')) AS w FROM documents) GROUP BY w)) WHERE unit <> w""")
def overprint_collapse(spark, sf):
    w = _docs(spark, sf).select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    fixed = script.collapse_overprint(F.col("w"))
    return w.select("w", fixed.alias("unit"), "n").where("unit <> w")


@C.add("myanmar_numbers", f"SELECT o_orderkey, o_orderkey AS value, length(translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{script.DIGITS}')) AS width FROM orders")
def myanmar_numbers(spark, sf):
    shown = F.translate(F.col("o_orderkey").cast("string"), "0123456789", script.DIGITS)
    return load(spark, sf, "orders").select("o_orderkey", script.myanmar_number(shown).alias("value"), F.length(shown).cast("bigint").alias("width"))


@C.add("latin_script_ratio", "SELECT doc_id, round(len(regexp_extract_all(t, '[က-႟]')) / length(t), 9) AS ratio FROM (SELECT doc_id, " + _MM + " AS t FROM documents) WHERE length(t) > 0")
def latin_script_ratio(spark, sf):
    return _docs(spark, sf).where(F.length("text") > 0).select("doc_id", F.round(script.script_ratio(script.as_myanmar(F.col("text"))), 9).alias("ratio"))


# ---- URLs

_U = r"trim(url)"
_PART = lambda k: f"regexp_extract({_U}, '^([A-Za-z][A-Za-z0-9+.\\-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\\?([^#]*))?', {k})"
_Q = f"CASE WHEN {_PART(6)} <> '' THEN '?' || {_PART(6)} ELSE '' END"
_CANON = f"CASE WHEN lower({_PART(1)}) IN ('http', 'https') AND {_PART(3)} <> '' THEN lower({_PART(1)}) || '://' || lower({_PART(3)}) || CASE WHEN {_PART(4)} IN ('', '80', '443') THEN '' ELSE ':' || {_PART(4)} END || {_PART(5)} || {_Q} END"
_HOST = f"nullif(lower({_PART(3)}), '')"


def _pages(spark, sf):
    return load(spark, sf, "pages")


@C.add("url_canonical", f"SELECT page_id, {_CANON} AS canonical, {_HOST} AS host, regexp_replace({_HOST}, '^www\\.', '') AS site FROM pages")
def url_canonical(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select("page_id", links.canonical(u).alias("canonical"), links.host(u).alias("host"), links.site_key(u).alias("site"))


@C.add("url_predicates", f"""SELECT page_id, regexp_matches(lower({_PART(5)}), '\\.(pdf|docx)$') AS document,
  ({_HOST} = 'drive.google.com' OR ends_with({_HOST}, '.drive.google.com')) AS drive,
  list_contains(string_split(lower({_PART(5)}), '/'), 'search') AS search FROM pages""")
def url_predicates(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select("page_id", links.is_document(u).alias("document"), links.in_domain(links.host(u), "drive.google.com").alias("drive"), F.array_contains(F.split(F.lower(links.part(u, 5)), "/"), "search").alias("search"))


@C.add("url_forms")
def url_forms(spark, sf):
    """Guarded URL, variants, provider, download likeness and ancestors of every page's URL."""
    u = F.col("url")
    return _pages(spark, sf).select("page_id", links.guard(u).alias("guarded"), links.variants(u).alias("variants"), links.provider(u).alias("provider"), links.looks_like_download(u).alias("download"), links.is_search(u).alias("search"), links.ancestors(u).alias("ancestors"), links.drive_id(u).alias("drive_id"))


@C.add("url_ancestors", f"""
SELECT page_id, k, '/' || array_to_string(s[1:k], '/') AS ancestor FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS k
  FROM (SELECT page_id, list_filter(string_split({_PART(5)}, '/'), lambda x: x <> '') AS s FROM pages))""")
def url_ancestors(spark, sf):
    return _pages(spark, sf).select("page_id", F.posexplode(links.ancestors(F.col("url"))).alias("k", "ancestor")).select("page_id", (F.col("k") + 1).cast("bigint").alias("k"), "ancestor")


@C.add("url_children", f"""
WITH p AS (SELECT page_id, {_HOST} AS h, {_PART(5)} AS path FROM pages)
SELECT a.page_id AS parent, b.page_id AS child FROM p a JOIN p b ON a.h = b.h AND starts_with(b.path, regexp_replace(a.path, '/+$', '') || '/') AND length(b.path) > length(regexp_replace(a.path, '/+$', '')) + 1""")
def url_children(spark, sf):
    return prefix_pairs(_pages(spark, sf))


#: Tasks that the children of one parent are dealt to.
SHARES = 32


def prefix_pairs(pages: DataFrame, url: str = "url") -> DataFrame:
    """``parent, child``: pairs of ``page_id`` where :func:`links.is_prefix_child` holds.

    Children meet the parts of their own paths, so nothing is compared that isn't a pair.  As few rows make many pairs, the
    children of a parent are dealt to some tasks, which Spark then doesn't merge.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h, u = links.host(F.col(url)).alias("h"), F.col(url)
    a = pages.select(F.col("page_id").alias("parent"), h, links.trunk(u).alias("front")).where("h is not null").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    b = pages.select(F.col("page_id").alias("child"), h, F.explode(links.trunks_above(u)).alias("front")).where("h is not null").withColumn("share", F.pmod(F.xxhash64("child"), F.lit(SHARES)).cast("int"))
    on = ["h", "front", "share"]
    return a.repartition(n, *on).join(b.repartition(n, *on), on).select("parent", "child")


# ---- identities


@C.add("paragraph_ids", """
SELECT doc_id, i, printf('%04d-%03d-%s', CAST(doc_id % 10000 AS INT), CAST(i AS INT), left(sha256(p), 8)) AS paragraph_id
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def paragraph_ids(spark, sf):
    p = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p"))
    return p.select("doc_id", (F.col("i") + 1).cast("bigint").alias("i"), links.paragraph_id(F.col("doc_id") % 10000, F.col("i") + 1, F.col("p")).alias("paragraph_id"))


@C.add("cache_keys", "SELECT conv_id, turn, sha256(concat_ws(chr(31), role, CAST(turn AS VARCHAR), text)) AS cache_key FROM conversations")
def cache_keys(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", links.cache_key(F.col("role"), F.col("turn").cast("string"), F.col("text")).alias("cache_key"))


@C.add("size_texts", """
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0 + 1e-9) ELSE printf('%.1f MB', b / 1048576.0 + 1e-9) END AS size_text FROM (SELECT doc_id, n_chars * 37 AS b FROM documents)""")
def size_texts(spark, sf):
    return _docs(spark, sf).select("doc_id", links.size_text(F.col("n_chars") * 37).alias("size_text"))


@C.add("name_cleaning", r"""
SELECT p_partkey, trim(left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 48), '-') AS slug,
  regexp_matches(p_brand, '^[A-Za-z0-9._-]{1,128}$') AND NOT contains(p_brand, '..') AS is_token, regexp_replace(p_name || '.PDF', '\.pdf$', '', 'i') AS stem FROM part""")
def name_cleaning(spark, sf):
    return load(spark, sf, "part").select("p_partkey", links.slug(F.col("p_name")).alias("slug"), links.is_token(F.col("p_brand")).alias("is_token"), links.stem(F.concat("p_name", F.lit(".PDF"))).alias("stem"))


@C.add("book_keys", """
SELECT doc_id, CASE WHEN n > 1 THEN stem || '-' || left(sha256(source || ':' || doc_id), 8) ELSE stem END AS book_key
FROM (SELECT doc_id, source, stem, count(*) OVER (PARTITION BY stem) AS n FROM (SELECT doc_id, source, left(text, 12) AS stem FROM documents))""")
def book_keys(spark, sf):
    """A stem alone where it is the only one, else with 8 digits of its source's hash."""
    d = _docs(spark, sf).select("doc_id", "source", F.left("text", F.lit(12)).alias("stem"))
    n = d.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    full = F.concat("stem", F.lit("-"), F.left(F.sha2(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")), 256), F.lit(8)))
    return d.join(n, "stem").select("doc_id", F.when(F.col("n") > 1, full).otherwise(F.col("stem")).alias("book_key"))


@C.add("durations", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, (s // 60) % 60) ELSE printf('%dm', s // 60) END AS duration, (hour(ts) >= 22 OR hour(ts) < 6) AS night, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT event_id, ts, event_id * 7 % 20000 AS s FROM events)")
def durations(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", links.duration_text(F.col("event_id") * 7 % 20000).alias("duration"), ((F.hour("ts") >= 22) | (F.hour("ts") < 6)).alias("night"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@C.add("job_ids", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S_') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') AS job_id FROM events")
def job_ids(spark, sf):
    return load(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss_SSS").alias("job_id"))


@C.add("half_even_rounding", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS rounded FROM lineitem")
def half_even_rounding(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).cast("bigint").alias("rounded"))
