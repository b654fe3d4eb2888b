"""Collections, ledgers, audits, translation memory, profiles: relational operators over corpora."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links
from ..plans.catalog import Catalog, load

C = Catalog()

def count() -> Column:
    return F.count(F.lit(1))


# ---- phrases and profiles


def phrase_frequency(docs: DataFrame, text: str, order: tuple[str, ...], min_count: int = 2, min_chars: int = 2, max_chars: int = 120) -> DataFrame:
    """``phrase, occurrences``: punctuation-delimited phrases that come ``min_count`` times or more.

    Edge punctuation goes; phrases are matched with white space squeezed and shown as first seen in
    the order of ``order`` columns and place.
    """
    p = docs.select(*order, F.posexplode(F.split(F.coalesce(text, F.lit("")), "[.,;:!?|\n。！？၊။]+")).alias("place", "raw"))
    p = p.select(*order, "place", F.regexp_replace("raw", r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "").alias("shown"))
    p = p.where(F.length("shown").between(min_chars, max_chars) & F.col("shown").rlike(r"[\p{L}\p{N}]"))
    p = p.withColumn("norm", F.trim(F.regexp_replace("shown", r"\s+", " ")))
    g = p.groupBy("norm").agg(count().alias("occurrences"), F.min_by("shown", F.struct(*order, "place")).alias("phrase"))
    return g.where(F.col("occurrences") >= min_count).select("phrase", "occurrences")


_PHRASES = r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.,;:!?|\n。！？၊။]+')) AS raw, unnest(range(len(regexp_split_to_array(coalesce(text, ''), '[.,;:!?|\n。！？၊။]+')))) AS place FROM documents),
s AS (SELECT doc_id, place, regexp_replace(raw, '^[\s!-/:-@\[-`{-~]+|[\s!-/:-@\[-`{-~]+$', '', 'g') AS shown FROM p),
n AS (SELECT *, trim(regexp_replace(shown, '\s+', ' ', 'g')) AS norm FROM s WHERE length(shown) BETWEEN 2 AND 120 AND regexp_matches(shown, '[\p{L}\p{N}]'))
SELECT arg_min(shown, (doc_id, place)) AS phrase, count(*) AS occurrences FROM n GROUP BY norm HAVING count(*) >= 2"""


@C.add("phrase_frequency", _PHRASES)
def phrases(spark, sf):
    return phrase_frequency(load(spark, sf, "documents"), "text", ("doc_id",))


@C.add("top_phrases", f"SELECT phrase, occurrences FROM ({_PHRASES}) ORDER BY occurrences DESC, length(phrase) DESC, phrase LIMIT 30")
def top_phrases(spark, sf):
    return phrases(spark, sf).orderBy(F.desc("occurrences"), F.desc(F.length("phrase")), "phrase").limit(30)


@C.add("layout_facts", """
SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda x: trim(x) = '')) AS blank, list_max(list_transform(l, lambda x: length(x))) AS longest,
  len(list_filter(l, lambda x: ends_with(x, '.'))) AS closed FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def layout_facts(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    n = lambda f: F.size(F.filter("l", f)).cast("bigint")
    return d.select("doc_id", F.size("l").cast("bigint").alias("lines"), n(lambda x: F.trim(x) == "").alias("blank"), F.array_max(F.transform("l", F.length)).cast("bigint").alias("longest"), n(lambda x: x.endswith(".")).alias("closed"))


@C.add("encoding_facts", r"""
SELECT lang, sum(len(regexp_extract_all(text, '[^\x00-\x7F]'))) AS non_ascii, sum(len(regexp_extract_all(text, '[0-9]'))) AS digits, CAST(count_if(contains(text, chr(9))) AS BIGINT) AS with_tabs FROM documents GROUP BY lang""")
def encoding_facts(spark, sf):
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return load(spark, sf, "documents").groupBy("lang").agg(n(r"[^\x00-\x7F]").alias("non_ascii"), n("[0-9]").alias("digits"), F.count_if(F.col("text").contains("\t")).alias("with_tabs"))


@C.add("nearest_rank_percentiles", """
SELECT source, v[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS p50, v[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] AS p90, n FROM (SELECT source, list_sort(list(n_chars)) AS v, count(*) AS n FROM documents GROUP BY source)""")
def nearest_rank_percentiles(spark, sf):
    """``values[round(q (n - 1))]`` with half-even rounding: values are counted first, then their numbers cumulated."""
    d = load(spark, sf, "documents").groupBy("source", "n_chars").agg(count().alias("k"))
    upto = Window.partitionBy("source").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("source", "n_chars", "k", F.sum("k").over(upto).alias("to"), F.sum("k").over(Window.partitionBy("source")).alias("n"))

    def at(q: float) -> Column:
        rank = F.bround(F.lit(q) * (F.col("n") - 1), 0) + 1
        return F.max(F.when((rank > F.col("to") - F.col("k")) & (rank <= F.col("to")), F.col("n_chars")))

    return d.groupBy("source").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("n").alias("n"))


@C.add("sentence_counts", "SELECT doc_id, len(regexp_extract_all(text, '[^.!?…\\n]+[.!?…]*')) AS sentences, n_chars FROM documents")
def sentence_counts(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[^.!?…\n]+[.!?…]*")).cast("bigint").alias("sentences"), "n_chars")


@C.add("chapter_profile", """
SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, sum(n_chars) AS chars, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean_chars, CAST(count_if(n_chars > 1000) AS BIGINT) AS long_docs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS lang_list FROM documents GROUP BY source""")
def chapter_profile(spark, sf):
    d = load(spark, sf, "documents").groupBy("source").agg(count().alias("docs"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_if(F.col("n_chars") > 1000).alias("long_docs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("lang_list"))
    return d


@C.add("plan_totals", """
SELECT source, lang, count(*) AS docs, sum(n_chars) AS chars, CAST(sum(ceil(n_chars / 1000.0)) AS BIGINT) AS requests FROM documents GROUP BY ROLLUP (source, lang)""")
def plan_totals(spark, sf):
    return load(spark, sf, "documents").rollup("source", "lang").agg(count().alias("docs"), F.sum("n_chars").alias("chars"), F.sum(F.ceil(F.col("n_chars") / 1000)).cast("bigint").alias("requests"))


@C.add("category_pivot", """
SELECT source, CAST(count_if(lang = 'de') AS BIGINT) AS de, CAST(count_if(lang = 'en') AS BIGINT) AS en, CAST(count_if(lang NOT IN ('de', 'en')) AS BIGINT) AS other FROM documents GROUP BY source""")
def category_pivot(spark, sf):
    kind = F.when(F.col("lang").isin("de", "en"), F.col("lang")).otherwise("other")
    return load(spark, sf, "documents").withColumn("kind", kind).groupBy("source").pivot("kind", ["de", "en", "other"]).agg(count()).na.fill(0)


@C.add("dominant_category", """
SELECT source, lang AS dominant, n, round(least(0.95, 0.7 + 0.1 * n), 6) AS confidence FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1""")
def dominant_category(spark, sf):
    n = load(spark, sf, "documents").groupBy("source", "lang").agg(count().alias("n"))
    best = n.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("lang"))).alias("b"))
    return best.select("source", F.col("b.lang").alias("dominant"), (-F.col("b.k")).alias("n")).withColumn("confidence", F.round(F.least(F.lit(0.95), 0.7 + 0.1 * F.col("n")), 6))


@C.add("module_report", """
SELECT event_type AS module, count(*) AS total, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS flagged, CAST(list_sort(list(DISTINCT user_id))[1:20] AS BIGINT[]) AS samples FROM events GROUP BY event_type""")
def module_report(spark, sf):
    """Counters by module with at most 20 samples; the samples are the smallest distinct values by rank."""
    e = load(spark, sf, "events")
    ids = e.select("event_type", "user_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("user_id"))).where("r <= 20")
    samples = ids.groupBy("event_type").agg(F.array_sort(F.collect_list("user_id")).alias("samples"))
    n = e.groupBy("event_type").agg(count().alias("total"), F.count_if(F.col("value") > 50).alias("flagged"))
    return n.join(samples, "event_type").select(F.col("event_type").alias("module"), "total", "flagged", "samples")


@C.add("tally_pairs", "SELECT l_returnflag AS old, l_linestatus AS new, count(*) AS n, CAST(sum(length(l_linestatus) - length(l_returnflag)) AS BIGINT) AS delta FROM lineitem GROUP BY ALL")
def tally_pairs(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("old"), F.col("l_linestatus").alias("new")).agg(count().alias("n"), F.sum(F.length("l_linestatus") - F.length("l_returnflag")).alias("delta"))


@C.add("line_differences", """
WITH a AS (SELECT conv_id, turn, text FROM conversations), p AS (SELECT a.conv_id, a.turn, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM a JOIN a b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i])) AS changes FROM p""")
def line_differences(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("x"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.filter(F.arrays_zip("x", "y"), lambda z: ~z["x"].eqNullSafe(z["y"]))).cast("bigint").alias("changes"))


# ---- dedup and set operations


@C.add("text_hash_dedup", """
SELECT doc_id, digest, copies FROM (SELECT doc_id, sha256(trim(text)) AS digest, row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY trim(text)) AS copies FROM documents WHERE length(trim(text)) >= 200) WHERE r = 1""")
def text_hash_dedup(spark, sf):
    """First of each text of 200 characters or more: a map-side aggregate on the digest, no window."""
    d = load(spark, sf, "documents").select("doc_id", F.trim("text").alias("t")).where(F.length("t") >= 200)
    return d.groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), count().alias("copies")).select("doc_id", "digest", "copies")


@C.add("ordered_distinct", "SELECT event_type, user_id, min(event_id) AS first_seen FROM events GROUP BY event_type, user_id")
def ordered_distinct(spark, sf):
    return load(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_seen"))


@C.add("longest_per_key", "SELECT source, lang, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source, lang")
def longest_per_key(spark, sf):
    return load(spark, sf, "documents").groupBy("source", "lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@C.add("selection_in_order", """
WITH w AS (SELECT unnest(['src7', 'src2', 'src19', 'none']) AS source, unnest([1, 2, 3, 4]) AS k)
SELECT k, w.source, max(n_chars) AS n_chars, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM w LEFT JOIN documents d ON d.source = w.source GROUP BY k, w.source""")
def selection_in_order(spark, sf):
    wanted = spark.createDataFrame([(1, "src7"), (2, "src2"), (3, "src19"), (4, "none")], "k int, source string")
    d = load(spark, sf, "documents").groupBy("source").agg(F.max("n_chars").alias("n_chars"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))
    return wanted.join(d, "source", "left").select("k", "source", "n_chars", "doc_id")


@C.add("set_difference", "SELECT DISTINCT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("key")).subtract(load(spark, sf, "orders").select("o_custkey"))


@C.add("set_intersection", "SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def set_intersection(spark, sf):
    a = load(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("key"))
    return a.intersect(load(spark, sf, "part").where("p_size < 10").select("p_partkey"))


@C.add("collection_merge", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'kept' WHEN a.h = b.h THEN 'denied' ELSE 'replaced' END AS outcome
FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END) AS h FROM documents WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id""")
def collection_merge(spark, sf):
    """Set-based merge of a delivery into a collection by key and text digest (the simple cases of the guarded upsert)."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    a = d.where("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("a"), F.lit(1).alias("in_a"))
    b = d.where("doc_id % 2 = 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))).alias("b"), F.lit(1).alias("in_b"))
    return a.join(b, "doc_id", "full").select("doc_id", F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "kept").when(F.col("a") == F.col("b"), "denied").otherwise("replaced").alias("outcome"))


@C.add("hash_backfill", """
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN b.h IS NULL THEN 'absent' WHEN a.h IS NULL THEN 'filled' WHEN a.h = b.h THEN 'same' ELSE 'conflict' END AS outcome
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents) a LEFT JOIN (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0) b USING (doc_id)) GROUP BY outcome""")
def hash_backfill(spark, sf):
    d = load(spark, sf, "documents")
    a = d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, "x").otherwise(F.md5("text")).alias("a"))
    b = d.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("b"))
    outcome = F.when(F.col("b").isNull(), "absent").when(F.col("a").isNull(), "filled").when(F.col("a") == F.col("b"), "same").otherwise("conflict")
    return a.join(b, "doc_id", "left").groupBy(outcome.alias("outcome")).agg(count().alias("n"))


# ---- ledgers and audits


@C.add("retry_union", """
SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT user_id, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, event_id FROM events WHERE value > 95) GROUP BY user_id""")
def retry_union(spark, sf):
    e = load(spark, sf, "events")
    both = e.where("event_type = 'error'").select("user_id", "event_id").unionByName(e.where("value > 95").select("user_id", "event_id"))
    return both.groupBy("user_id").agg(F.min("event_id").alias("first_event"), count().alias("n"))


@C.add("ledger_last_entry", "SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events WHERE length(event_type) > 4 GROUP BY user_id")
def ledger_last_entry(spark, sf):
    return load(spark, sf, "events").where(F.length("event_type") > 4).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_id"))


@C.add("unseen_ledger_append", """
SELECT event_type, user_id, min(event_id) AS event_id FROM events e WHERE ts >= TIMESTAMP '2024-01-15' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.ts < TIMESTAMP '2024-01-15' AND p.event_type = e.event_type AND p.user_id = e.user_id) GROUP BY ALL""")
def unseen_ledger_append(spark, sf):
    e = load(spark, sf, "events")
    old = e.where("ts < timestamp '2024-01-15'").select("event_type", "user_id")
    return e.where("ts >= timestamp '2024-01-15'").join(old, ["event_type", "user_id"], "left_anti").groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@C.add("sibling_copies", """
WITH n AS (SELECT p_partkey, lower(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_size || ')' ELSE '' END || '.pdf' AS name FROM part),
m AS (SELECT p_partkey, name, regexp_extract(name, '^(.*) \\(([0-9]+)\\)\\.pdf$', 1) AS stem, TRY_CAST(regexp_extract(name, '\\(([0-9]+)\\)', 1) AS INT) AS k FROM n)
SELECT p_partkey, name FROM m WHERE stem <> '' AND k < 1000 AND (stem || '.pdf') IN (SELECT name FROM n)""")
def sibling_copies(spark, sf):
    """``stem (n).pdf`` with n under 1000 whose ``stem.pdf`` is there, too."""
    n = load(spark, sf, "part").select("p_partkey", F.concat(F.lower("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ("), F.col("p_size"), F.lit(")"))).otherwise(""), F.lit(".pdf")).alias("name"))
    part = lambda k: F.regexp_extract("name", r"^(.*) \(([0-9]+)\)\.pdf$", k)
    m = n.withColumn("original", F.concat(part(1), F.lit(".pdf"))).where((part(1) != "") & (part(2).try_cast("int") < 1000))
    return m.join(n.select(F.col("name").alias("original")).distinct(), "original", "left_semi").select("p_partkey", "name")


@C.add("multi_key_fallback", """
WITH k AS (SELECT p_partkey, unnest([p_name, lower(p_name), left(p_name, 5)]) AS key, unnest([1, 2, 3]) AS rank FROM part),
t AS (SELECT p_name AS key, min(p_partkey) AS target FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL UNION ALL SELECT left(p_name, 5), min(p_partkey) FROM part GROUP BY ALL)
SELECT p_partkey, arg_min(target, (rank, target)) AS target, min(rank) AS rank FROM k JOIN t USING (key) GROUP BY p_partkey""")
def multi_key_fallback(spark, sf):
    """The first key of an ordered list that is found decides; one hash join on the exploded keys."""
    p = load(spark, sf, "part")
    k = p.select("p_partkey", F.posexplode(F.array(F.col("p_name"), F.lower("p_name"), F.left("p_name", F.lit(5)))).alias("rank", "key"))
    t = p.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("target"))
    t = t.unionByName(p.groupBy(F.left("p_name", F.lit(5)).alias("key")).agg(F.min("p_partkey").alias("target")))
    g = k.join(t, "key").groupBy("p_partkey").agg(F.min(F.struct("rank", "target")).alias("b"))
    return g.select("p_partkey", F.col("b.target").alias("target"), (F.col("b.rank") + 1).alias("rank"))


@C.add("containment_audit", """
SELECT b.item_id, count(d.doc_id) AS found_in FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) AND b.text <> '' GROUP BY b.item_id""")
def containment_audit(spark, sf):
    """How many texts contain each whole item; an empty item is in none."""
    items = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("needle"))
    docs = load(spark, sf, "documents").select("doc_id", "text")
    hits = contained(docs, items)
    return items.join(hits.groupBy("item_id").agg(count().alias("n")), "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("found_in"))


def contained(docs: DataFrame, items: DataFrame, anchor: int = 12, most: int = 20_000_000) -> DataFrame:
    """``item_id, doc_id`` of texts that contain ``needle``.

    Needles of at most ``most`` characters together are shared as one automaton that reads each text
    once.  Beyond that, an equi-join on the hash of the needle's first ``anchor`` characters, or of all
    of a shorter needle, against the distinct windows of each such length, then ``contains``: no nested
    loop over all pairs.
    """
    chars = items.agg(F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()[0]
    if chars <= most:
        return _by_automaton(docs, [(r["item_id"], r["needle"]) for r in items.select("item_id", "needle").where("needle <> ''").collect()])
    keyed = items.where("needle <> ''").withColumn("_key", F.xxhash64(F.left("needle", F.lit(anchor))))
    sizes = sorted(r[0] for r in keyed.select(F.least(F.length("needle"), F.lit(anchor))).distinct().collect())
    windows_of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(n))))
    starts = F.concat(F.array().cast("array<bigint>"), *[windows_of(n) for n in sizes])
    wanted = keyed.select("_key").distinct()
    windows = docs.select("doc_id", F.explode(F.array_distinct(starts)).alias("_key")).join(wanted, "_key", "left_semi")
    pairs = windows.join(keyed.select("_key", "item_id", "needle"), "_key")
    return pairs.join(docs, "doc_id").where(F.col("text").contains(F.col("needle"))).select("item_id", "doc_id").distinct()


def _by_automaton(docs: DataFrame, items: list[tuple]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        auto, by_needle = ahocorasick.Automaton(), {}
        for item, needle in shared.value:
            by_needle.setdefault(needle, []).append(item)
        for needle, ids in by_needle.items():
            auto.add_word(needle, ids)
        auto.make_automaton()
        for batch in batches:
            if not by_needle:
                continue
            rows = [(i, d) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i in {i for _, ids in auto.iter(t) for i in ids}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["item_id", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "item_id long, doc_id long")


# ---- translation memory over conversations: a user turn is the source, the next turn its target

_MEM = "WITH m AS (SELECT a.conv_id, a.turn, trim(regexp_replace(a.text, '\\s+', ' ', 'g')) AS norm, a.text AS source, b.text AS target FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


def memory(spark, sf) -> DataFrame:
    c = load(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return c.where("role = 'user'").join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("norm"), F.col("text").alias("source"), "target")


@C.add("memory_exact_match", _MEM + " SELECT conv_id, turn, count(*) OVER (PARTITION BY norm) AS same, md5(first_value(target) OVER (PARTITION BY norm ORDER BY conv_id, turn)) AS best FROM m")
def memory_exact_match(spark, sf):
    m = memory(spark, sf)
    best = m.groupBy("norm").agg(count().alias("same"), F.md5(F.min_by("target", F.struct("conv_id", "turn"))).alias("best"))
    return m.join(best, "norm").select("conv_id", "turn", "same", "best")


@C.add("memory_route_stats", _MEM + " SELECT turn, count(*) AS n, CAST(sum(CASE WHEN length(target) > length(source) THEN 1 ELSE 0 END) AS BIGINT) AS longer, CAST(sum(length(target)) AS BIGINT) AS chars FROM m GROUP BY turn")
def memory_route_stats(spark, sf):
    return memory(spark, sf).groupBy("turn").agg(count().alias("n"), F.count_if(F.length("target") > F.length("source")).alias("longer"), F.sum(F.length("target")).alias("chars"))


@C.add("memory_glossary", _MEM + " SELECT norm, min(conv_id) AS first_conv FROM m GROUP BY norm ORDER BY length(norm) DESC, norm LIMIT 25")
def memory_glossary(spark, sf):
    return memory(spark, sf).groupBy("norm").agg(F.min("conv_id").alias("first_conv")).orderBy(F.desc(F.length("norm")), "norm").limit(25)


@C.add("memory_cache_misses", _MEM + " SELECT count(*) AS asked, count(DISTINCT norm) AS wanted, CAST((SELECT count(*) FROM (SELECT DISTINCT norm FROM m WHERE conv_id % 2 = 1 EXCEPT SELECT norm FROM m WHERE conv_id % 2 = 0)) AS BIGINT) AS missing FROM m WHERE conv_id % 2 = 1")
def memory_cache_misses(spark, sf):
    m = memory(spark, sf)
    asked = m.where("conv_id % 2 = 1")
    known = m.where("conv_id % 2 = 0").select("norm", F.lit(1).alias("hit")).distinct()
    d = asked.groupBy("norm").agg(count().alias("k")).join(known, "norm", "left")
    return d.agg(F.sum("k").alias("asked"), count().alias("wanted"), F.count_if(F.col("hit").isNull()).alias("missing"))


@C.add("indexed_attach", """
SELECT CASE WHEN b.turn IS NULL THEN 'absent' WHEN trim(a.role) = trim(b.role) THEN 'attached' ELSE 'mismatched' END AS outcome, count(*) AS n
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn GROUP BY outcome""")
def indexed_attach(spark, sf):
    """Attach by index, only where the values agree."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    b = c.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("other"))
    outcome = F.when(F.col("other").isNull(), "absent").when(F.trim("role") == F.trim("other"), "attached").otherwise("mismatched")
    return c.join(b, ["conv_id", "turn"], "left").groupBy(outcome.alias("outcome")).agg(count().alias("n"))


@C.add("bilingual_render", """
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.k, a.k) AS k, md5(coalesce(u.text, '(no counterpart)') || chr(10) || coalesce(a.text, '(no counterpart)')) AS block
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') u FULL JOIN (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.k = a.k""")
def bilingual_render(spark, sf):
    c = load(spark, sf, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    u, a = c.where("role = 'user'").select("conv_id", "k", F.col("text").alias("u")), c.where("role = 'assistant'").select("conv_id", "k", F.col("text").alias("a"))
    none = F.lit("(no counterpart)")
    return u.join(a, ["conv_id", "k"], "full").select("conv_id", "k", F.md5(F.concat(F.coalesce("u", none), F.lit("\n"), F.coalesce("a", none))).alias("block"))


@C.add("draft_rollup", """
SELECT conv_id, count(*) AS drafts, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last_turn, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id""")
def draft_rollup(spark, sf):
    return load(spark, sf, "conversations").groupBy("conv_id").agg(count().alias("drafts"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@C.add("similarity_ratio")
def similarity_ratio(spark, sf):
    """Matching-blocks ratio of each whole turn with the next, in Arrow batches."""
    from ..functions.sequences import ratio

    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ratio(F.col("text"), F.col("other")), 9).alias("ratio"))


# ---- unknown words against a lexicon


@C.add("unknown_words", r"""
WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}]+'))) AS word FROM documents), lex AS (SELECT word FROM w GROUP BY word HAVING count(DISTINCT doc_id) >= 3)
SELECT word, count(*) AS n, min(doc_id) AS first_doc FROM w WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM lex) GROUP BY word""")
def unknown_words(spark, sf):
    """Words outside a lexicon (here: those of three documents or more), with counts and first place."""
    w = load(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).select("doc_id", F.lower("word").alias("word"))
    counts = w.groupBy("word").agg(count().alias("n"), F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("docs"))
    lexicon = counts.where("docs >= 3").select("word")
    return counts.where(F.length("word") >= 2).join(lexicon, "word", "left_anti").select("word", "n", "first_doc")


@C.add("top_clusters_per_rule", """
SELECT rule, cluster, n FROM (SELECT rule, cluster, n, row_number() OVER (PARTITION BY rule ORDER BY n DESC, cluster) AS r FROM (
  SELECT rule, cluster, count(*) AS n FROM (
    SELECT 'digits' AS rule, unnest(regexp_extract_all(text, '[0-9]+')) AS cluster FROM documents UNION ALL SELECT 'capitals', unnest(regexp_extract_all(text, '[A-Z]{2,}')) FROM documents) GROUP BY ALL)) WHERE r <= 25""")
def top_clusters_per_rule(spark, sf):
    d = load(spark, sf, "documents")
    hits = lambda rule, p: d.select(F.lit(rule).alias("rule"), F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("cluster"))
    n = hits("digits", "[0-9]+").unionByName(hits("capitals", "[A-Z]{2,}")).groupBy("rule", "cluster").agg(count().alias("n"))
    w = Window.partitionBy("rule").orderBy(F.desc("n"), "cluster")
    return n.withColumn("r", F.row_number().over(w)).where("r <= 25").select("rule", "cluster", "n")


# ---- pages


_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"
_HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"


@C.add("link_extraction", f"SELECT page_id, href, min(k) AS place FROM (SELECT page_id, unnest({_HREFS}) AS href, unnest(range(1, len({_HREFS}) + 1)) AS k FROM pages) GROUP BY ALL")
def link_extraction(spark, sf):
    """Links of each page in page order, the first of equal ones."""
    p = load(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("k", "href"))
    return p.groupBy("page_id", "href").agg((F.min("k") + 1).cast("bigint").alias("place"))


@C.add("crawl_edges", f"SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links, CAST(count_if(regexp_matches(href, '^/')) AS BIGINT) AS relative FROM (SELECT page_id, unnest({_HREFS}) AS href FROM pages) GROUP BY page_id")
def crawl_edges(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id").agg(count().alias("links"), F.countDistinct("href").alias("distinct_links"), F.count_if(F.col("href").startswith("/")).alias("relative"))


@C.add("page_titles", f"SELECT page_id, {_TITLE} AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, starts_with(lower(ltrim(html)), '<!doctype html') AS is_html FROM pages")
def page_titles(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"), F.lower(F.ltrim("html")).startswith("<!doctype html").alias("is_html"))


@C.add("stripped_html", r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&[A-Za-z]+;', '', 'g')) AS digest FROM pages")
def stripped_html(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), "&[A-Za-z]+;", "")).alias("digest"))


@C.add("site_sizes", r"SELECT site, count(*) AS pages, count(*) > 3 AS too_large FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS site FROM pages) GROUP BY site")
def site_sizes(spark, sf):
    s = load(spark, sf, "pages").groupBy(links.site_key(F.col("url")).alias("site")).agg(count().alias("pages"))
    return s.withColumn("too_large", F.col("pages") > 3)
