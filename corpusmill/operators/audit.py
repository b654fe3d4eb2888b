"""Routing, candidate merging, as-of and interval joins, reachability and lexicon audits."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import script, sequences
from ..plans.catalog import Catalog, load
from .graph import reachable

C = Catalog()


def count() -> Column:
    return F.count(F.lit(1))


@C.add("document_routes", r"""
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN letters < 0.3 * n THEN 'scanned' WHEN odd > 0.01 * n THEN 'damaged' WHEN n < 200 THEN 'thin' ELSE 'convertible' END AS route
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) AS letters, len(regexp_extract_all(coalesce(text, ''), '[#$%&*|]')) AS odd FROM documents)""")
def document_routes(spark, sf):
    """The way each document goes, by shares of its characters and floors; the first rule that holds decides."""
    t = F.coalesce("text", F.lit(""))
    n, letters, odd = F.length(t), F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit("[#$%&*|]"))
    route = F.when(n == 0, "empty").when(letters < 0.3 * n, "scanned").when(odd > 0.01 * n, "damaged").when(n < 200, "thin").otherwise("convertible")
    return load(spark, sf, "documents").select("doc_id", route.alias("route"))


def sampled_places(n: Column, most: int = 32) -> Column:
    """Up to ``most`` places spread evenly over 0 to n - 1, rounded half to even."""
    k = F.least(n, F.lit(most))
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1)), 0).cast("bigint"))
    return F.when(n > 0, F.array_distinct(spread)).otherwise(F.array().cast("array<bigint>"))


@C.add("sampled_pages", """
SELECT DISTINCT doc_id, CAST(round_even(i * (n - 1) / greatest(k - 1, 1), 0) AS BIGINT) AS place FROM (SELECT doc_id, n, k, unnest(range(k)) AS i FROM (SELECT doc_id, n, least(n, 32) AS k FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)))""")
def sampled_pages(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.explode(sampled_places(F.size(F.split("text", "\n")))).alias("place"))


@C.add("caller_policy", """
SELECT o_orderkey, coalesce(p.action, 'parse') AS action FROM orders LEFT JOIN (VALUES ('F', '1-URGENT', 'skip'), ('O', '5-LOW', 'skip'), ('P', '1-URGENT', 'parse')) p(status, lane, action) ON status = o_orderstatus AND lane = o_orderpriority""")
def caller_policy(spark, sf):
    """Parse or skip by caller and lane; what no rule names is parsed."""
    policy = spark.createDataFrame([("F", "1-URGENT", "skip"), ("O", "5-LOW", "skip"), ("P", "1-URGENT", "parse")], "o_orderstatus string, o_orderpriority string, action string")
    return load(spark, sf, "orders").join(F.broadcast(policy), ["o_orderstatus", "o_orderpriority"], "left").select("o_orderkey", F.coalesce("action", F.lit("parse")).alias("action"))


@C.add("next_pages", r"""
SELECT page_id, CASE WHEN n = 1 THEN 'unique' WHEN n = 0 THEN 'none' ELSE 'several' END AS outcome FROM (SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: starts_with(h, '/t')))) AS n FROM pages)""")
def next_pages(spark, sf):
    """Whether exactly one distinct forward link is on a page."""
    n = F.size(F.array_distinct(F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: h.startswith("/t"))))
    return load(spark, sf, "pages").select("page_id", F.when(n == 1, "unique").when(n == 0, "none").otherwise("several").alias("outcome"))


@C.add("candidate_merge", """
SELECT user_id, coalesce(min(CASE WHEN value > 99 THEN event_id END), min(event_id)) AS kept, coalesce(arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view'), 'view') AS label FROM events GROUP BY user_id""")
def candidate_merge(spark, sf):
    """Of one key's candidates: the first with a payload, else the first; the first label that says something."""
    e = load(spark, sf, "events")
    payload = F.min(F.when(F.col("value") > 99, F.col("event_id")))
    label = F.min(F.when(F.col("event_type") != "view", F.struct("event_id", "event_type")))
    g = e.groupBy("user_id").agg(F.coalesce(payload, F.min("event_id")).alias("kept"), label.alias("l"))
    return g.select("user_id", "kept", F.coalesce("l.event_type", F.lit("view")).alias("label"))


def form_identity(fields: Column, volatile: str = "token|csrf|nonce|session") -> Column:
    """Sorted ``name=value`` pairs of a map without volatile names."""
    kept = F.filter(F.map_entries(fields), lambda e: ~F.lower(e["key"]).rlike(volatile))
    return F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&")


@C.add("form_identities", "SELECT event_id, 'k=' || json_extract_string(props, '$.k') || '&type=' || event_type AS identity FROM events")
def form_identities(spark, sf):
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("csrf_token"), F.col("user_id").cast("string")))
    return load(spark, sf, "events").select("event_id", form_identity(fields).alias("identity"))


@C.add("canonical_json_hashes", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events""")
def canonical_json_hashes(spark, sf):
    """Hash of compact JSON with its keys in order."""
    return load(spark, sf, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("digest"))


@C.add("spurious_spaces", r"""
WITH w AS (SELECT doc_id, k, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word, unnest(range(len(regexp_extract_all(lower(text), '\p{L}+')))) AS k FROM documents)),
lex AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 5), p AS (SELECT doc_id, word || lead(word) OVER (PARTITION BY doc_id ORDER BY k) AS joined FROM w)
SELECT joined, count(*) AS n FROM p WHERE joined IN (SELECT word FROM lex) GROUP BY joined""")
def spurious_spaces(spark, sf):
    """Neighbouring words that together are a word of the lexicon."""
    d = load(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    lexicon = d.select(F.explode("w").alias("word")).groupBy("word").agg(count().alias("n")).where("n >= 5").select(F.col("word").alias("joined"))
    near = F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: i < F.size("w") - 1), lambda i: F.concat(F.get("w", i), F.get("w", i + 1)))
    pairs = d.where("size(w) > 1").select(F.explode(near).alias("joined")).groupBy("joined").agg(count().alias("n"))
    return pairs.join(lexicon, "joined", "left_semi")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before it, by key.

    Both sides are stacked and filled forward in one window: one exchange on the key, no range join.
    """
    taken = F.struct(*[F.col(c) for c in columns])
    a = left.select("*", F.lit(None).cast(right.select(taken.alias("t")).schema["t"].dataType).alias("_taken"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], taken.alias("_taken"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_taken", True).over(w)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_last.{c}").alias(f"asof_{c}") for c in columns])


@C.add("as_of_join", """
SELECT p.event_id, s.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def as_of_join(spark, sf):
    e = load(spark, sf, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return as_of(p, e.where("event_type = 'signup'").select("user_id", "ts", "event_id"), "user_id", "ts", ["event_id"]).select("event_id", "asof_event_id")


def within(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Pairs ``(a, b)`` of one key whose time of ``right`` (``id, at`` in seconds) is 0 to ``seconds`` after ``left``'s.

    Times are cut into buckets as long as the interval; each left row looks into two: an equi-join.
    """
    a = left.select(key, F.col("id").alias("a"), F.col("at").alias("a_at")).withColumn("_b", F.explode(F.array(F.floor(F.col("a_at") / seconds), F.floor(F.col("a_at") / seconds) + 1)))
    b = right.select(key, F.col("id").alias("b"), F.col("at").alias("b_at"), F.floor(F.col("at") / seconds).alias("_b"))
    return a.join(b, [key, "_b"]).where((F.col("b_at") >= F.col("a_at")) & (F.col("b_at") <= F.col("a_at") + seconds)).select("a", "b")


@C.add("interval_join", """
SELECT s.event_id AS a, c.event_id AS b FROM events s JOIN events c ON s.user_id = c.user_id AND s.event_type = 'signup' AND c.event_type = 'click' AND epoch(date_trunc('second', c.ts)) BETWEEN epoch(date_trunc('second', s.ts)) AND epoch(date_trunc('second', s.ts)) + 36000""")
def interval_join(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("at"))
    return within(e.where("event_type = 'signup'"), e.where("event_type = 'click'"), "user_id", 36000)


@C.add("memory_import", """
WITH old AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE conv_id % 2 = 0), new AS (SELECT conv_id, turn, role, length(text) + turn % 2 AS n FROM conversations WHERE conv_id % 3 = 0)
SELECT CASE WHEN old.role IS NULL THEN 'added' WHEN old.role = 'assistant' THEN 'skipped_approved' ELSE 'updated' END AS outcome, count(*) AS k FROM new LEFT JOIN old USING (conv_id, turn) GROUP BY outcome""")
def memory_import(spark, sf):
    """A bulk import: new entries are added, approved ones never touched, others updated."""
    c = load(spark, sf, "conversations")
    old = c.where("conv_id % 2 = 0").select("conv_id", "turn", F.col("role").alias("old"))
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("old") == "assistant", "skipped_approved").otherwise("updated")
    return c.where("conv_id % 3 = 0").join(old, ["conv_id", "turn"], "left").groupBy(outcome.alias("outcome")).agg(count().alias("k"))


@C.add("reachable_parts", """
WITH RECURSIVE r(node, depth) AS (SELECT 1, 0 UNION SELECT d.dst, r.depth + 1 FROM (SELECT p_partkey AS src, (p_partkey * 7) % 1999 AS dst FROM part UNION ALL SELECT p_partkey, (p_partkey * 3 + 1) % 1999 FROM part) d JOIN r ON d.src = r.node WHERE r.depth < 6)
SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""")
def reachable_parts(spark, sf):
    """Nodes within six steps of one seed over a graph of the parts."""
    p = load(spark, sf, "part")
    e = p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 7 % 1999).alias("dst")).union(p.select("p_partkey", (F.col("p_partkey") * 3 + 1) % 1999))
    return reachable(e, spark.createDataFrame([(1,)], "node long"), rounds=6)


#: Words up to this length are matched by what is left of them after deletions.
DELETED = 12


def _subsequences(near: float, far: float):
    """Of each word, the subsequences that one as similar and as long as one letter more or less must share.

    A ratio of x needs x of the letters' half sum in common, in order; of words that begin alike, the first two too.
    """

    def of(w: str) -> list[str]:
        found = set()
        for m in range(max(4, len(w) - 1), min(DELETED, len(w) + 1) + 1):
            for sort, least, fixed in (("n", near, 2), ("f", far, 0)):
                keep = math.ceil((least - 0.006) * (len(w) + m) / 2)
                if keep <= len(w):
                    found.update(sort + w[:fixed] + "".join(c) for c in itertools.combinations(w[fixed:], keep - fixed))
        return sorted(found)

    return F.pandas_udf(lambda s: s.map(of), "array<string>")


def name_variants(runs: DataFrame, names: DataFrame, near: float = 0.72, far: float = 0.86) -> DataFrame:
    """``run, name, similarity``: for each name the most similar run that isn't it and doesn't hold it.

    Runs and names (``run``, ``name``) of 4 characters or more whose lengths differ by one at most are
    compared if they share their first two characters (at ``near``) or any three in a row (at ``far``).
    Short ones meet by a shared subsequence of the length that the similarity needs, which loses none.
    """
    grams_of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3))))
    grams = lambda df, c: df.select(c, F.explode(grams_of(c)).alias("g"))
    r, n = runs.where(F.length("run") >= 4).distinct(), names.where(F.length("name") >= 4).distinct()
    own = lambda df: df.withColumn("size", F.length("run"))
    near_by = lambda df: df.withColumn("size", F.explode(F.array(*[F.length("name") + k for k in (-1, 0, 1)])))
    start = lambda df, c: df.select(c, F.left(c, F.lit(2)).alias("g"))
    meet = lambda make: own(make(r.where(F.length("run") >= DELETED), "run")).join(near_by(make(n.where(F.length("name") >= DELETED), "name")), ["g", "size"]).select("run", "name")
    keys = _subsequences(near, far)
    left = lambda df, c: df.where(F.length(c) <= DELETED).select(c, F.explode(keys(F.col(c))).alias("g"))
    brief = left(r, "run").join(left(n, "name"), "g").select("run", "name")
    pairs = brief.union(meet(grams)).union(meet(start)).distinct()
    same = F.left("run", F.lit(2)) == F.left("name", F.lit(2))
    pairs = pairs.where((F.abs(F.length("run") - F.length("name")) <= 1) & ~F.col("run").contains(F.col("name")) & ~F.col("name").contains(F.col("run")))
    pairs = pairs.where(same | F.arrays_overlap(grams_of("run"), grams_of("name")))
    scored = pairs.withColumn("similarity", F.round(sequences.ratio(F.col("run"), F.col("name")), 2))
    best = scored.where(F.col("similarity") >= F.when(same, near).otherwise(far)).groupBy("name").agg(F.max(F.struct("similarity", "run")).alias("b"))
    return best.select(F.col("b.run").alias("run"), "name", F.col("b.similarity").alias("similarity"))


@C.add("name_variants")
def name_variant_rows(spark, sf):
    """Misspelt forms of each word of three documents or more among all other words of four letters or more."""
    w = load(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("run"))
    w = w.where(F.length("run") >= 4).groupBy("run").agg(F.countDistinct("doc_id").alias("docs"))
    names = w.where("docs >= 3").select(F.col("run").alias("name"))
    return name_variants(w.select("run"), names)


@C.add("evidence_totals", f"""
SELECT lang, CAST(sum(len(string_split(trim(text), ' '))) AS BIGINT) AS tokens, CAST(sum(CASE WHEN contains(text, '|') THEN 1 ELSE 0 END) AS BIGINT) AS flagged, list_sort(list(doc_id) FILTER (WHERE contains(text, '|')))[1:5] AS examples FROM documents GROUP BY lang""")
def evidence_totals(spark, sf):
    d = load(spark, sf, "documents")
    flagged = F.col("text").contains("|")
    first = d.where(flagged).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 5").groupBy("lang").agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    n = d.groupBy("lang").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("tokens"), F.count_if(flagged).alias("flagged"))
    return n.join(first, "lang", "left").select("lang", "tokens", "flagged", "examples")


@C.add("chinese_numerals", """SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS value FROM nation""")
def chinese_numerals(spark, sf):
    """Numerals written for each key, read back."""
    digits = "零一二三四五六七八九"
    tens, ones = F.floor(F.col("n_nationkey") / 10).cast("int"), F.col("n_nationkey") % 10
    d = lambda c: F.substring(F.lit(digits), c + 1, F.lit(1))
    shown = F.when(tens == 0, d(ones)).otherwise(F.concat(F.when(tens > 1, d(tens)).otherwise(""), F.lit("十"), F.when(ones > 0, d(ones)).otherwise("")))
    return load(spark, sf, "nation").select("n_nationkey", script.chinese_numeral(shown).cast("bigint").alias("value"))


@C.add("queue_view", """
SELECT l_orderkey, count(*) AS legs, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS done, min(CASE WHEN l_linestatus <> 'F' THEN l_linenumber END) AS next_leg,
  CASE WHEN count_if(l_linestatus = 'F') = 0 THEN 'waiting' WHEN count_if(l_linestatus <> 'F') = 0 THEN 'complete' ELSE 'partial' END AS view FROM lineitem GROUP BY l_orderkey""")
def queue_view(spark, sf):
    """Each job's legs: how many, how many done, which is next, and the view a client gets."""
    done = F.col("l_linestatus") == "F"
    g = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(count().alias("legs"), F.count_if(done).alias("done"), F.min(F.when(~done, F.col("l_linenumber"))).alias("next_leg"))
    return g.withColumn("view", F.when(F.col("done") == 0, "waiting").when(F.col("next_leg").isNull(), "complete").otherwise("partial"))


def is_subsequence(pattern: Column, sequence: Column) -> Column:
    """Whether the pattern's items come in the sequence in order, with anything between."""
    return F.aggregate(sequence, F.lit(0), lambda at, x: at + F.when(F.get(pattern, at) == x, 1).otherwise(0)) == F.size(pattern)


@C.add("role_subsequences", """
WITH s AS (SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS roles FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN roles = 'view>click>purchase' THEN 'exact' WHEN regexp_matches(roles, 'view(>|>.*>)click(>|>.*>)purchase') THEN 'subsequence' ELSE 'none' END AS match FROM s""")
def role_subsequences(spark, sf):
    e = load(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    roles, pattern = F.transform("e", lambda x: x["event_type"]), F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))
    return e.select("user_id", F.when(roles == pattern, "exact").when(is_subsequence(pattern, roles), "subsequence").otherwise("none").alias("match"))


@C.add("retry_turns", """
WITH f AS (SELECT event_id, user_id, CAST(value AS INT) % 7 AS r FROM events WHERE event_type = 'error')
SELECT CASE WHEN r IN (0, 1, 2) THEN 'first' WHEN r IN (3, 4) THEN 'second' WHEN r = 5 THEN 'third' ELSE 'left' END AS turn, count(*) AS n FROM f GROUP BY turn""".replace("CAST(value AS INT)", "CAST(floor(value) AS INT)"))
def retry_turns(spark, sf):
    """Three passes over failed rows; a row that succeeds leaves, what is left after the last stays failed."""
    rows = load(spark, sf, "events").where("event_type = 'error'").select("event_id", (F.floor("value") % 7).alias("r"))
    out, passes = [], (("first", (0, 1, 2)), ("second", (3, 4)), ("third", (5,)))
    for turn, ok in passes:
        won = rows.where(F.col("r").isin(*ok))
        out.append(won.select(F.lit(turn).alias("turn")))
        rows = rows.where(~F.col("r").isin(*ok))
    out.append(rows.select(F.lit("left").alias("turn")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.groupBy("turn").agg(count().alias("n"))


@C.add("token_expiry", """
SELECT event_id, ts + INTERVAL 30 MINUTE < coalesce(nxt, TIMESTAMP '2024-02-01') AS expired FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'signup')""")
def token_expiry(spark, sf):
    """A token not used again within half an hour expires."""
    nxt = F.coalesce(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("2024-02-01").cast("timestamp_ntz"))
    e = load(spark, sf, "events").where("event_type = 'signup'")
    return e.select("event_id", (F.col("ts").cast("timestamp_ntz") + F.expr("interval 30 minutes") < nxt).alias("expired"))
