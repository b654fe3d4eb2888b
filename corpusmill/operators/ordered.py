"""Window and ordered analytics, quotas and keyed state in batch form."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, load

C = Catalog()


def count() -> Column:
    return F.count(F.lit(1))


_LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents"


def lines(spark, sf) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    return d.select("doc_id", "line", (F.col("k") + 1).cast("bigint").alias("k"))


def _by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


# ---- text structure


@C.add("block_ids", f"""
SELECT doc_id, k, sum(CASE WHEN trim(line) <> '' AND (prev IS NULL OR trim(prev) = '') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS block
FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM ({_LINES}))""")
def block_ids(spark, sf):
    """The number of the block of lines between blank ones."""
    w = _by("doc_id", "k")
    prev = F.lag("line").over(w)
    start = (F.trim("line") != "") & (prev.isNull() | (F.trim(prev) == ""))
    return lines(spark, sf).withColumn("s", start.cast("bigint")).select("doc_id", "k", F.sum("s").over(w).alias("block"))


def text_role(line: Column, before_blank: Column) -> Column:
    """blank, page_number, heading (2 to 60 characters after a blank, no closing mark) or paragraph."""
    s = F.trim(line)
    return (
        F.when(s == "", "blank")
        .when(s.rlike(r"^---\s*Page\s+\d+\s*---$"), "page_number")
        .when(before_blank & F.length(s).between(2, 60) & ~s.rlike("[.!?၊။,;:]+$"), "heading")
        .otherwise("paragraph")
    )


@C.add("text_roles", rf"""
SELECT role, count(*) AS n FROM (SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^---\s*Page\s+[0-9]+\s*---$') THEN 'page_number'
  WHEN (prev IS NULL OR trim(prev) = '') AND length(trim(line)) BETWEEN 2 AND 60 AND NOT regexp_matches(trim(line), '[.!?၊။,;:]+$') THEN 'heading' ELSE 'paragraph' END AS role
FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM ({_LINES}))) GROUP BY role""")
def text_roles(spark, sf):
    prev = F.lag("line").over(_by("doc_id", "k"))
    role = text_role(F.col("line"), F.col("b"))
    return lines(spark, sf).withColumn("b", prev.isNull() | (F.trim(prev) == "")).groupBy(role.alias("role")).agg(count().alias("n"))


@C.add("quote_state", f"""
SELECT doc_id, k, sum(q) OVER (PARTITION BY doc_id ORDER BY k) % 2 AS open_after FROM (SELECT doc_id, k, length(line) - length(replace(line, '!', '')) AS q FROM ({_LINES}))""")
def quote_state(spark, sf):
    """Open or closed after each line, carried through the whole text (marks that toggle)."""
    q = F.regexp_count("line", F.lit("!"))
    return lines(spark, sf).withColumn("q", q).select("doc_id", "k", (F.sum("q").over(_by("doc_id", "k")) % 2).alias("open_after"))


@C.add("two_stop_units", r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.]*\.|[^.]+$')) AS piece, unnest(range(len(regexp_extract_all(text, '[^.]*\.|[^.]+$')))) AS i FROM documents)
SELECT doc_id, i // 2 AS unit, count(*) AS pieces, CAST(sum(length(piece)) AS BIGINT) AS chars FROM p GROUP BY ALL""")
def two_stop_units(spark, sf):
    """A unit closes at every second stop; what is left is the last one."""
    p = load(spark, sf, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.]*\.|[^.]+$"), F.lit(0))).alias("i", "piece"))
    return p.groupBy("doc_id", F.floor(F.col("i") / 2).alias("unit")).agg(count().alias("pieces"), F.sum(F.length("piece")).alias("chars"))


@C.add("fill_forward_headings", f"""
SELECT doc_id, k, last_value(CASE WHEN length(line) BETWEEN 2 AND 40 THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) AS heading FROM ({_LINES})""")
def fill_forward_headings(spark, sf):
    """The last heading at or before each line: an as-of pairing without a join."""
    mark = F.when(F.length("line").between(2, 40), F.col("k"))
    return lines(spark, sf).select("doc_id", "k", F.last(mark, True).over(_by("doc_id", "k")).alias("heading"))


@C.add("sibling_ranges", f"""
WITH h AS (SELECT doc_id, k, CASE WHEN length(line) < 30 THEN 1 ELSE 2 END AS level FROM ({_LINES}) WHERE length(line) BETWEEN 2 AND 60), n AS (SELECT doc_id, max(k) AS total FROM ({_LINES}) GROUP BY doc_id)
SELECT h.doc_id, h.k, h.level, coalesce((SELECT min(g.k) FROM h g WHERE g.doc_id = h.doc_id AND g.k > h.k AND g.level <= h.level) - 1, total) AS range_end FROM h JOIN n USING (doc_id)""")
def sibling_ranges(spark, sf):
    """A section ends before the next one of its level or above: one window a level, no range join."""
    level = F.when(F.length("line") < 30, 1).otherwise(2)
    after = Window.partitionBy("doc_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(spark, sf).withColumn("total", F.max("k").over(Window.partitionBy("doc_id"))).where(F.length("line").between(2, 60)).withColumn("level", level)
    top, any_ = F.last(F.when(F.col("level") == 1, F.col("k")), True).over(after), F.last("k").over(after)
    return rows.select("doc_id", "k", "level", F.coalesce(F.when(F.col("level") == 1, top).otherwise(any_) - 1, "total").alias("range_end"))


@C.add("section_parents", f"""
WITH h AS (SELECT doc_id, k, CASE WHEN length(line) < 30 THEN 1 ELSE 2 END AS level FROM ({_LINES}) WHERE length(line) BETWEEN 2 AND 60)
SELECT doc_id, k, level, CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) END AS parent FROM h""")
def section_parents(spark, sf):
    level = F.when(F.length("line") < 30, 1).otherwise(2)
    rows = lines(spark, sf).where(F.length("line").between(2, 60)).withColumn("level", level)
    up = F.last(F.when(F.col("level") == 1, F.col("k")), True).over(_by("doc_id", "k"))
    return rows.select("doc_id", "k", "level", F.when(F.col("level") == 2, up).alias("parent"))


@C.add("budgeted_digest", f"SELECT doc_id, k FROM (SELECT doc_id, k, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY k) AS used FROM ({_LINES})) WHERE used <= 1000")
def budgeted_digest(spark, sf):
    return lines(spark, sf).withColumn("used", F.sum(F.length("line")).over(_by("doc_id", "k"))).where("used <= 1000").select("doc_id", "k")


@C.add("paragraph_window", f"SELECT doc_id, k, n, CASE WHEN n > 12 THEN 13 END AS next_start FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_LINES})) WHERE k BETWEEN 3 AND 12")
def paragraph_window(spark, sf):
    rows = lines(spark, sf).withColumn("n", count().over(Window.partitionBy("doc_id"))).where("k between 3 and 12")
    return rows.select("doc_id", "k", "n", F.when(F.col("n") > 12, 13).alias("next_start"))


@C.add("fixed_chunks", f"SELECT doc_id, (k - 1) // 80 AS chunk, count(*) AS n FROM ({_LINES}) GROUP BY ALL")
def fixed_chunks(spark, sf):
    return lines(spark, sf).groupBy("doc_id", F.floor((F.col("k") - 1) / 80).alias("chunk")).agg(count().alias("n"))


@C.add("balanced_chunks", f"""
SELECT doc_id, chunk, count(*) AS n FROM (SELECT doc_id, least(3, CAST(floor((sum(w) OVER (PARTITION BY doc_id ORDER BY k) - w) * 4 / sum(w) OVER (PARTITION BY doc_id)) AS BIGINT)) AS chunk FROM (SELECT doc_id, k, length(line) + 1 AS w FROM ({_LINES}))) GROUP BY ALL""")
def balanced_chunks(spark, sf):
    """Four contiguous chunks by cumulative share of characters."""
    w = F.length("line") + 1
    rows = lines(spark, sf).withColumn("w", w.cast("bigint"))
    before = F.sum("w").over(_by("doc_id", "k")) - F.col("w")
    chunk = F.least(F.lit(3), F.floor(before * 4 / F.sum("w").over(Window.partitionBy("doc_id"))))
    return rows.select("doc_id", chunk.alias("chunk")).groupBy("doc_id", "chunk").agg(count().alias("n"))


def _each(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A column function that folds each row's array in one pass; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def greedy_chunks(sizes: Column, most: int, items: int = 1 << 30) -> Column:
    """Chunk number of each size in order: a chunk closes before ``most`` or ``items`` would be passed."""

    def fold(xs) -> list[int]:
        used, held, chunk, out = 0, 0, 0, []
        for x in xs.tolist():
            if held and (used + x > most or held >= items):
                used, held, chunk = 0, 0, chunk + 1
            used, held = used + x, held + 1
            out.append(chunk)
        return out

    return _each(fold, "array<int>")(sizes)


@C.add("greedy_chunks", """
WITH RECURSIVE l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS n, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r FROM documents),
f AS (SELECT doc_id, r, n AS used, 0 AS chunk FROM l WHERE r = 1
  UNION ALL SELECT l.doc_id, l.r, CASE WHEN f.used + l.n > 600 THEN l.n ELSE f.used + l.n END, CASE WHEN f.used + l.n > 600 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN l ON l.doc_id = f.doc_id AND l.r = f.r + 1)
SELECT doc_id, chunk, count(*) AS n FROM f GROUP BY ALL""")
def greedy_chunk_rows(spark, sf):
    """Lines of each text packed into chunks of at most 600 characters, order kept."""
    d = load(spark, sf, "documents").select("doc_id", greedy_chunks(F.transform(F.split("text", "\n"), lambda x: F.length(x)), 600).alias("c"))
    return d.select("doc_id", F.explode("c").alias("chunk")).groupBy("doc_id", "chunk").agg(count().alias("n"))


@C.add("previous_context", f"""
SELECT doc_id, k, array_to_string(list(k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), ',') AS around FROM ({_LINES}) QUALIFY contains(line, 'the')""")
def previous_context(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(-2, 1)
    return lines(spark, sf).withColumn("around", F.array_join(F.collect_list("k").over(w), ",")).where(F.col("line").contains("the")).select("doc_id", "k", "around")


@C.add("gap_inference", """
SELECT event_id, CASE WHEN label IS NULL AND nxt = prev + 2 THEN prev + 1 ELSE label END AS label FROM (SELECT event_id, label, lag(label) OVER (ORDER BY event_id) AS prev, lead(label) OVER (ORDER BY event_id) AS nxt FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id // 2 END AS label, user_id FROM events))""")
def gap_inference(spark, sf):
    """A missing number between n and n + 2 is n + 1; neighbours come by key, not by a global window."""
    e = load(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.floor(F.col("event_id") / 2)).alias("label"))
    near = lambda d, n: e.select((F.col("event_id") + d).alias("event_id"), F.col("label").alias(n))
    return e.join(near(1, "prev"), "event_id", "left").join(near(-1, "nxt"), "event_id", "left").select("event_id", F.when(F.col("label").isNull() & (F.col("nxt") == F.col("prev") + 2), F.col("prev") + 1).otherwise(F.col("label")).alias("label"))


@C.add("contiguity_check", "SELECT user_id, CAST(max(d) - min(d) + 1 - count(DISTINCT d) AS BIGINT) AS missing_days FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events) GROUP BY user_id")
def contiguity_check(spark, sf):
    d = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    e = load(spark, sf, "events").select("user_id", d.alias("d"))
    return e.groupBy("user_id").agg((F.max("d") - F.min("d") + 1 - F.countDistinct("d")).cast("bigint").alias("missing_days"))


# ---- events as tokens: directional and windowed rules

_E = "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


def events(spark, sf) -> DataFrame:
    return load(spark, sf, "events")


def _seq() -> Window:
    return Window.partitionBy("user_id").orderBy("event_id")


@C.add("negative_context", "SELECT event_id, coalesce(max(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS negated, coalesce(max(CAST(event_type = 'view' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS asked FROM events")
def negative_context(spark, sf):
    near = lambda t, n: F.coalesce(F.max((F.col("event_type") == t).cast("int")).over(_seq().rowsBetween(-n, -1)), F.lit(0))
    return events(spark, sf).select("event_id", near("error", 4).alias("negated"), near("view", 6).alias("asked"))


@C.add("nearest_match", "SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS last_signup FROM events")
def nearest_match(spark, sf):
    of = lambda t: F.when(F.col("event_type") == t, F.col("event_id"))
    back = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return events(spark, sf).select("event_id", F.last(of("purchase"), True).over(back).alias("next_purchase"), F.last(of("signup"), True).over(_seq()).alias("last_signup"))


@C.add("construction_windows", "SELECT event_id, CAST(sum(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 9 FOLLOWING) AS BIGINT) AS verbs, CAST(sum(CAST(event_type = 'view' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT) AS marks FROM events")
def construction_windows(spark, sf):
    n = lambda t, a, b: F.sum((F.col("event_type") == t).cast("bigint")).over(_seq().rowsBetween(a, b))
    return events(spark, sf).select("event_id", n("click", -5, 9).alias("verbs"), n("view", -3, 3).alias("marks"))


@C.add("clause_boundaries", "SELECT user_id, clause, count(*) AS n, bool_or(event_type = 'view') AS has_subject FROM (SELECT *, coalesce(sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clause FROM events) GROUP BY user_id, clause")
def clause_boundaries(spark, sf):
    """A clause ends at its closing token; omitted subjects are clauses without the subject's token."""
    ended = F.coalesce(F.sum((F.col("event_type") == "purchase").cast("bigint")).over(_seq().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events(spark, sf).withColumn("clause", ended).groupBy("user_id", "clause").agg(count().alias("n"), F.bool_or(F.col("event_type") == "view").alias("has_subject"))


@C.add("compound_patterns", """
SELECT pattern, count(*) AS n FROM (SELECT event_type || '>' || lead(event_type) OVER w || '>' || lead(event_type, 2) OVER w AS pattern FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE pattern IN ('view>click>purchase', 'click>click>click', 'signup>view>click', 'error>error>error') GROUP BY pattern""")
def compound_patterns(spark, sf):
    p = F.concat("event_type", F.lit(">"), F.lead("event_type").over(_seq()), F.lit(">"), F.lead("event_type", 2).over(_seq()))
    wanted = ("view>click>purchase", "click>click>click", "signup>view>click", "error>error>error")
    return events(spark, sf).select(p.alias("pattern")).where(F.col("pattern").isin(*wanted)).groupBy("pattern").agg(count().alias("n"))


@C.add("prioritised_rules", """
SELECT event_id, CASE WHEN event_type = 'click' AND nxt = 'click' THEN 'compound' WHEN prev = 'signup' THEN 'affix' WHEN nxt = 'purchase' THEN 'role' ELSE 'none' END AS rule FROM (SELECT event_id, event_type, lag(event_type) OVER w AS prev, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def prioritised_rules(spark, sf):
    prev, nxt = F.lag("event_type").over(_seq()), F.lead("event_type").over(_seq())
    e = events(spark, sf).select("event_id", "event_type", prev.alias("prev"), nxt.alias("nxt"))
    return e.select("event_id", F.when((F.col("event_type") == "click") & (F.col("nxt") == "click"), "compound").when(F.col("prev") == "signup", "affix").when(F.col("nxt") == "purchase", "role").otherwise("none").alias("rule"))


@C.add("word_order_violations", """
SELECT event_id FROM (SELECT event_id, event_type, lead(event_type) OVER w AS nxt, lead(event_type, 2) OVER w AS nxt2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'view' AND nxt IS NOT NULL AND nxt <> 'click' AND coalesce(nxt2, '') <> 'click'""")
def word_order_violations(spark, sf):
    e = events(spark, sf).select("event_id", "event_type", F.lead("event_type").over(_seq()).alias("nxt"), F.lead("event_type", 2).over(_seq()).alias("nxt2"))
    return e.where((F.col("event_type") == "view") & (F.col("nxt") != "click") & (F.coalesce("nxt2", F.lit("")) != "click")).select("event_id")


def keep_first_apart(spans: Column) -> Column:
    """Of spans sorted by start, each that starts at or after the end of the last kept one."""

    def fold(xs) -> list[dict]:
        out: list[dict] = []
        for x in xs:
            if not out or x["start"] >= out[-1]["end"]:
                out.append(x)
        return out

    return _each(fold, "array<struct<start:bigint,end:bigint>>")(spans)


@C.add("overlap_removal", """
WITH RECURSIVE e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS a, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + CAST(trunc(value) AS BIGINT) * 600 AS z FROM events),
h AS (SELECT user_id, a // 86400 AS day, a, z, row_number() OVER (PARTITION BY user_id, a // 86400 ORDER BY a, z) AS r FROM e),
f AS (SELECT user_id, day, r, z AS last, 1 AS kept FROM h WHERE r = 1
  UNION ALL SELECT h.user_id, h.day, h.r, CASE WHEN h.a >= f.last THEN h.z ELSE f.last END, f.kept + CASE WHEN h.a >= f.last THEN 1 ELSE 0 END FROM f JOIN h ON h.user_id = f.user_id AND h.day = f.day AND h.r = f.r + 1)
SELECT user_id, day, CAST(max(r) AS INT) AS spans, CAST(max(kept) AS INT) AS kept FROM f GROUP BY user_id, day""")
def overlap_removal(spark, sf):
    e = events(spark, sf).select("user_id", F.unix_timestamp("ts").alias("start"), (F.unix_timestamp("ts") + F.col("value").cast("bigint") * 600).alias("end"))
    g = e.groupBy("user_id", F.floor(F.col("start") / 86400).alias("day")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return g.select("user_id", "day", F.size("spans").alias("spans"), F.size(keep_first_apart(F.col("spans"))).alias("kept"))


# ---- quotas and state


@C.add("daily_quota", """
SELECT user_id, day, count(*) AS asked, CAST(least(count(*), 3) AS BIGINT) AS accepted, list_sort(list(event_id))[3] AS last_accepted FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id FROM events WHERE event_type = 'click') GROUP BY ALL""")
def daily_quota(spark, sf):
    """At most three accepted a user and UTC day, in order."""
    w = Window.partitionBy("user_id", "day").orderBy("event_id")
    e = events(spark, sf).where("event_type = 'click'").select("user_id", F.to_date("ts").alias("day"), "event_id").withColumn("r", F.row_number().over(w))
    return e.groupBy("user_id", "day").agg(count().alias("asked"), F.count_if(F.col("r") <= 3).alias("accepted"), F.max(F.when(F.col("r") == 3, F.col("event_id"))).alias("last_accepted"))


@C.add("job_last_state", """
SELECT user_id, arg_max(state, event_id) AS state, count(*) AS attempts, max(event_id) AS at FROM (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'DONE' ELSE 'FAILED' END AS state FROM events) GROUP BY user_id""")
def job_last_state(spark, sf):
    state = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type").isin("view", "click"), "RUNNING").when(F.col("event_type") == "purchase", "DONE").otherwise("FAILED")
    return events(spark, sf).withColumn("state", state).groupBy("user_id").agg(F.max_by("state", "event_id").alias("state"), count().alias("attempts"), F.max("event_id").alias("at"))


@C.add("active_predecessor", "SELECT e.event_id FROM events e WHERE e.event_type = 'signup' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_id >= e.event_id - 50 AND p.event_type = 'view')")
def active_predecessor(spark, sf):
    """A row is refused while an earlier job of its key is still open: a range frame instead of a self join."""
    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-50, -1)
    e = events(spark, sf).withColumn("open", F.max((F.col("event_type") == "view").cast("int")).over(w))
    return e.where("event_type = 'signup' AND open = 1").select("event_id")


@C.add("bans_by_ttl", """
SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'error' AND b.ts < e.ts AND b.ts >= e.ts - INTERVAL 1 HOUR) AS banned FROM events e""")
def bans_by_ttl(spark, sf):
    """Banned for an hour after each offence; a new one starts the hour again."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3_600_000_000, -1)
    e = events(spark, sf).withColumn("at", micros)
    return e.select("event_id", F.coalesce(F.max(F.col("event_type") == "error").over(w), F.lit(False)).alias("banned"))


def rate_limit(hits: Column, window: int, most: int) -> Column:
    """For sorted hit times: ``struct(ok, retry)`` of each.  A bucket starts at its first hit and lasts
    ``window``; the hit that finds it over starts the next.  Refused hits count, too."""

    def fold(ts) -> list[dict]:
        reset, n, out = None, 0, []
        for t in ts.tolist():
            if reset is None or reset <= t:
                reset, n = t + window, 0
            n += 1
            out.append({"ok": n <= most, "retry": None if n <= most else max(1, reset - t)})
        return out

    return _each(fold, "array<struct<ok:boolean,retry:bigint>>")(hits)


@C.add("anchored_rate_limit", """
WITH RECURSIVE h AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT)) AS r FROM events),
f AS (SELECT user_id, r, t, t + 86400 AS reset, 1 AS n FROM h WHERE r = 1
  UNION ALL SELECT h.user_id, h.r, h.t, CASE WHEN f.reset <= h.t THEN h.t + 86400 ELSE f.reset END, CASE WHEN f.reset <= h.t THEN 1 ELSE f.n + 1 END FROM f JOIN h ON h.user_id = f.user_id AND h.r = f.r + 1)
SELECT user_id, count(*) AS hits, CAST(count_if(n > 2) AS BIGINT) AS refused FROM f GROUP BY user_id""")
def anchored_rate_limit(spark, sf):
    e = events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.unix_timestamp("ts"))).alias("t"))
    out = e.select("user_id", rate_limit(F.col("t"), 86400, 2).alias("o"))
    return out.select("user_id", F.size("o").cast("bigint").alias("hits"), F.size(F.filter("o", lambda x: ~x["ok"])).cast("bigint").alias("refused"))


@C.add("failure_latch", """
SELECT event_id, sum(bad) OVER (PARTITION BY user_id, run ORDER BY event_id) >= 3 AS latched FROM (SELECT user_id, event_id, CAST(event_type = 'error' AS INT) AS bad, sum(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)""")
def failure_latch(spark, sf):
    """Latches at three failures in a row since the last success, clears on success; per key in order."""
    e = events(spark, sf).select("user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("bad"), (F.col("event_type") == "purchase").cast("int").alias("good"))
    since = F.sum("good").over(_seq())
    e = e.withColumn("run", since)
    return e.select("event_id", (F.sum("bad").over(Window.partitionBy("user_id", "run").orderBy("event_id")) >= 3).alias("latched"))


@C.add("session_sweep", """
SELECT user_id, max(event_id) AS last_event, max(ts) + INTERVAL 2 DAY < TIMESTAMP '2024-01-31' AS expired, count(*) AS touches FROM events GROUP BY user_id""")
def session_sweep(spark, sf):
    e = events(spark, sf).groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max("ts").alias("t"), count().alias("touches"))
    return e.select("user_id", "last_event", (F.col("t") + F.expr("interval 2 days") < F.lit("2024-01-31").cast("timestamp")).alias("expired"), "touches")


@C.add("upsert_if_changed", """
SELECT c_custkey, CASE WHEN n.k IS NULL THEN 'same' WHEN n.b IS DISTINCT FROM c_acctbal OR n.s IS DISTINCT FROM c_mktsegment THEN 'changed' ELSE 'same' END AS outcome FROM customer LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS b, c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 0) n ON n.k = c_custkey""")
def upsert_if_changed(spark, sf):
    c = load(spark, sf, "customer")
    n = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("b"), F.col("c_mktsegment").alias("s"))
    changed = F.col("k").isNotNull() & ~(F.col("b").eqNullSafe(F.col("c_acctbal")) & F.col("s").eqNullSafe(F.col("c_mktsegment")))
    return c.join(n, F.col("k") == F.col("c_custkey"), "left").select("c_custkey", F.when(changed, "changed").otherwise("same").alias("outcome"))


@C.add("ledger_invariants", "SELECT count(*) AS rows, CAST(count_if(l_discount > l_quantity) AS BIGINT) AS broken, count(*) = (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)) AS totals_agree FROM lineitem")
def ledger_invariants(spark, sf):
    l = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_discount") > F.col("l_quantity")).alias("bad"))  # noqa: E741
    one = l.groupBy("l_returnflag").agg(count().alias("n"), F.count_if("bad").alias("b")).select("n", "b", F.lit(0).cast("bigint").alias("m"))
    two = l.groupBy("l_linestatus").agg(count().alias("m")).select(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("b"), "m")
    return one.union(two).agg(F.sum("n").alias("rows"), F.sum("b").alias("broken"), (F.sum("n") == F.sum("m")).alias("totals_agree"))


# ---- rule tables


@C.add("weighted_resolver", """
WITH s AS (SELECT user_id, event_type AS pos, count(*) AS k, sum(least(value, 90) / 100) AS conf FROM events WHERE event_type <> 'error' GROUP BY ALL),
c AS (SELECT u.user_id, p.pos, p.i FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['view', 'click', 'signup']) AS pos, unnest([0, 1, 2]) AS i) p),
b AS (SELECT c.user_id, c.pos, c.i, round(coalesce(conf, 0) + CASE WHEN k IS NULL THEN -0.4 WHEN k > 1 THEN least(0.06 * (k - 1), 0.18) ELSE 0 END + CASE WHEN c.i = 0 THEN 0.05 ELSE 0 END, 6) AS score FROM c LEFT JOIN s USING (user_id, pos))
SELECT user_id, CASE WHEN max(score) < 0.25 THEN 'view' ELSE arg_min(pos, (-score, i)) END AS final_pos, max(score) AS score FROM b GROUP BY user_id""")
def weighted_resolver_rows(spark, sf):
    """Candidates by supporting confidence, agreement and a nudge for the first; under the threshold the first wins."""
    e = events(spark, sf).where("event_type <> 'error'").groupBy("user_id", F.col("event_type").alias("pos")).agg(count().alias("k"), F.sum(F.least("value", F.lit(90.0)) / 100).alias("conf"))
    c = events(spark, sf).select("user_id").distinct().select("user_id", F.posexplode(F.array(F.lit("view"), F.lit("click"), F.lit("signup"))).alias("i", "pos"))
    return weighted_resolver(c.join(e, ["user_id", "pos"], "left"), "user_id")


def weighted_resolver(board: DataFrame, key: str) -> DataFrame:
    """``key, final_pos, score`` from candidates ``(key, i, pos, k supporters, conf)``."""
    score = F.coalesce("conf", F.lit(0.0)) + F.when(F.col("k").isNull(), -0.4).when(F.col("k") > 1, F.least(0.06 * (F.col("k") - 1), F.lit(0.18))).otherwise(0.0) + F.when(F.col("i") == 0, 0.05).otherwise(0.0)
    board = board.withColumn("score", F.round(score, 6))
    g = board.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("i"), F.col("pos"))).alias("b"), F.min_by("pos", "i").alias("first"))
    return g.select(key, F.when(-F.col("b.s") < 0.25, F.col("first")).otherwise(F.col("b.pos")).alias("final_pos"), (-F.col("b.s")).alias("score"))


@C.add("kernel", """
SELECT user_id, CASE WHEN tags = 'click,view' THEN 'rbvn' ELSE first_tag END AS final_pos FROM (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags, arg_min(event_type, event_id) AS first_tag FROM events GROUP BY user_id)""")
def kernel(spark, sf):
    """Exactly two known tags together make a third; else the first tag stands."""
    g = events(spark, sf).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tags"), F.min_by("event_type", "event_id").alias("first"))
    return g.select("user_id", F.when(F.col("tags") == "click,view", "rbvn").otherwise(F.col("first")).alias("final_pos"))


@C.add("term_conflicts", """
SELECT p_name, CAST(count(DISTINCT p_brand) AS BIGINT) AS spellings FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def term_conflicts(spark, sf):
    return load(spark, sf, "part").groupBy("p_name").agg(F.countDistinct("p_brand").alias("spellings")).where("spellings > 1")


# ---- votes and nearest neighbours


@C.add("code_page_scores", "SELECT label, CAST(count_if(embedding[1] > 0) AS BIGINT) AS agreed, count(*) AS tested, round(CASE WHEN count(*) >= 30 THEN count_if(embedding[1] > 0) / count(*) ELSE 0 END, 9) AS score FROM embeddings GROUP BY label")
def code_page_scores(spark, sf):
    """Agreement by candidate, 0 under a floor of tests."""
    up = F.get("embedding", F.lit(0)) > 0
    g = load(spark, sf, "embeddings").groupBy("label").agg(F.count_if(up).alias("agreed"), count().alias("tested"))
    return g.withColumn("score", F.round(F.when(F.col("tested") >= 30, F.col("agreed") / F.col("tested")).otherwise(0.0), 9))


@C.add("line_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_returnflag")
def line_fit(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


# ---- generic relational operators on the star schema


@C.add("revenue_by_flag", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def revenue_by_flag(spark, sf):
    l = load(spark, sf, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), count().alias("n"))


@C.add("nation_orders", "SELECT n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_orders(spark, sf):
    o, c, n = load(spark, sf, "orders"), load(spark, sf, "customer"), load(spark, sf, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(count().alias("orders"), F.countDistinct("c_custkey").alias("customers"))


@C.add("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@C.add("aligned_windows", "SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY ALL")
def aligned_windows(spark, sf):
    e = load(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(count().alias("n"), F.round(F.sum("value"), 6).alias("v"))
    return e.select("event_type", F.unix_timestamp("w.start").alias("hour"), "n", "v")
