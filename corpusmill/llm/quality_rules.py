"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression.  Counts are exact integers and every rule compares integer
products (``100 * numerator`` against ``limit * denominator``), so no rounding is involved.
A null or empty text has no words and fails the base rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"

# Function words that running prose of these languages can hardly avoid.
STOP_WORDS = tuple(sorted(set(
    "the of and to in is that it was for on are as with be by this at from or an not have he "
    "le la les de des et un une que qui dans en du pour par sur est au pas il elle ne "
    "der die das und zu den mit von ist ein eine nicht im auf dem des sich als auch "
    "el los las y que del se por con una para es lo como su al".split())))


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * over / under <= high``; a side that is None is open."""

    name: str
    over: str
    under: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        whole = F.lit(True)
        if self.low is not None:
            whole = whole & (100 * F.col(self.over) >= self.low * F.col(self.under))
        if self.high is not None:
            whole = whole & (100 * F.col(self.over) <= self.high * F.col(self.under))
        return whole

    def sql(self) -> str:
        parts = []
        if self.low is not None:
            parts.append(f"100 * {self.over} >= {self.low} * {self.under}")
        if self.high is not None:
            parts.append(f"100 * {self.over} <= {self.high} * {self.under}")
        return " AND ".join(parts) or "TRUE"


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=2000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=10),
    Rule("shouts_per_word", "n_shouts", "n_words", high=25),
    Rule("stop_words", "n_stop", "n_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules use, as ``bigint`` columns.

    The word array is built once a row; repeated three-word windows are found from a sorted array
    of (hash, place), and only in rows whose distinct windows are fewer than their windows.  Columns named like
    a count are replaced by it, all others stay: working columns are named apart from them.  Repeated rows are
    measured each, a null text is empty.
    """
    kept, own = docs.columns, "rules_"
    while any(c.lower().startswith(own) for c in kept):
        own = "_" + own
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(f"{own}text"))
    df = df.select("*", F.array_remove(F.split(f"{own}text", SPACES), "").alias(f"{own}words"), F.filter(F.split(f"{own}text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(f"{own}lines"))
    grams = F.when(F.size(f"{own}words") >= 3, F.transform(F.sequence(F.lit(0), F.size(f"{own}words") - 3), lambda i: F.xxhash64(F.get(f"{own}words", i), F.get(f"{own}words", i + 1), F.get(f"{own}words", i + 2))))
    df = df.select("*", grams.alias(f"{own}grams"))
    df = df.select("*", F.when(F.size(F.array_distinct(f"{own}grams")) < F.size(f"{own}grams"), F.sort_array(F.transform(f"{own}grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(f"{own}sorted"))
    same = lambda j, e: F.coalesce(F.get(f"{own}sorted", j)["h"] == e["h"], F.lit(False))
    marked = F.transform(f"{own}sorted", lambda e, j: F.when(same(j - 1, e) | same(j + 1, e), e["i"]))
    df = df.select("*", F.sort_array(F.filter(marked, lambda x: x.isNotNull())).alias(f"{own}marks"))
    gain = F.transform(f"{own}marks", lambda x, j: F.least(F.lit(3), F.coalesce(F.get(f"{own}marks", j + 1) - x, F.lit(3))))
    stop = F.filter(f"{own}words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*STOP_WORDS))
    counts = {
        "n_words": F.size(f"{own}words"),
        "word_chars": F.length(F.array_join(f"{own}words", "")),
        "n_symbols": F.regexp_count(f"{own}text", F.lit("[#*$%&|<>]")),
        "n_shouts": F.regexp_count(f"{own}text", F.lit("!")),
        "n_stop": F.size(stop),
        "n_lines": F.size(f"{own}lines"),
        "n_dup_lines": F.size(f"{own}lines") - F.size(F.array_distinct(f"{own}lines")),
        "n_repeat_words": F.coalesce(F.aggregate(gain, F.lit(0), lambda a, b: a + b), F.lit(0)),
    }
    return df.select(*[F.col(f"`{c}`") for c in kept if c.lower() not in counts], *[c.cast("bigint").alias(n) for n, c in counts.items()])


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``broken_rules`` (names) and ``kept``.

    A column of ``docs`` that is named like a result is replaced by it; no other is lost.
    """
    df = measure(docs, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    own = ("base_failed", "broken_rules", "kept")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own], base.alias("base_failed"), broken.alias("broken_rules"))
    return df.select("*", (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
marked AS (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM grams WHERE n > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(gap, 3))) AS r FROM marked GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_shouts,
        CAST(len(list_filter(words, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOP_SQL}))) AS BIGINT) AS n_stop,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(r.sql() for r in RULES)} AS kept
FROM b
"""
