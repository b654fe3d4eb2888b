"""Syllables by a walk forward that a second table, keyed by reversed bodies, must confirm.

Forward table ``root, step, token, rank, ids``: what may follow a root character at its first, second, ... step, in the
order of ``rank``; ``step`` null is the root's final step, taken where no numbered one is, and ends a walk.  ``ids`` says whether
syllables end with the token.  Steps belong to the root, not to what was read before, so the table allows combinations that are no
syllables.  Reverse table ``reversed, suffix, roots, rank``: the suffixes that a body read from its end has, each with
the roots that it goes with; the first in ``rank`` that lists the root confirms, and root and suffix are the id.  A walk
goes on over what isn't confirmed and falls back to the last place that was.

Both tables may have any size.  Of at most ``tries.MOST`` rows each, both are shared and texts are walked where they lie.  Else
candidates meet the reverse table in a join, once for each distinct run of characters; a large forward table is met in a join, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import joined, script, tries
from ..plans import storage
from ..plans.catalog import Catalog, load

C = Catalog()

Steps = dict  # (root, step) -> lengths of tokens, and each token's rank, itself, ids


def visited(run: str, start: int, choices) -> Iterator[int]:
    """Ends of the candidates of a walk from ``start``; ``choices(root, step, place)`` is ``(token length, ids)``, None, or False where the root has no such step."""
    root, place, step = run[start], start + 1, 1
    while place <= len(run):
        got = choices(root, step, place)
        last = got is False
        if last:
            got = choices(root, None, place)
        if not got:
            return
        place += got[0]
        if got[1]:
            yield place
        if last:
            return
        step += 1


def _clean(forward: DataFrame) -> DataFrame:
    return forward.where("length(root) = 1 AND length(token) > 0").select("root", "step", "token", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("ids", F.lit(False)).alias("ids"))


def _steps(forward: DataFrame) -> Steps:
    steps: Steps = {}
    for r in tries.rows_of(forward):
        sizes, tokens = steps.setdefault((r["root"], r["step"]), (set(), {}))
        sizes.add(len(r["token"]))
        mine = r["rank"], r["token"], r["ids"]
        tokens[r["token"]] = min(tokens.get(r["token"], mine), mine)
    return steps


def ends_in(run: str, start: int, steps: Steps) -> Iterator[int]:
    """:func:`visited` with a table in memory."""

    def choices(root, step, place):
        if (root, step) not in steps:
            return False
        sizes, tokens = steps[root, step]
        got = min((tokens[t] for t in {run[place : place + n] for n in sizes} if t in tokens), default=None)
        return got and (len(got[1]), got[2])

    return visited(run, start, choices)


class Confirmed:
    """Both tables in memory: the longest confirmed syllable at a place."""

    def __init__(self, steps: Steps, names: dict[tuple[str, str], str]):
        self.steps, self.names = steps, names

    def longest(self, sequence: str, start: int) -> tuple[int, str | None]:
        found = start + 1, None
        for end in ends_in(sequence, start, self.steps):
            name = self.names.get((sequence[start], sequence[end - 1 : start : -1]))
            if name is not None:
                found = end, name
        return found


def _walked(runs: DataFrame, forward: DataFrame) -> DataFrame:
    """``key, start, size, root, reversed`` of each candidate in each run; the forward table is shared."""
    shared = runs.sparkSession.sparkContext.broadcast(_steps(forward))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k in range(len(run)):
                        for end in ends_in(run, k, shared.value):
                            yield key, k, end - k, run[k], run[end - 1 : k : -1]

        yield from joined.batches_of(rows(), ["key", "start", "size", "root", "reversed"], [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string()])

    return runs.mapInArrow(walk, CANDIDATES)


CANDIDATES = "key binary, start int, size int, root string, reversed string"


def _met(runs: DataFrame, forward: DataFrame) -> DataFrame:
    """As :func:`_walked`, where the forward table is too large: windows ask for each token they might read, all steps of it at once."""
    roots = forward.groupBy("root").agg(F.collect_set(F.coalesce("step", F.lit(-1))).alias("steps"))
    per_step = forward.groupBy("step").agg(F.max(F.length("token")).alias("n")).collect()  # as many as a walk has steps
    reach, sizes = sum(r["n"] for r in per_step), sorted(r[0] for r in forward.select(F.length("token")).distinct().collect())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k in range(len(run)):
                        window = run[k : k + 1 + reach]
                        for place in range(1, len(window)):
                            for n in sizes:
                                if place + n <= len(window):
                                    yield key, k, window, window[0], place, window[place : place + n]

        kinds = [pa.binary(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield from joined.batches_of(rows(), ["key", "start", "window", "root", "place", "token"], kinds)

    # equal windows are walked once: a window's answer doesn't depend on where it lies
    asked = runs.mapInArrow(ask, "key binary, start int, window string, root string, place int, token string")
    tokens = forward.groupBy("root", "token").agg(F.collect_list(F.struct(F.coalesce("step", F.lit(-1)).alias("step"), "rank", "ids")).alias("reads"))
    once = asked.select("window", "root", "place", "token").distinct().join(tokens, ["root", "token"])
    heard = once.groupBy("window").agg(F.collect_list(F.struct("place", "token", "reads")).alias("heard")).withColumn("root", F.substring("window", 1, 1)).join(roots, "root")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for window, heard, steps in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    best: dict = {}
                    for h in heard:
                        for r in h["reads"]:
                            at, mine = (r["step"], h["place"]), (r["rank"], h["token"], r["ids"])
                            best[at] = min(best.get(at, mine), mine)

                    def choices(root, step, place, steps=steps, best=best):
                        step = -1 if step is None else step
                        if step not in steps:
                            return False
                        got = best.get((step, place))
                        return got and (len(got[1]), got[2])

                    for end in visited(window, 0, choices):
                        yield window, end, window[0], window[end - 1 : 0 : -1]

        yield from joined.batches_of(rows(), ["window", "size", "root", "reversed"], [pa.string(), pa.int32(), pa.string(), pa.string()])

    ends = heard.select("window", "heard", "steps").mapInArrow(walk, "window string, size int, root string, reversed string")
    return asked.select("key", "start", "window").distinct().join(ends, "window").select("key", "start", "size", "root", "reversed")


def names_of(reverse: DataFrame) -> DataFrame:
    """``root, reversed, value``: the id of each body with each root that it goes with."""
    by_root = reverse.where("length(reversed) > 0").select("reversed", "suffix", F.coalesce("rank", F.lit(0)).alias("rank"), F.explode("roots").alias("root")).where("suffix IS NOT NULL AND root IS NOT NULL")
    return by_root.groupBy("root", "reversed").agg(F.min(F.struct("rank", "suffix")).alias("f")).select("root", "reversed", F.concat("root", "f.suffix").alias("value"))


def confirmed(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """``key, spans`` of the candidates that the reverse table confirms, with their ids."""
    return candidates.join(names, ["root", "reversed"]).groupBy("key").agg(F.collect_list(F.struct("start", "size", "value")).alias("spans"))


def verified_segments(docs: DataFrame, forward: DataFrame, reverse: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pieces``: ``array<struct<surface, id>>`` by the longest confirmed syllable at each place.

    Masks in braces stay whole, white space goes, what isn't confirmed stands alone by its character without an id.  Null gives
    null, an empty text no pieces; equal texts get equal pieces; an empty table confirms nothing.
    """
    forward, names = _clean(forward), names_of(reverse)
    few_steps, few_names = tries.rows_of(forward) is not None, tries.rows_of(names)
    if few_steps and few_names is not None:
        walk = Confirmed(_steps(forward), {(r["root"], r["reversed"]): r["value"] for r in few_names})
        return tries.pieces_by_walk(docs, text, docs.sparkSession.sparkContext.broadcast(walk))
    runs = joined.runs_of_alphabet(forward.select(F.concat("root", "token").alias("x")), "x")
    candidates = _walked if few_steps else _met
    met = joined.with_answers(docs, F.col(f"`{text}`"), runs, lambda r: confirmed(candidates(r, forward), names))
    return tries.pieces_by_answers(met, text, runs)


def tables_of(syllables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of a list of syllables (``syllable``): three steps of one character, what is left is the final one; suffixes are their bodies in hex."""
    s = syllables.where("length(syllable) > 0").select(F.substring("syllable", 1, 1).alias("root"), F.expr("substring(syllable, 2)").alias("body")).distinct()
    cut = s.where("length(body) > 0").select("root", "body", F.explode(F.sequence(F.lit(1), F.least(F.length("body"), F.lit(4)))).alias("k"))
    token = F.when(F.col("k") == 4, F.expr("substring(body, 4)")).otherwise(F.expr("substring(body, k, 1)"))
    ends = (F.col("k") == 4) | (F.col("k") == F.length("body"))
    forward = cut.groupBy("root", F.when(F.col("k") < 4, F.col("k")).alias("step"), token.alias("token")).agg(F.max(ends).alias("ids"))
    forward = forward.select("root", "step", "token", (-F.length("token")).alias("rank"), "ids")
    reverse = s.where("length(body) > 0").groupBy(F.reverse("body").alias("reversed")).agg(F.collect_set("root").alias("roots"))
    return forward, reverse.select("reversed", F.concat(F.lit("-"), F.hex("reversed")).alias("suffix"), "roots", F.lit(0).alias("rank"))


SYLLABLE = "[က-ဪ][ါ-ှ]{1,6}"
LEAST = 5


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = storage.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _syllables(docs: DataFrame) -> DataFrame:
    """Syllables that ``LEAST`` places have, written once: all tables come from them."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(SYLLABLE), F.lit(0))).alias("syllable")).groupBy("syllable").agg(F.count(F.lit(1)).alias("n"))
    return _saved(found.where(F.col("n") >= LEAST).select("syllable"), "syllables")


def _documents(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", script.as_myanmar(F.coalesce("text", F.lit(""))).alias("text"))


@C.add("verified_walk")
def verified_walk(spark, sf):
    """Documents in letters of the script, walked by the syllables that five places have."""
    docs = _documents(spark, sf)
    out = verified_segments(docs, *tables_of(_syllables(docs)))
    named = F.filter("pieces", lambda p: p["id"].isNotNull())
    return out.select("doc_id", F.size("pieces").alias("pieces"), F.size(named).alias("named"), F.md5(F.array_join(F.transform(named, lambda p: p["id"]), " ")).alias("digest"))


_TEXT = script.as_myanmar_sql("coalesce(text, '')")


@C.add("reverse_suffixes", f"""
WITH s AS (SELECT x AS syllable FROM (SELECT unnest(regexp_extract_all({_TEXT}, '{SYLLABLE}')) AS x FROM documents) GROUP BY x HAVING count(*) >= {LEAST})
SELECT array_to_string(list_reverse(regexp_extract_all(substr(syllable, 2), '.')), '') AS reversed, CAST(count(DISTINCT substr(syllable, 1, 1)) AS INTEGER) AS roots FROM s GROUP BY 1""")
def reverse_suffixes(spark, sf):
    """The reverse table: bodies read from their ends, with how many roots they go with."""
    return tables_of(_syllables(_documents(spark, sf)))[1].select("reversed", F.size("roots").alias("roots"))
