"""Queries over normalisation, repair, segmentation, encoding detection and the guarded upsert."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clusters, repair, script
from ..plans.catalog import Catalog, load
from .graph import connected

C = Catalog()
_MM = script.as_myanmar_sql("coalesce(text, '')")


def _texts(spark, sf) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", script.as_myanmar(F.coalesce("text", F.lit(""))).alias("t"))


_GLUE_SQL = f"translate(nfc_normalize(t), '{repair.GLUE}', '')"


@C.add("normalized_text", f"SELECT doc_id, md5({_GLUE_SQL}) AS digest FROM (SELECT doc_id, {_MM} AS t FROM documents)")
def normalized_text(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5(repair.column(repair.normalize_text)("t")).alias("digest"))


@C.add("ordered_text")
def ordered_text(spark, sf):
    """Normalised, marks in order, impossible signs gone; with the structural score before and after."""
    d = _texts(spark, sf).select("doc_id", "t", clusters.order_column(repair.GLUE)("t").alias("fixed"))
    d = d.select("doc_id", "fixed", clusters.structural_score(F.col("t")).alias("was"), clusters.structural_score(F.col("fixed")).alias("now"))
    return d.select("doc_id", F.md5("fixed").alias("digest"), F.round("was.disorder", 9).alias("before"), F.round("now.disorder", 9).alias("after"))


@C.add("cleaned_text")
def cleaned_text(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5(repair.column(repair.cleanup_text)("t")).alias("digest"))


@C.add("memory_form", r"SELECT conv_id, turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM conversations")
def memory_form(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", F.md5(repair.column(repair.memory_text)("text")).alias("digest"))


def lexicon(docs: DataFrame, column: str = "t", least: int = 3) -> DataFrame:
    """Words of at least ``least`` documents, as a table."""
    w = docs.select("doc_id", F.explode(F.array_distinct(F.split(column, r"\s+"))).alias("word")).where("length(word) >= 2")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


@C.add("lookalike_repairs")
def lookalike_repairs(spark, sf):
    """Tokens with exactly one look-alike variant in the lexicon: variants by join, no broadcast set."""
    d = _texts(spark, sf)
    words = lexicon(d)
    tokens = d.select(F.explode(F.split("t", r"\s+")).alias("token")).where("length(token) >= 2").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    unknown = tokens.join(words, tokens.token == words.word, "left_anti")

    @F.pandas_udf("array<string>")
    def variants(s: pd.Series) -> pd.Series:
        return s.map(repair.variants_of)

    tried = unknown.select("token", "n", F.explode(variants("token")).alias("word"))
    hits = tried.join(words, "word").groupBy("token", "n").agg(F.count(F.lit(1)).alias("hits"), F.min("word").alias("fixed"))
    return hits.where("hits = 1").select("token", "fixed", "n")


_GLUED = "CASE WHEN length(token) % 5 = 4 THEN token || '၁၂' WHEN length(token) % 7 = 3 THEN '၃' || token ELSE token END"


@C.add("glued_numbers", rf"""
WITH d AS (SELECT doc_id, {_MM} AS t FROM documents),
w AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(t, '\s+'))) AS word FROM d) WHERE length(word) >= 2 GROUP BY word HAVING count(*) >= 3),
k AS (SELECT token, count(*) AS n FROM (SELECT {_GLUED} AS token FROM (SELECT unnest(regexp_split_to_array(t, '\s+')) AS token FROM d)) WHERE regexp_matches(token, '[{script.DIGITS}]') GROUP BY token),
u AS (SELECT token, n, regexp_extract(token, '^(.+?)([{script.DIGITS}]+)$', 1) AS before, regexp_extract(token, '^([{script.DIGITS}]+)(.+)$', 2) AS behind FROM k WHERE token NOT IN (SELECT word FROM w)),
f AS (SELECT *, before IN (SELECT word FROM w) AS a, behind IN (SELECT word FROM w) AS b FROM u)
SELECT token, CASE WHEN a THEN before ELSE behind END AS word, n FROM f WHERE a <> b""")
def glued_numbers(spark, sf):
    """Digit runs glued to one end of a lexicon word; the texts have some put there by length."""
    d = _texts(spark, sf)
    words = lexicon(d)
    t = d.select(F.explode(F.split("t", r"\s+")).alias("token"))
    n = F.length("token")
    t = t.select(F.when(n % 5 == 4, F.concat("token", F.lit("၁၂"))).when(n % 7 == 3, F.concat(F.lit("၃"), "token")).otherwise(F.col("token")).alias("token"))
    t = t.where(f"token rlike '[{script.DIGITS}]'").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    t = t.join(words, t.token == words.word, "left_anti")
    part = lambda p, k: F.regexp_extract("token", p, k)
    tail, head = f"^(.+?)([{script.DIGITS}]+)$", f"^([{script.DIGITS}]+)(.+)$"
    t = t.select("token", "n", part(tail, 1).alias("before"), part(head, 2).alias("behind"))
    a, b = words.select(F.col("word").alias("before"), F.lit(True).alias("at_tail")), words.select(F.col("word").alias("behind"), F.lit(True).alias("at_head"))
    t = t.join(a, "before", "left").join(b, "behind", "left").where(F.coalesce("at_tail", F.lit(False)) != F.coalesce("at_head", F.lit(False)))
    return t.select("token", F.when(F.col("at_tail"), F.col("before")).otherwise(F.col("behind")).alias("word"), "n")


def segment_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, segments, known`` of ``repair.segment_text`` on each ``t``: segments, and those of two characters or more.

    ``words`` (``word``, none with whitespace) may be of any size.  Whitespace stands alone, so tokens are
    segmented by themselves: one that is a word is one segment; the distinct others look their substrings
    up by a join and are segmented with the words that this finds.  Ids are unique.
    """
    tokens = F.filter(F.split("t", r"\s+"), lambda x: x != "")
    spaces = F.length("t") - F.length(F.regexp_replace("t", r"\s+", ""))
    whole = docs.select("doc_id", (F.size(tokens) + spaces).alias("segments"), F.size(F.filter(tokens, lambda x: F.length(x) > 1)).alias("known"))
    each = docs.select("doc_id", F.explode(tokens).alias("token")).where("length(token) > 1")
    words = words.where("length(word) > 1").select("word").distinct()
    other = each.select("token").distinct().join(words, F.col("token") == F.col("word"), "left_anti")
    if not other.take(1):
        return whole
    sizes = F.array(*[F.lit(r[0]) for r in words.select(F.length("word")).distinct().collect()], F.lit(2))
    at = other.select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    at = at.select("token", "i", F.explode(F.filter(F.array_distinct(sizes), lambda n: n <= F.length("token") - F.col("i") + 1)).alias("n"))
    pieces = at.select("token", F.substring(F.col("token"), F.col("i"), F.col("n")).alias("word")).distinct()
    found = pieces.join(words, "word").groupBy("token").agg(F.collect_list("word").alias("words"))

    @F.pandas_udf("struct<segments:int,known:int>")
    def count(token: pd.Series, words: pd.Series) -> pd.DataFrame:
        found = [repair.segment_text(t, set(w), max(map(len, w), default=1)) for t, w in zip(token, words, strict=True)]
        return pd.DataFrame({"segments": [len(f) for f in found], "known": [sum(len(x) > 1 for x in f) for f in found]})

    cut = other.join(found, "token", "left").select("token", count("token", F.coalesce("words", F.array().cast("array<string>"))).alias("c"))
    more = each.join(cut, "token").groupBy(F.col("doc_id").alias("_id")).agg(F.sum(F.col("c.segments") - 1).alias("s"), F.sum(F.col("c.known") - 1).alias("k"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).cast("int").alias(c)
    return whole.join(more, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", plus("segments", "s"), plus("known", "k"))


@C.add("lexicon_segments")
def lexicon_segments(spark, sf):
    """Longest-match segments of each text against all words of the texts."""
    d = _texts(spark, sf)
    return segment_counts(d, d.select(F.explode(F.split("t", r"\s+")).alias("word")))


def detect_script(matrix: np.ndarray, alphabet: str):
    """A bigram detector: log-likelihood difference of two encodings by letter pairs.

    ``matrix[i, j]`` is the weight of letter ``j`` after ``i``; 0 is any letter outside ``alphabet``.
    NaN weights are passed over; a text with none left is unknown (null).
    """
    place = {c: k + 1 for k, c in enumerate(alphabet)}

    @F.pandas_udf("double")
    def probability(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> float | None:
            codes = [0, *(place.get(c, 0) for c in t or ""), 0]
            w = matrix[codes[:-1], codes[1:]]
            w = w[~np.isnan(w)]
            return float(1 / (1 + math.exp(-max(-700.0, min(700.0, float(w.sum())))))) if len(w) else None

        return s.map(one)

    return probability


@C.add("encoding_detector")
def encoding_detector(spark, sf):
    """Probability of the first of two encodings by a synthetic matrix, and the category it means."""
    letters = script.AS_MYANMAR
    rnd = np.random.default_rng(7)
    matrix = rnd.normal(0, 0.05, (len(letters) + 1, len(letters) + 1))
    matrix[0, 0] = np.nan
    p = _texts(spark, sf).select("doc_id", detect_script(matrix, letters)("t").alias("p"))
    return p.select("doc_id", F.round("p", 6).alias("p"), F.when(F.col("p").isNull(), "UNKNOWN").when(F.col("p") > 0.5, "FIRST").otherwise("SECOND").alias("category"))


def guarded_upsert(stored: DataFrame, arriving: DataFrame, least: int = 200) -> DataFrame:
    """Merge arriving rows in order into a collection: ``book, text, sha256, outcome_counts``.

    Rows are ``(seq, author, book, text, segmented, sha256)``.  A row is matched by its file hash,
    else by its stripped text of ``least`` characters or more, else by its name.  Equal words under
    another name, or with the same hash, are denied; equal words with another hash correct the hash;
    other words for a known hash replace the text under the old name.  Keys of replaced texts stay.

    Only rows connected by a hash, a text or a name depend on each other: connected groups are folded
    each in its own group, in order; everything else is untouched.
    """
    cols = ["author", "book", "text", "segmented", "sha256"]
    every = stored.select(F.lit(0).alias("new"), "seq", *cols).unionByName(arriving.select(F.lit(1).alias("new"), "seq", *cols))
    every = every.withColumn("row", F.xxhash64("new", "seq", *cols))  # rows that are equal in all have one, and one text
    digest = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(_BLANK))
    light = every.select("new", "seq", "row", F.coalesce("book", F.lit("")).alias("book"), F.when(F.col("sha256") != "", digest(F.col("sha256"))).alias("sha"), digest(text).alias("text"), (F.length(text) >= least).alias("long"), F.col("book").isNotNull().alias("named"))
    keys = F.array(F.when(F.col("named"), F.concat(F.lit("b:"), "book")), F.concat(F.lit("s:"), F.hex("sha")), F.when(F.col("long"), F.concat(F.lit("t:"), F.hex("text"))))
    group = connected(light.select("row", keys.alias("keys"))).distinct()
    dealt = light.drop("named").join(group, "row").repartition("group").sortWithinPartitions("group", "new", "seq", "row")
    folded = dealt.select("group", "new", "row", "book", "sha", "text", "long").mapInArrow(_fold, "row long, book string, added long, replaced long, denied long")
    full = every.groupBy("row").agg(*[F.coalesce(F.first(c), F.lit("")).alias(c) for c in cols if c != "book"])
    return folded.join(full, "row", "left").select("author", "book", "text", "segmented", "sha256", "added", "replaced", "denied")


#: What Python strips from the ends of a text.
_BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of rows one after another, in order: of texts and hashes only digests are held, and no row but those kept."""
    group, kept, by_sha, by_text, by_book, tally = None, [], {}, {}, {}, [0, 0, 0]

    def closed() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(kept), 10_000):
            part = kept[at : at + 10_000]
            counts = [[n if not at and not i else 0 for i in range(len(part))] for n in tally]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["row", "book", "added", "replaced", "denied"])

    for batch in batches:
        for g, new, row, book, sha, text, long in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != group:
                yield from closed()
                group, kept, by_sha, by_text, by_book, tally = g, [], {}, {}, {}, [0, 0, 0]
            k = None
            if new:
                k = by_sha.get(sha) if sha is not None else None
                k = by_text.get(text) if k is None and long else k
                if k is not None:
                    _, name, had, hash_ = kept[k]
                    if had == text and (name != book or hash_ == sha):
                        tally[2] += 1
                        continue
                    book = name
                else:
                    k = by_book.get(book)
            if k is None:
                k = len(kept)
                kept.append((row, book, text, sha))
                by_book.setdefault(book, k)
                tally[0] += new
            else:
                kept[k] = (row, book, text, sha)
                tally[1] += 1
            if sha is not None:
                by_sha[sha] = k
            if long:
                by_text[text] = k
    yield from closed()


@C.add("guarded_upsert")
def guarded_upsert_rows(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.lit("").alias("author"), F.concat("source", F.lit("-"), F.col("doc_id") % 40).alias("book"), "text", F.lit("").alias("segmented"), F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise("").alias("sha256"))
    even = d.where("seq % 2 = 0")
    first = even.groupBy("book").agg(F.min(F.struct("seq", "author", "text", "segmented", "sha256")).alias("r")).select("r.seq", "r.author", "book", "r.text", "r.segmented", "r.sha256")
    out = guarded_upsert(first, d.where("seq % 2 = 1").unionByName(even.join(first, "seq", "left_anti")))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum("added").alias("added"), F.sum("replaced").alias("replaced"), F.sum("denied").alias("denied"))


# ---- nearest neighbours with a margin


@C.add("nearest_with_margin", """
WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, e.label AS own, c.label, round(sqrt(list_sum(list_transform(list_zip(e.embedding, c.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS d FROM embeddings e CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM s)
SELECT a.vec_id, a.label AS nearest, b.d - a.d > 0.02 AS accepted FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.k = 1 AND b.k = 2""")
def nearest_with_margin(spark, sf):
    """The nearest class centre of each vector, accepted only with a margin to the next.

    Centres are one a class; over 10,000 are refused before more are read (shape_matching searches
    references of any number).
    """
    e = load(spark, sf, "embeddings")
    centre = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centres = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c")).orderBy("label").limit(10_001).collect()
    if len(centres) > 10_000:
        raise ValueError("too many classes to compare each vector with all of them")
    labels = [int(r["label"]) for r in centres]
    shared = spark.sparkContext.broadcast(np.array([r["c"] for r in centres]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            v = np.array(b["embedding"].tolist(), np.float64)
            d = np.round(np.sqrt(((v[:, None, :] - c[None]) ** 2).sum(2)), 6)
            order = np.argsort(d, axis=1, kind="stable")
            i = np.arange(len(v))
            yield pd.DataFrame({"vec_id": b["vec_id"], "nearest": [labels[k] for k in order[:, 0]], "accepted": np.round(d[i, order[:, 1]] - d[i, order[:, 0]], 9) > 0.02})

    return e.select("vec_id", "embedding").mapInPandas(run, "vec_id long, nearest int, accepted boolean")
