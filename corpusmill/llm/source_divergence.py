"""How far the sources of each language differ in their words: divergence of each pair, and telling terms.

1. *Counts.*  Occurrences and documents of a term are counted by language and source, first for runs of about
   ``RUN`` bytes of text in each task: bytes between the separators are terms of one Arrow array, numbered
   and sorted as integers.  The counts are exchanged once, by language and term, where Spark sums them by
   source and then drops what too few documents hold.
2. *Wide vectors.*  Terms of at least ``MIN_DOCS`` documents of a language are pivoted: one row a term,
   with an array of its counts in place of the language's sources, in their order.  Counts become shares
   in whole units of a billionth, smoothed by ``PRIOR`` occurrences a term, so all sums are exact.
3. *Pairs.*  A higher-order function turns a vector into what it adds to each pair of sources, one
   source's pairs at a time, so an array is never longer than the number of sources; tasks sum these by
   pair before they exchange them.
4. *Terms.*  A source's terms with a share over its language's are ranked, and Spark keeps the first
   ``TOP`` of each group within every task already.

A vector meets its language's list of sources by a join on language and one of ``SALTS`` numbers drawn from
the term, so a language that holds most terms is dealt to many tasks where Spark doesn't find the lists
small enough to broadcast.

Null text, language and source count as empty ones.  Every row is a document, repeated rows and rows without an id
too; other columns aren't read.  A language without kept terms has pairs of value 0 and no terms; a source
alone in its language has no pairs.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesets, scratch

MIN_DOCS = 30
PRIOR = 5
UNIT = 1_000_000_000
TOP = 50
SALTS = 32

RUN = 1 << 24
ROWS = 1 << 16

#: A-Z in lower case, a-z and all bytes of other code points; 0 for what separates terms.
LETTERS = bytesets.LOWER * np.array([k >= 0x80 or chr(k).isalpha() for k in range(256)], np.uint8)


def _held(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _count(t: bytesets.Texts, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different terms of a run of texts; and of each pair of a group and a term its group, the term's place, occurrences and documents."""
    low = LETTERS[t.data]
    inside = low != 0
    starts, ends = bytesets.runs(inside, t.starts, t.ends)
    each = np.diff(np.searchsorted(starts, np.r_[t.starts, len(t.data)]))
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    del starts, ends
    coded = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(low[inside])).dictionary_encode()
    del low, inside, offsets
    terms, bits = coded.dictionary, len(each).bit_length()
    key = np.repeat(group * len(terms), each)
    key += coded.indices.to_numpy()
    key <<= bits
    key += np.repeat(np.arange(len(each), dtype=np.int32), each)
    del coded
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key >>= bits
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    docs = np.add.reduceat(new, at, dtype=np.int64) if len(at) else at
    return terms, *np.divmod(key[at], max(1, len(terms))), np.diff(np.r_[at, len(key)]), docs


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, text`` to ``lang, source, term, n, n_docs``, of each run of texts."""
    for batch in bytesets.slices(batches, ROWS):
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
        both, group = np.unique(lang * len(sources.dictionary) + source, return_inverse=True)
        of_lang, of_source = (pa.array(x) for x in np.divmod(both, max(1, len(sources.dictionary))))
        for t in bytesets.texts(batch.column(2), RUN):
            terms, at, place, n, docs = _count(t, group[t.rows])
            columns = [x.dictionary.take(of.take(pa.array(at))).cast(pa.string()) for x, of in ((langs, of_lang), (sources, of_source))]
            columns += [terms.take(pa.array(place)), pa.array(n), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, n_docs``, a language's term in one partition."""
    found = docs.select(*(_held(c).alias(c) for c in ("lang", "source", "text"))).mapInArrow(_counts, "lang string, source string, term string, n long, n_docs long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, total, by_source`` (a map) of the terms that enough documents of a language hold."""
    by_term = counts.groupBy("lang", "term")
    out = by_term.agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return out.where(F.col("n_docs") >= min_docs).drop("n_docs")


def frames(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, v, size, sources, sizes``: kept terms, their occurrences, and those of each source, of each language."""
    groups = docs.select(_held("lang").alias("lang"), _held("source").alias("source")).distinct()
    sizes = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    lists = groups.join(sizes, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return lists.join(vocabulary, "lang", "left").select("lang", zero("v"), zero("size"), F.col("g.source").alias("sources"), F.col("g.n").alias("sizes"))


def _share(count: str, size: str) -> str:
    """1 + floor(UNIT * (count + PRIOR) / (size + PRIOR * v)), in decimals of 38 digits: exact."""
    return f"1 + ({UNIT} * CAST({count} + {PRIOR} AS DECIMAL(20, 0))) DIV ({size} + {PRIOR} * v)"


def vectors(kept: DataFrame, of_lang: DataFrame) -> DataFrame:
    """``lang, term, sources, counts, shares, share``: a kept term's counts and shares by place of the source, and its share in the language."""
    salted = of_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wide = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    wide = wide.withColumn("counts", F.expr("transform(sources, s -> coalesce(by_source[s], 0))"))
    shares = F.expr(f"zip_with(counts, sizes, (c, n) -> {_share('c', 'n')})")
    return wide.select("lang", "term", "sources", "counts", shares.alias("shares"), F.expr(_share("total", "size")).alias("share"))


def pairs(wide: DataFrame, of_lang: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the summed differences of each source to each other one of its language."""
    first = wide.select("lang", "sources", "shares", F.posexplode("shares").alias("i", "x"))
    added = F.expr("zip_with(slice(sources, i + 2, size(sources)), slice(shares, i + 2, size(sources)), (b, y) -> struct(b AS b, abs(x - y) AS f))")
    found = first.select("lang", F.expr("sources[i]").alias("a"), F.explode(added).alias("p")).select("lang", "a", "p.b", "p.f")
    nothing = of_lang.select("lang", "sources", F.posexplode("sources").alias("i", "a"))
    nothing = nothing.select("lang", "a", F.explode(F.expr("slice(sources, i + 2, size(sources))")).alias("b"), F.lit(0).cast("long").alias("f"))
    sums = found.unionByName(nothing).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("p"), "value").select("lang", "p.source", "p.item", "value")


def telling_terms(wide: DataFrame) -> DataFrame:
    """``lang, source, item, value``: by how much the share of each of a source's terms is over the language's, where it is."""
    each = wide.select("lang", "term", "share", F.explode(F.arrays_zip("sources", "counts", "shares")).alias("g"))
    over = each.where((F.col("g.counts") > 0) & (F.col("g.shares") > F.col("share")))
    return over.select("lang", F.col("g.sources").alias("source"), F.col("term").alias("item"), (F.col("g.shares") - F.col("share")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs`` (``text, lang, source``); ranks start at 1 by falling value, then item."""
    kept = scratch.save(kept_terms(term_counts(docs), min_docs), "kept-terms")
    of_lang = scratch.save(frames(docs, kept), "source-lists")
    wide = vectors(kept, of_lang)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return columns(pairs(wide, of_lang), "pair").unionByName(columns(telling_terms(wide), "term").where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
t AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM t GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN t USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.c, 0) AS c,
        1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS p,
        1 + (1000000000::HUGEINT * (t.total + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
