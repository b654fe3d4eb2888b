"""Toxicity by cumulative-link ordinal regression on sparse text features.

``P(severity > k) = sigmoid(w . x - threshold_k)``: one weight vector, ordered thresholds.  ``x``
holds the hashed lower-cased words of a text with the logarithm of their counts, ``log2(1 + n)``, so
a word said once weighs 1.  Features are the buckets that labelled toxic documents use significantly
more often, or less often, than clean ones; the binary labels are graded by how often the telling
words occur in a toxic document (mild, marked, severe), which ``x`` shows, too.

A null or empty text has no words and the severity of an empty ``x``.  Rows are scored one by one,
whatever their ids; labels without an id or a text train nothing, and of several labels of one id
the highest counts.

Training reads a bounded sample of labelled rows: at most about ``SAMPLE`` documents, those of
lowest hash.  Expected severity is the sum of the exceedance probabilities, 0 to ``GRADES - 1``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets, sampling

BITS = 32
SAMPLE = 8_000
FEATURES = 512
GRADES = 4
STEPS = (0, 1, 3)
REJECT = 0.5
RIDGE = 0.02

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def buckets(t: bytesets.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word (letters, digits and bytes over 127, A-Z lower-cased) and its row number."""
    s, e = bytesets.runs(_WORD[t.data], t.starts, t.ends)
    h = bytesets.span_hashes(bytesets.LOWER[t.data], s, e)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), bytesets.owner(t, s)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in bytesets.texts(batch.column(1)):
            b, row = buckets(t)
            cut = np.searchsorted(row, np.arange(len(t.starts) + 1))
            made = []
            for k in range(len(t.starts)):
                cols, n = np.unique(b[cut[k] : cut[k + 1]], return_counts=True)
                made.append((cols.astype("<u4").tobytes(), n.astype("u1" if n.max(initial=0) < 256 else "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(int(t.rows[0]), len(t.rows)), pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.binary())], ["doc_id", "cols", "counts"])


def gradient(w: np.ndarray, theta: np.ndarray, row: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """The penalised log likelihood of the grades and its gradient by weights and thresholds.

    Of ``theta`` the first is the lowest threshold, the others are logarithms of the gaps; the sparse
    matrix has ``x`` at ``(row, at)``.
    """
    n, steps = len(grade), np.exp(theta[1:])
    cuts = theta[0] + np.r_[0, np.cumsum(steps)]
    f = np.bincount(row, x * w[at], n)
    up = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts, -35, 35)))
    both = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], 1)
    i = np.arange(n)
    high, low = both[i, grade], both[i, grade + 1]
    p = np.maximum(high - low, 1e-12)
    d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
    by_cut = np.array([d_low[grade == g].sum() - d_high[grade == g + 1].sum() for g in range(len(cuts))])
    beyond = np.cumsum(by_cut[::-1])[::-1]
    by_weight = np.bincount(at, x * (d_high - d_low)[row], len(w)) - ridge * w
    return float(np.log(p).sum() - ridge / 2 * (w**2).sum()), np.r_[by_weight, beyond[0], beyond[1:] * steps]


class Model:
    """Weights by bucket and ordered thresholds; without toxic labels nothing is toxic."""

    def __init__(self, rows: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray):
        n = len(rows)
        self.chosen, self.weights = np.zeros(0, np.int64), np.zeros(0)
        self.thresholds = np.full(GRADES - 1, 30.0)
        bad, good = int(toxic.sum()), int(n - toxic.sum())
        if not bad or not good:
            return
        row = np.repeat(np.arange(n), [len(r) for r in rows])
        names, col = np.unique(np.concatenate(rows), return_inverse=True)
        size = len(names)
        count = np.concatenate(counts).astype(np.int64)
        with_bad, with_good = np.bincount(col[toxic[row]], minlength=size), np.bincount(col[~toxic[row]], minlength=size)
        p, q = (with_bad + 0.5) / (bad + 1), (with_good + 0.5) / (good + 1)
        # signed root of the likelihood-ratio statistic of a bucket's presence against toxicity
        both = with_bad + with_good
        expected = both * bad / n, both * good / n
        ratio = 2 * sum(o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-9)) for o, e in zip((with_bad, with_good), expected, strict=True))
        z = np.sign(p - q) * np.sqrt(np.maximum(ratio, 0))
        z[with_bad + with_good < 5] = 0
        seen = int((with_bad + with_good >= 5).sum())
        least = np.sqrt(2 * np.log(max(seen, 2))) + 0.5
        order = np.lexsort((np.arange(size), -np.abs(z)))[:FEATURES]
        chosen = np.sort(order[np.abs(z[order]) > least])
        telling = np.zeros(size, bool)
        telling[chosen[(z[chosen] > 0) & (p[chosen] > 4 * q[chosen])]] = True
        hits = np.bincount(row, count * telling[col], n)
        grade = np.where(toxic, 1 + (hits[:, None] > np.array(STEPS[1:])).sum(1), 0)
        place = np.full(size, -1)
        place[chosen] = np.arange(len(chosen))
        kept = place[col] >= 0
        self.chosen = names[chosen].astype(np.int64)
        self._fit(row[kept], place[col[kept]], np.log2(1 + count[kept]), grade)

    def _fit(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray, rounds: int = 400) -> None:
        """Maximise the likelihood of the grades by accelerated ascent."""
        n, m = len(grade), len(self.chosen)
        above = grade[:, None] > np.arange(GRADES - 1)
        share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
        start = -np.log(share / (1 - share))
        # thresholds stay in order: the first is free, the gaps are exponentials
        theta = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]
        w = np.zeros(m)
        moments = [np.zeros(m + GRADES - 1), np.zeros(m + GRADES - 1)]
        for k in range(1, rounds + 1):
            grad = gradient(w, theta, row, at, x, grade)[1] / n
            moments = [0.9 * moments[0] + 0.1 * grad, 0.999 * moments[1] + 0.001 * grad**2]
            step = 0.1 * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.999**k)) + 1e-8)
            w, theta = w + step[:m], theta + step[m:]
        self.weights = w
        self.thresholds = theta[0] + np.r_[0, np.cumsum(np.exp(theta[1:]))]

    def score(self, t: bytesets.Texts) -> np.ndarray:
        """Exceedance probabilities ``(texts, GRADES - 1)``."""
        f = np.zeros(len(t.starts))
        if len(self.chosen):
            b, row = buckets(t)
            at = np.minimum(np.searchsorted(self.chosen, b), len(self.chosen) - 1)
            hit = self.chosen[at] == b
            pair, n = np.unique(row[hit] << BITS | b[hit], return_counts=True)
            f = np.bincount(pair >> BITS, np.log2(1 + n) * self.weights[np.searchsorted(self.chosen, pair & ((1 << BITS) - 1))], len(f))
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.thresholds, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents; null labels are left out.

    Of the labelled ids the ``sample`` of least hash are taken (a repeated label is toxic if one of its rows
    is), and of the rows with these ids again at most ``sample`` different ones, so a repeated id neither floods the
    driver nor is left out.  The driver gets distinct buckets with counts, no texts.
    """
    marked = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    marked = marked.where("_id IS NOT NULL").orderBy(F.xxhash64("_id", F.lit("toxicity")), "_id").limit(sample)
    spark = docs.sparkSession
    ids = spark.createDataFrame(marked.collect(), "_id long, toxic int")  # at most ``sample`` rows of two numbers
    labelled = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    vectors = sampling.bounded(labelled, sample, ["doc_id", "text"]).mapInArrow(_vectors, "doc_id long, cols binary, counts binary")
    rows = vectors.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "cols", "counts", "toxic").toPandas()
    rows = rows.sort_values(["doc_id", "cols", "counts"], kind="stable")  # a bounded sample: in order here, not in an exchange
    return Model([np.frombuffer(x, "<u4") for x in rows["cols"]], [np.frombuffer(n, "u1" if 4 * len(n) == len(c) else "<u4") for c, n in zip(rows["cols"], rows["counts"], strict=True)], rows["toxic"].to_numpy() > 0)


def _scored(docs: DataFrame, model: Model, schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for t in bytesets.texts(column):
                yield make(batch.slice(int(t.rows[0]), len(t.rows)), shared.value.score(t))

    return docs.mapInArrow(run, schema)


def grade(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """``doc_id, p_toxic, expected_severity, grade, toxic, kept`` of each whole text (null: empty).

    Rows with equal texts, repeated ids or none get equal results; other columns aren't read.  ``grade`` is the number of exceedance probabilities of a half or more; a document is toxic when
    that of the first grade reaches ``reject``.
    """

    def make(batch, p):
        toxic = p[:, 0] >= reject
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(toxic), pa.array(~toxic)], ["doc_id", "p_toxic", "expected_severity", "grade", "toxic", "kept"])

    return _scored(docs.select("doc_id", "text"), model, "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean, kept boolean", make)


def clean(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, all columns unchanged; repeated rows and rows without an id are judged by their text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            keep = np.concatenate([shared.value.score(t)[:, 0] < reject for t in bytesets.texts(column)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
