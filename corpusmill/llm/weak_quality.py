"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each whole text.  Expectation
maximisation over the counts of vote patterns (at most ``3 ** labellers`` of them, from all
documents) estimates how often each labeller votes and errs, and gives each pattern a posterior.
The posteriors of a bounded sample of documents, at most about ``SAMPLE``, train a linear scorer of
hashed words and word shapes by logistic regression; it scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesets, sampling
from .quality_rules import STOP_WORDS

BITS = 16
SAMPLE = 6_000
KEEP = 0.5

_STOP_DATA = np.frombuffer("".join(STOP_WORDS).encode(), np.uint8)
_STOP_ENDS = np.cumsum([len(w.encode()) for w in STOP_WORDS])
_STOPS = np.sort(bytesets.span_hashes(_STOP_DATA, np.r_[0, _STOP_ENDS[:-1]], _STOP_ENDS))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~=+_@")] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def _echo(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each word equals the one before it in its text."""
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return same


def _distinct(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The row of each distinct hash of a row, by 40 bits of the hash."""
    key = row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)
    key.sort()
    return (key[np.r_[True, key[1:] != key[:-1]]] >> np.uint64(40)).astype(np.int64) if len(key) else row[:0]


def measures(t: bytesets.Texts) -> dict[str, np.ndarray]:
    """Counts and ratios of each text that the labellers look at, and its words."""
    n = len(t.starts)
    s, e, row = bytesets.words(t)
    folded = bytesets.LOWER[t.data]
    last = e.copy()
    for _ in range(2):  # closing punctuation
        last -= (last > s) & _CLOSING[t.data[np.maximum(last - 1, 0)]]
    h = bytesets.span_hashes(folded, s, last)
    at = np.minimum(np.searchsorted(_STOPS, h), len(_STOPS) - 1)
    filled = t.ends > t.starts

    def span(flags: np.ndarray) -> np.ndarray:
        """True bytes of each text; texts lie end to end."""
        out = np.zeros(n, np.int64)
        if filled.any():
            out[filled] = np.add.reduceat(flags, t.starts[filled], dtype=np.int64)
        return out

    words = np.bincount(row, minlength=n)
    pair = _distinct(row, h)
    ls, le, lrow = bytesets.lines(t)
    lh = bytesets.span_hashes(t.data, ls, le)
    full = (le - ls) > 3
    distinct = _distinct(lrow[full], lh[full])
    some = np.maximum(words, 1)
    return {
        "words": words,
        "length": np.bincount(row, e - s, n) / some,
        "symbols": span(_SYMBOL[t.data]) / some,
        "stops": np.bincount(row, _STOPS[at] == h, n) / some if len(h) else np.zeros(n),
        "upper": span(_UPPER[t.data]) / np.maximum(span(_ALPHA[t.data]), 1),
        "alpha": span(_ALPHA[t.data]) / np.maximum(span(~bytesets.SPACE[t.data]), 1),
        "shouts": span(t.data == 33) / some,
        "richness": np.log1p(np.bincount(pair, minlength=n)) / np.log1p(some),
        "again": np.bincount(row[1:][_echo(h, row)[1:]], minlength=n) / some,
        "lines": np.bincount(lrow[full], minlength=n),
        "distinct_lines": np.bincount(distinct, minlength=n),
        "_hash": h,
        "_row": row,
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """``(texts, labellers)``: 1 good, 0 bad, 2 abstains.

    A vocabulary grows as a power of a text's length, so its richness is the ratio of logarithms
    of distinct and all words: one measure for texts of any length.
    """
    some = m["words"] > 0

    def label(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad | ~some, 0, np.where(good, 1, 2))

    repeated = 1 - m["distinct_lines"] / np.maximum(m["lines"], 1)
    return np.stack([
        label(m["words"] >= 30, m["words"] < 8),
        label(m["symbols"] <= 0.02, m["symbols"] > 0.15),
        label(m["stops"] >= 0.10, m["stops"] < 0.03),
        label(m["upper"] <= 0.10, m["upper"] > 0.40),
        label(m["alpha"] >= 0.90, m["alpha"] < 0.75),
        label(m["shouts"] <= 0.02, m["shouts"] > 0.20),
        label(m["richness"] >= 0.80, m["richness"] < 0.70),
        label(m["again"] <= 0.01, m["again"] > 0.10),
        label((repeated <= 0.1) & (m["lines"] > 1), (repeated > 0.4) & (m["lines"] > 2)),
        label((m["length"] >= 3) & (m["length"] <= 9), (m["length"] < 2) | (m["length"] > 14)),
    ], 1)


LABELLERS = 10
_PLACES = 3 ** np.arange(LABELLERS)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM on vote patterns: ``(posterior of good by pattern, table[class, labeller, vote], prior)``.

    Starts from the majority vote; each labeller's votes are independent given the class.
    """
    cast = patterns != 2
    posterior = ((patterns == 1).sum(1) + 1.0) / (cast.sum(1) + 2.0)
    counts = counts.astype(float)
    onehot = patterns[:, :, None] == np.arange(3)
    table, prior = np.full((2, patterns.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        mass = np.stack([counts * (1 - posterior), counts * posterior])
        table = np.einsum("kp,pjv->kjv", mass, onehot) + 0.5
        table /= table.sum(2, keepdims=True)
        prior = float((mass[1].sum() + 1) / (counts.sum() + 2))
        logs = np.einsum("pjv,kjv->kp", onehot, np.log(table)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior, table, prior


def features(t: bytesets.Texts, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word shapes (length, marks, case, echo of the word before) with their row numbers."""
    s, e, row = bytesets.words(t)
    first, last = t.data[s], t.data[e - 1]
    shape = np.minimum(e - s, 15) + 16 * _UPPER[first] + 32 * _UPPER[last] + 64 * _SYMBOL[last] + 128 * _SYMBOL[first] + 256 * (last == 33) + 512 * _echo(m["_hash"], row)
    half = 1 << (BITS - 1)
    word = (m["_hash"] >> np.uint64(65 - BITS)).astype(np.int64)
    kind = half + (bytesets.mix(shape.astype(np.uint64)) >> np.uint64(65 - BITS)).astype(np.int64)
    return np.stack([word, kind], 1), row


def _votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in bytesets.texts(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(votes(measures(t)) @ _PLACES)], ["pattern"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in bytesets.texts(batch.column(0)):
            m = measures(t)
            f, row = features(t, m)
            cut = np.searchsorted(row, np.arange(len(t.starts) + 1))
            made = []
            for k in range(len(t.starts)):
                cols, n = np.unique(f[cut[k] : cut[k + 1]], return_counts=True)
                made.append((cols.astype("<u4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(votes(m) @ _PLACES), pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.binary())], ["pattern", "cols", "vals"])


class Model:
    """Posteriors by vote pattern, the labellers' table, and the linear scorer."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, sample: list[tuple[int, np.ndarray, np.ndarray]]):
        self.patterns = patterns
        self.posterior, self.table, self.prior = estimate(patterns[:, None] // _PLACES % 3, counts) if len(patterns) else (np.zeros(0), np.zeros((2, LABELLERS, 3)), 0.5)
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        self.fitted = bool(sample)
        if sample:
            self._fit(self.of(np.array([s[0] for s in sample])), [s[1] for s in sample], [s[2] for s in sample])
        self.weights = self.weights.astype(np.float32)

    def of(self, pattern: np.ndarray) -> np.ndarray:
        """The posterior of each pattern; the prior for one that training didn't meet."""
        if not len(self.patterns):
            return np.full(len(pattern), 0.5)
        at = np.minimum(np.searchsorted(self.patterns, pattern), len(self.patterns) - 1)
        return np.where(self.patterns[at] == pattern, self.posterior[at], self.prior)

    def _fit(self, y: np.ndarray, cols: list[np.ndarray], vals: list[np.ndarray], rounds: int = 200, ridge: float = 1e-4) -> None:
        n = len(y)
        row = np.repeat(np.arange(n), [len(c) for c in cols])
        col, val = np.concatenate(cols).astype(np.int64), np.concatenate(vals).astype(float)
        # both classes weigh alike, so a rare class isn't lost
        balance = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
        balance /= balance.sum()
        scale = 1 / np.sqrt(np.bincount(col, balance[row] * val**2, 1 << BITS) + 1e-4)
        val = val * scale[col]
        w, b = np.zeros(1 << BITS), 0.0
        pw, pb, t = w, b, 1.0
        rate = 4 / (1 + float((balance * np.bincount(row, val**2, n)).sum()))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * pw[col], n) + pb, -35, 35)))
            r = balance * (p - y)
            nw, nb = pw - rate * (np.bincount(col, val * r[row], 1 << BITS) + ridge * pw), pb - rate * r.sum()
            nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
            w, b, t = nw, nb, nt
        self.weights, self.bias = w * scale, b

    def score(self, t: bytesets.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The scorer's probability of good quality, and the labellers' posterior; a text without words scores 0."""
        m = measures(t)
        f, row = features(t, m)
        posterior = self.of(votes(m) @ _PLACES)
        if not self.fitted:
            return np.where(m["words"] > 0, posterior, 0.0), posterior
        total = np.bincount(row, self.weights[f[:, 0]].astype(float) + self.weights[f[:, 1]], len(t.starts))
        z = total / np.maximum(2 * m["words"], 1) + self.bias
        return np.where(m["words"] > 0, 1 / (1 + np.exp(-np.clip(z, -35, 35))), 0.0), posterior


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """EM over the vote patterns of all documents, then the scorer from a sample of at most ``sample`` different rows."""
    counted = docs.select("text").mapInArrow(_votes_of, "pattern long").groupBy("pattern").count().collect()
    counted.sort(key=lambda r: r["pattern"])
    rows = sampling.bounded(docs, sample, ["text"]).mapInArrow(_vectors, "pattern long, cols binary, vals binary").collect()
    rows.sort(key=lambda r: (r["pattern"], r["cols"], r["vals"]))  # a bounded sample: in order here, not in an exchange
    return Model(np.array([r["pattern"] for r in counted], np.int64), np.array([r["count"] for r in counted]), [(r["pattern"], np.frombuffer(r["cols"], "<u4"), np.frombuffer(r["vals"], "<f4")) for r in rows])


def classify(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """``doc_id, score, posterior, kept`` of each whole text (null: empty, never kept).

    Rows with equal texts, repeated ids or none get equal results; a model that was fitted on no rows scores
    by its labellers' posterior.  A score of exactly ``keep`` is kept.  Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for t in bytesets.texts(batch.column(1)):
                score, posterior = shared.value.score(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(int(t.rows[0]), len(t.rows)), pa.array(score), pa.array(posterior), pa.array(score >= keep)], ["doc_id", "score", "posterior", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, posterior double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, train(docs))
