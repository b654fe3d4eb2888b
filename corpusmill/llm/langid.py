"""Language identification in two steps: the family, then the language within it.

Features are hashed byte 3-grams and 4-grams of the lower-cased text, runs of anything but letters
counting as one space; a text's vector is its mean over all places, so a score is the mean weight of
its grams and whole texts are scored in one vectorised pass.  The family is chosen by linear
support vector machines, one family against the rest; within a family, every two languages have a
machine of their own and the language with most wins (then the largest margin) is taken.

Training reads a bounded sample: at most ``PER_LANG`` different documents, those of least hash, of each of at most
``MAX_LANGS`` languages, those of most documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets, sampling

BITS = 17
PER_LANG = 400
MAX_LANGS = 64
ROUNDS = 120
FOLDS = 5
UNKNOWN = "und"

# Which family a language code belongs to; a code not named is a family by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be bg sr hr bs sl sk cs pl mk".split(),
    "uralic": "fi et hu".split(),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.where(_LETTER, bytesets.LOWER, 32).astype(np.uint8)
_ANY_LETTER = regex.compile(r"\p{L}")


def grams(t: bytesets.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of a run of texts, and the row number of each.

    Each text is folded, its runs of spaces become one, and it gets a space at both ends.
    """
    folded = _FOLD[t.data]
    keep = folded != 32
    keep[1:] |= (folded[:-1] != 32)
    begins = t.starts[(t.ends > t.starts)]
    keep[begins] = folded[begins] != 32
    sizes = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(keep, out=sizes[1:])
    a, b = sizes[t.starts], sizes[t.ends]
    body = folded[keep]
    n = b - a
    whole = np.full(int(n.sum()) + 4 * len(n), 32, np.uint32)
    first = np.r_[0, np.cumsum(n + 4)[:-1]]
    whole[np.repeat(first + 1 - a, n) + np.arange(len(body))] = body
    row = np.repeat(np.arange(len(n)), n + 4)
    g3 = whole[:-3] << 16 | whole[1:-2] << 8 | whole[2:-1]
    three = (g3 * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    four = ((g3 ^ whole[3:] * np.uint32(0x01000193)) * np.uint32(0x85EBCA6B) ^ np.uint32(0x5BD1E995)) >> np.uint32(32 - BITS)
    same = row[:-3] == row[3:]
    return np.stack([three[same], four[same]], 1), row[:-3][same]


def means(t: bytesets.Texts, weights: np.ndarray) -> np.ndarray:
    """``(texts, machines)`` mean weights; ``weights`` is ``(2**BITS, machines)`` and each text has a gram or more."""
    g, row = grams(t)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    out = np.zeros((len(t.starts), weights.shape[1]))
    for m in range(weights.shape[1]):
        w = weights[:, m]
        if len(starts):
            out[row[starts], m] = np.add.reduceat(w[g[:, 0]].astype(np.float64) + w[g[:, 1]], starts)
    count = 2.0 * np.diff(np.r_[starts, len(row)])
    if len(starts):
        out[row[starts]] /= count[:, None]
    return out


class Sparse:
    """Rows of (bucket, value) for training."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.cols = np.concatenate([r[0] for r in rows]).astype(np.int64)
        self.vals = np.concatenate([r[1] for r in rows]).astype(np.float64)
        self.row = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.vals * w[self.cols], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.vals * r[self.row], 1 << BITS)


def fit_svm(x: Sparse, y: np.ndarray, rounds: int = ROUNDS, c: float = 1e4) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by accelerated gradient descent; ``y`` is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    norms = np.bincount(x.row, x.vals**2, x.n)
    w, b = np.zeros(1 << BITS), 0.0
    pw, pb, t = w, b, 1.0
    rate = 1.0 / (1.0 + 2 * c * float((weight * (norms + norms.mean())).sum()))
    scale = norms.mean() ** 0.5
    for _ in range(rounds):
        gap = np.maximum(0.0, 1 - y * (x.dot(pw) + pb * scale))
        pull = -2 * c * weight * gap * y
        nw, nb = pw - rate * (pw + x.back(pull)), pb - rate * scale * pull.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b * scale


class Model:
    """Weights of all machines; :meth:`predict` takes a run of texts."""

    def __init__(self, langs: list[str], rows: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.langs = langs
        family = [FAMILY.get(x, x) for x in langs]
        self.families = sorted(set(family))
        self.within = {f: [x for x, g in zip(langs, family, strict=True) if g == f] for f in self.families}
        machines = []
        everything = [r for x in langs for r in rows[x]]
        of = np.array([f for x, f in zip(langs, family, strict=True) for _ in rows[x]])
        sparse = Sparse(everything) if everything else None
        self.family_machines = []
        for f in self.families if len(self.families) > 2 else self.families[:1] if len(self.families) == 2 else []:
            self.family_machines.append(f)
            machines.append(fit_svm(sparse, np.where(of == f, 1.0, -1.0)))
        self.pairs = []
        for f in self.families:
            for a, b in combinations(self.within[f], 2):
                both = Sparse(rows[a] + rows[b])
                machines.append(fit_svm(both, np.r_[np.ones(len(rows[a])), -np.ones(len(rows[b]))]))
                self.pairs.append((a, b))
        self.weights = np.stack([m[0] for m in machines], 1).astype(np.float32) if machines else np.zeros((1 << BITS, 0), np.float32)
        self.bias = np.array([m[1] for m in machines])

    def predict(self, t: bytesets.Texts) -> tuple[list[str], np.ndarray]:
        n = len(t.starts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        margins = means(t, self.weights) + self.bias
        k = len(self.family_machines)
        if k == 0:
            pick, sure = np.zeros(n, np.int64), np.full(n, np.inf)
        elif k == 1:
            pick, sure = (margins[:, 0] < 0).astype(np.int64), np.abs(margins[:, 0])
        else:
            pick, sure = margins[:, :k].argmax(1), margins[:, :k].max(1)
        lang, score = np.empty(n, object), np.zeros(n)
        for f, name in enumerate(self.families):
            mine = np.flatnonzero(pick == f)
            members = self.within[name]
            wins, total = np.zeros((len(mine), len(members))), np.zeros((len(mine), len(members)))
            for m, (a, b) in enumerate(self.pairs):
                if a in members:
                    d = margins[mine, k + m]
                    i, j = members.index(a), members.index(b)
                    wins[:, i] += d >= 0
                    wins[:, j] += d < 0
                    total[:, i] += d
                    total[:, j] -= d
            best = np.lexsort((total, wins), axis=1)[:, -1] if len(mine) else np.zeros(0, np.int64)
            lang[mine] = np.array(members, object)[best]
            pair = total[np.arange(len(mine)), best] / max(1, len(members) - 1) if len(members) > 1 else np.full(len(mine), np.inf)
            with np.errstate(over="ignore"):
                score[mine] = 1 / (1 + np.exp(-2 * np.minimum(sure[mine], pair)))
        return lang.tolist(), score


def fold_of(doc_id: str) -> int:
    """The crc32 of an id's decimal text, modulo the number of folds."""
    return zlib.crc32(doc_id.encode()) % FOLDS


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1)
        for t in bytesets.texts(batch.column(0), 1 << 18):
            g, row = grams(t)
            out = []
            cut = np.searchsorted(row, np.arange(len(t.starts) + 1))
            for k in range(len(t.starts)):
                cols, n = np.unique(g[cut[k] : cut[k + 1]], return_counts=True)
                out.append((cols.astype("<u4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([langs.slice(int(t.rows[0]), len(t.rows)), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["lang", "cols", "vals"])


def train(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model:
    """A model of the ``max_langs`` most frequent non-null ``lang`` of ``docs``, from at most ``per_lang`` documents of each.

    Of equally frequent ones the first by name are learned; a language beyond that isn't, so values that are no
    languages cost neither memory nor machines.  The driver gets bounded vectors (at most ``2**BITS`` buckets each), no texts.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = sampling.bounded(labelled, per_lang, ["text", "lang"], F.col("lang"), max_langs).mapInArrow(_vectors, "lang string, cols binary, vals binary")
    rows: dict[str, list] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["cols"], r["vals"])):  # a bounded sample
        rows.setdefault(r["lang"], []).append((np.frombuffer(r["cols"], "<u4"), np.frombuffer(r["vals"], "<f4")))
    return Model(sorted(rows), rows)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each whole text.

    A null text or one without a letter is ``und`` with score 0; so is everything when nothing was learned.  Rows with
    equal texts, repeated ids or none get equal languages; a row without an id isn't held out.  Languages with equally many wins
    go by the larger sum of margins, then by the later name.  Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for t in bytesets.texts(batch.column(1), 1 << 18):
                ids = batch.column(0).slice(int(t.rows[0]), len(t.rows))
                lang, score = m.predict(t)
                plain = np.r_[0, np.cumsum(_LETTER[t.data] & (t.data < 128))]
                for k in np.flatnonzero(plain[t.ends] == plain[t.starts]).tolist():  # no Latin letter: perhaps another one
                    a, b = int(t.starts[k]), int(t.ends[k])
                    if not _ANY_LETTER.search(t.data[a:b].tobytes().decode("utf-8", "replace")):
                        lang[k], score[k] = UNKNOWN, 0.0
                held = [x is not None and fold_of(str(x)) == 0 for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0)
    return classify(docs, train(seen))
