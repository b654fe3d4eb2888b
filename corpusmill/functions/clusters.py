"""Vectorised passes over whole batches of Myanmar text: base letters with their marks.

The texts of a batch lie end to end as code points; classes come from a table of the script's block,
so counting and reordering are array operations, whatever the number of rows.  A batch of Arrow is taken
in parts, as arrays are some thirty times a text's size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repair import cluster_spans
from .script import MARK_ORDER

LOW, HIGH = 0x1000, 0x109F
VIRAMA, PREBASE, AFTER_E = 0x1039, (0x1031, 0x103C), (0x102D, 0x102F, 0x1030, 0x1036)
SPACE, BREAK = 17, 18

_RANK = np.zeros(HIGH - LOW + 3, np.int8)
_RANK[[ord(c) - LOW for c in MARK_ORDER]] = np.arange(1, len(MARK_ORDER) + 1)
_BASE = np.zeros(HIGH - LOW + 3, bool)
_BASE[0x1000 - LOW : 0x1022 - LOW] = True  # the consonants and the first vowel
_BASE[[0x1025 - LOW, 0x1027 - LOW]] = True


#: Bytes of text that a pass holds as arrays at once, which then stay in the cache; a longer text is a part of its own.
PART = 1 << 17


def parts(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The array in slices of at most ``most`` bytes (``PART`` by default)."""
    most = most or PART
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = max(to, at + 1)
        yield texts.slice(at, to - at)
        at = to


def text_column(f: Callable[[list[str]], list[str]]):
    """A column function of a function of lists of strings; null stays null."""

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        done = []
        for part in parts(texts):
            known = part.is_valid()
            made = iter(f(part.drop_null().to_pylist()))
            done.append(pa.array((next(made) if k else None for k in known.to_pylist()), pa.string()))
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return apply


class Batch:
    """Code points of many texts end to end."""

    def __init__(self, texts: list[str]):
        sizes = [len(t) for t in texts]
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.row = np.repeat(np.arange(len(texts)), sizes)
        self.n = len(texts)

    def classes(self) -> None:
        at = np.where((self.codes >= LOW) & (self.codes <= HIGH), self.codes - LOW, HIGH - LOW + 1)
        self.inside, self.rank, self.base = at <= HIGH - LOW, _RANK[at], _BASE[at]

    def keep(self, mask: np.ndarray) -> None:
        self.codes, self.row = self.codes[mask], self.row[mask]

    def texts(self) -> list[str]:
        cuts = np.searchsorted(self.row, np.arange(self.n + 1)).tolist()
        whole = self.codes.tobytes().decode("utf-32-le", "surrogatepass")
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def before(self, flags: np.ndarray) -> np.ndarray:
        """Whether the place before, in the same text, has the flag."""
        out = np.zeros(len(flags), bool)
        out[1:] = flags[:-1] & (self.row[1:] == self.row[:-1])
        return out

    def run_of(self, member: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """The place that leads the unbroken run of members that each place is in; -1 outside runs behind a lead."""
        broken = ~member & ~lead
        broken[:1] |= ~lead[:1]
        broken[1:] |= (self.row[1:] != self.row[:-1]) & ~lead[1:]
        last = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), -1))
        stop = np.maximum.accumulate(np.where(broken, np.arange(len(lead)), -1))
        return np.where(member & (last > stop), last, -1)


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """Of each text: ``n, script, marks, orphans, pairs, disorder, attached, duplicate``.

    A run is a base and the marks right after it.  Marks outside runs are orphans; neighbours in a run
    against the canonical order are disorder; a mark that comes again in its run is a duplicate.
    """
    b = Batch(texts)
    b.classes()
    mark = b.rank > 0
    lead = b.run_of(mark, b.base)
    held = lead >= 0
    per = lambda flags: np.bincount(b.row[flags], minlength=b.n)
    pair = np.zeros(len(mark), bool)
    pair[1:] = held[1:] & held[:-1] & (lead[1:] == lead[:-1])
    worse = np.zeros(len(mark), bool)
    worse[1:] = pair[1:] & (b.rank[:-1] > b.rank[1:])
    place = np.flatnonzero(held)
    key = lead[place] * 32 + b.rank[place]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(mark), bool)
    again[place[order[1:]]] = key[order[1:]] == key[order[:-1]]
    size = np.bincount(b.row, minlength=b.n)
    return {"n": size, "script": per(b.inside), "marks": per(mark), "orphans": per(mark & ~held), "pairs": per(pair), "disorder": per(worse), "attached": per(held), "duplicate": per(again)}


def ordered(texts: list[str], glue: str) -> list[str]:
    """Each text composed, without glue, its marks moved, sorted and cleared of impossible ones.

    A vowel e or medial r written before its consonant where no letter of the script precedes moves
    behind it; the marks after a base come in canonical order, one of each; after the vowel e the
    signs that can't follow it go.
    """
    b = Batch([unicodedata.normalize("NFC", t) for t in texts])
    b.keep(~np.isin(b.codes, [ord(c) for c in glue]))
    b.classes()
    # marks written before their base
    early = np.isin(b.codes, PREBASE)
    start = early & ~b.before(early)
    letter = b.base | (b.rank > 0) | (b.codes == VIRAMA)
    start &= ~b.before(letter)
    head = b.run_of(early, start)
    head[start] = np.flatnonzero(start)
    ends = np.flatnonzero(b.before(head >= 0) & b.base & ~early)
    if len(ends):
        index = np.arange(len(b.codes))
        first = head[ends - 1]
        length = ends - first
        inner = np.repeat(first, length) + 1 + np.arange(length.sum()) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)
        index[inner] = inner - 1
        index[first] = ends
        b.codes = b.codes[index]
        b.classes()
    _sort_marks(b)
    # signs that can't follow the vowel e
    bad = np.isin(b.codes, AFTER_E)
    b.keep(b.run_of(bad, b.codes == PREBASE[0]) < 0)
    return b.texts()


def sorted_marks(texts: list[str], glue: str = "") -> list[str]:
    """Each text without glue, the marks after each base in order, one of each."""
    b = Batch(texts)
    b.keep(~np.isin(b.codes, [ord(c) for c in glue]))
    b.classes()
    _sort_marks(b)
    return b.texts()


def _sort_marks(b: Batch) -> None:
    """The marks, spaces and line breaks after each base by rank, one of each."""
    rank = b.rank.astype(np.int64)
    rank[b.codes == 0x20], rank[b.codes == 0x0A] = SPACE, BREAK
    lead = b.run_of(rank > 0, b.base)
    place = np.flatnonzero(lead >= 0)
    key = lead[place] * 32 + rank[place]
    order = np.argsort(key, kind="stable")
    b.codes = b.codes.copy()
    b.codes[place] = b.codes[place[order]]
    keep = np.ones(len(b.codes), bool)
    keep[place[1:]] = key[order[1:]] != key[order[:-1]]
    b.keep(keep)


_FIELDS = ("score", "orphan", "disorder", "duplicate", "marks", "ratio")


def _scores(texts: pa.Array) -> pa.Array:
    made = []
    for part in parts(texts):
        c = counts(pc.fill_null(part, "").to_pylist())
        share = lambda a, b: c[a] / np.maximum(c[b], 1)  # noqa: B023, E731
        orphan, disorder = share("orphans", "marks"), share("disorder", "pairs")
        score = np.where(c["marks"] > 0, 1 - np.maximum(orphan, disorder), 0.0)
        made.append((score, orphan, disorder, share("duplicate", "attached"), c["marks"].astype(np.int64), share("script", "n")))
    columns = [np.concatenate(x) for x in zip(*made, strict=True)] or [np.zeros(0, np.int64 if name == "marks" else np.float64) for name in _FIELDS]
    return pa.StructArray.from_arrays([pa.array(x) for x in columns], list(_FIELDS))


def structural_score(text: Column) -> Column:
    """``struct(score, orphan, disorder, duplicate, marks, ratio)``; without marks the score is 0, null is empty."""
    return F.arrow_udf(_scores, "score double, orphan double, disorder double, duplicate double, marks bigint, ratio double")(text)


def with_structural_score(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the fields of :func:`structural_score` as columns."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in _FIELDS]
    return df.select(*kept, structural_score(text).alias("_score")).select(*kept, *[F.col(f"_score.{c}") for c in _FIELDS])


def order_column(glue: str):
    """A column function for :func:`ordered`; null stays null."""
    return text_column(lambda texts: ordered(texts, glue))


def _spans(texts: pa.Array) -> pa.Array:
    ends, cuts = [], [np.zeros(1, np.int32)]
    for part in parts(texts):
        found = [cluster_spans(t) if t is not None else [] for t in part.to_pylist()]
        cuts.append(np.cumsum([len(x) for x in found], dtype=np.int32) + cuts[-1][-1])
        ends.append(np.array([x for spans in found for x in spans], np.int32).reshape(-1, 2))
    a, b = (pa.array(x) for x in np.concatenate([np.zeros((0, 2), np.int32), *ends]).T)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(cuts)), pa.StructArray.from_arrays([a, b], ["a", "b"]), mask=texts.is_null())


def spans(text: Column) -> Column:
    """``array<struct(a, b)>``, the spans of :func:`repair.cluster_spans`; null stays null."""
    return F.arrow_udf(_spans, "array<struct<a:int,b:int>>")(text)
