"""Substring dedup by recompression: remove every word that a repeated window of ``LENGTH`` words covers,
but for the window's first occurrence.

1. *Rounds.*  A text is a row of symbols, at first its words.  A run round names maximal runs of one symbol, a
   pair round names neighbours ``a b`` with ``a`` on the left and ``b`` on the right side of a halving of all
   symbols that changes from round to round.  A name is a digest of what it names, so it is the same
   everywhere and a round needs no exchange.
2. *Interior symbols.*  Every symbol knows the range of words that its being there depends on: a pair on its halves, a run
   and a symbol that found no partner also on their neighbours, and the ends of a text on what no window
   sees.  A symbol whose range lies within a window is therefore in every equal window, at the same place.
3. *Choice.*  Each window takes, of the symbols within it, one of the last round that has any (of these, that of
   the least digest).  Equal windows take equal symbols, so windows meet by the symbol's name: neighbouring
   windows that took the same one go on as one entry, with the name and the windows' digests.
4. *Verification.*  Of the windows of a name with the same digest (64 bits each, of the words and of the name) all
   but the first, by document and place, are repeated.

Tasks settle first what they can alone: of a window that a task holds more than once, one goes on, so a
hot passage costs at most an entry a task.  What is left of a hot name is the different windows around it;
names that are frequent in a fixed share of the rows (a list of at most ``HOT`` a partition) are
dealt by name *and* digest.  Repeated windows go back to their rows packed by ranges of rows.  Every partition is smaller ranges, held one at a time, and long
texts are handled in pieces, since a symbol within a window doesn't depend on what is outside.

Rows are told apart by id and text hash.  A null id comes before all others; rows that share an id are in the order of their text
hashes; rows equal in both are one document, which each of them shows.  Null texts and texts of fewer words
lose nothing; other columns aren't read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets, scratch
from .bytesets import U64, mix
from .suffix_dedup import _by_part, _dealt, _of_row, _ranges, _spans
from .suffix_dedup import PARTS as _PARTS

LENGTH = 20
#: Symbols of up to eight words and longer runs: more rounds make names rarer, but fewer windows take the same symbol.
ROUNDS = ("pair", "run", "pair", "pair")
SEGMENT = 1 << 17
BUFFER = 1 << 20
NO_ID = -(2**63)
HOT = 4
HOT_ONE_IN = 64
HOT_LEAST = 64
FAR = 1 << 40

ENTRIES, SETTLED = 0, 1
ROWS = "part int, kind int, doc long, tag long, blob binary"


# ---- rounds


def _joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(a + U64(salt)) * U64(0x9FB21C651E98DF25) + b)


def _pairs(sym, lo, hi, near, k):
    """One pair round: symbols, ranges and neighbourhood after it, and which of them are new."""
    left = (mix(sym ^ U64(0x51ED270B0A1F39C1 * (k + 1) & (1 << 64) - 1)) & U64(1)) == 0
    met = np.zeros(len(sym), bool)
    met[:-1] = left[:-1] & ~left[1:] & near[:-1]
    second = np.r_[False, met[:-1]]
    # a symbol alone saw its neighbour on the side where a partner could be; for a pair that is the other half
    other = np.clip(np.arange(len(sym)) + np.where(left, 1, -1), 0, max(0, len(sym) - 1))
    seen = np.where(left, near, np.r_[False, near[:-1]])
    low = np.where(seen, np.minimum(lo, lo[other]), np.where(left, lo, -FAR))
    high = np.where(seen, np.maximum(hi, hi[other]), np.where(left, FAR, hi))
    name = sym.copy()
    at = np.flatnonzero(met)
    name[at] = _joined(sym[at], sym[at + 1], k)
    stay = ~second
    last = np.flatnonzero(stay) + met[stay]
    return name[stay], low[stay], high[stay], near[last], met[stay]


def _runs(sym, lo, hi, near, k):
    """One run round, likewise; every symbol saw both neighbours."""
    same = np.r_[False, (sym[1:] == sym[:-1]) & near[:-1]]
    start = np.flatnonzero(~same)
    end = np.r_[start[1:], len(sym)] - 1
    low, high = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
    before, after = np.maximum(start - 1, 0), np.minimum(end + 1, len(sym) - 1)
    has_before, has_after = near[before] & (start > 0), near[end]
    low = np.where(has_before, np.minimum(low, lo[before]), -FAR)
    high = np.where(has_after, np.maximum(high, hi[after]), FAR)
    low = np.where(has_after, np.minimum(low, lo[after]), low)
    high = np.where(has_before, np.maximum(high, hi[before]), high)
    size = end - start + 1
    name = np.where(size > 1, _joined(sym[start], size.astype(U64), k + 100), sym[start])
    return name, low, high, near[end], size > 1


def symbols(names: np.ndarray, near: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names and ranges of the new symbols of each round that fit a window.

    ``near[i]`` says whether word ``i + 1`` is the next of the same text (false for the last).  What can't be within a window is left
    out of later rounds: what depends on it can't either.
    """
    sym, lo, near = names, np.arange(len(names)), near.copy()
    hi, found = lo + 1, []
    for k, kind in enumerate(ROUNDS):
        if not len(sym):
            break
        sym, lo, hi, near, new = (_pairs if kind == "pair" else _runs)(sym, lo, hi, near, k)
        fits = hi - lo <= length
        made = new & fits
        found.append((sym[made], lo[made], hi[made]))
        near[:-1] &= fits[1:]
        sym, lo, hi, near = sym[fits], lo[fits], hi[fits], near[fits]
        if len(near):
            near[-1] = False
    return found


def chosen(names: np.ndarray, near: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (their first words), the number of the symbol that each took, and the names by number."""
    n = len(names)
    after = np.r_[0, np.cumsum(~near)]
    window = np.arange(max(0, n - length + 1))
    free = np.zeros(n, bool)
    free[window] = after[window + length - 1] == after[window]
    windows = np.flatnonzero(free)
    took = np.full(n, -1, np.int64)
    known, base = [], 0
    for sym, lo, hi in reversed(symbols(names, near, length)):
        rank = mix(sym ^ U64(0xA0761D6478BD642F))
        order = np.lexsort((-lo, rank))[::-1]  # the least digest last, so that it stays; of equal ones the leftmost
        sym, first, wide = sym[order], hi[order] - length, length - (hi[order] - lo[order]) + 1
        at = np.repeat(first - np.r_[0, np.cumsum(wide)[:-1]], wide) + np.arange(int(wide.sum()))
        which = np.repeat(np.arange(len(sym)), wide)
        ok = (at >= 0) & (at < n)
        at, which = at[ok], which[ok]
        ok = free[at]
        at, which = at[ok], which[ok]
        took[at] = base + which
        free[at] = False
        known.append(sym)
        base += len(sym)
    rest = np.flatnonzero(free)
    if len(rest):
        rank = mix(names ^ U64(0xA0761D6478BD642F))
        best = rest.copy()
        for k in range(1, length):
            best = np.where(rank[rest + k] < rank[best], rest + k, best)
        took[rest] = base + best
    known.append(names)
    return windows, took[windows], np.concatenate(known)


def window_digests(names: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A 64-bit digest of the ``length`` names from each place, by doubling."""
    level, step, out, done = mix(names), 1, None, 0
    while True:
        if length & step:
            if out is None:
                out = level
            else:
                m = len(level) - done
                out = _joined(out[: max(0, m)], level[done:], 7)
            done += step
        if done == length:
            return out[: max(0, len(names) - length + 1)]
        level = _joined(level[:-step], level[step:], 5) if len(level) > step else level[:0]
        step *= 2


# ---- entries


def entries(t: bytesets.Texts, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """By pieces: row, first window in the text, name and number of windows of each entry, and all their digests."""
    s, e, row = bytesets.words(t)
    names = bytesets.span_hashes(t.data, s, e)
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
    for at in range(0, max(0, len(names) - length + 1), SEGMENT):
        stop = at + SEGMENT + length - 1
        piece, mine = names[at:stop], row[at:stop]
        near = np.r_[mine[1:] == mine[:-1], False]
        window, took, known = chosen(piece, near, length)
        if len(window):
            first = np.flatnonzero(np.r_[True, (took[1:] != took[:-1]) | (np.diff(window) != 1)])
            size = np.diff(np.r_[first, len(window)])
            yield mine[window[first]], place[at + window[first]], known[took[first]], size, window_digests(piece, length)[window]


def _expanded(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each value and its successors: of ``a, b`` with sizes 2, 3 these are ``a, a + 1, b, b + 1, b + 2``."""
    return np.repeat(values - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))


def _first_of(name: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Of windows in their order: for each the index of the first one of its name and digest."""
    order = np.argsort(digest, kind="stable")
    same = digest[order][1:] == digest[order][:-1]
    alike = name[order][1:] == name[order][:-1]
    if (same & ~alike).any():
        order = np.lexsort((name, digest))
        same, alike = digest[order][1:] == digest[order][:-1], name[order][1:] == name[order][:-1]
    start = np.flatnonzero(np.r_[True, ~(same & alike)])
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[start], np.diff(np.r_[start, len(order)]))
    return first


def _settled_rows(doc, tag, at, parts: int) -> pa.RecordBatch | None:
    """Rows of covered windows, one a document, as ``(first, last)`` pairs; input sorted by document and place."""
    if not len(doc):
        return None
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
    cut = np.flatnonzero(new | np.r_[True, np.diff(at) != 1])
    ranges = np.stack([at[cut], at[np.r_[cut[1:], len(at)] - 1]], axis=1).astype("<i8")
    start = np.flatnonzero(new)
    edge = np.searchsorted(cut, np.r_[start, len(at)])
    blobs = [ranges[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    doc, tag = doc[start], tag[start]
    return pa.RecordBatch.from_arrays([pa.array(_of_row(doc, tag, parts)), pa.array([SETTLED] * len(doc), pa.int32()), pa.array(doc), pa.array(tag), pa.array(blobs, pa.binary())], [c.split()[0] for c in ROWS.split(", ")])


def _task(held: list[tuple[np.ndarray, ...]], parts: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Settle the windows of a buffer and send the rest."""
    doc, tag, at, name, size = (np.concatenate([h[k] for h in held]) for k in range(5))
    digest = np.concatenate([h[5] for h in held])
    start = np.r_[0, np.cumsum(size)[:-1]]
    order = np.lexsort((at, tag, doc))
    digest = digest[_expanded(start[order], size[order])]
    doc, tag, at, name, size = (x[order] for x in (doc, tag, at, name, size))
    place, entry = _expanded(at, size), np.repeat(np.arange(len(size)), size)
    first = _first_of(name[entry], digest)
    lead = first == np.arange(len(first))
    other = np.flatnonzero(~lead)
    there = first[other]
    # a row equal to another in id and text holds the same window at the same place: that isn't another one
    other = other[(doc[entry[other]] != doc[entry[there]]) | (tag[entry[other]] != tag[entry[there]]) | (place[other] != place[there])]
    if (rows := _settled_rows(doc[entry[other]], tag[entry[other]], place[other], parts)) is not None:
        yield rows
    entry, place, digest = entry[lead], place[lead], digest[lead]
    alone = np.isin(name, hot)[entry]
    cut = np.flatnonzero(np.r_[True, (np.diff(entry) != 0) | (np.diff(place) != 1) | alone[1:]])
    size = np.diff(np.r_[cut, len(entry)])
    mine = entry[cut]
    part = _ranges(np.where(alone[cut], mix(name[mine]) ^ digest[cut], name[mine]), parts)
    order = np.argsort(part, kind="stable")
    part, mine, cut, size = part[order], mine[order], cut[order], size[order]
    digest = digest[_expanded(cut, size)]
    begin = np.r_[0, np.cumsum(size)]
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    where, blobs = [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        m = mine[a:b]
        where.append(int(part[a]))
        blobs.append(bytesets.pack(doc[m], tag[m], place[cut[a:b]].astype(np.int32), name[m], size[a:b].astype(np.uint8), digest[begin[a] : begin[b]]))
    none = np.zeros(len(where), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(none.astype(np.int32)), pa.array(none), pa.array(none), pa.array(blobs, pa.binary())], [c.split()[0] for c in ROWS.split(", ")])


def _read(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``doc, tag, at, name, size, digests`` of the entries of each run of texts."""
    for batch in batches:
        docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for t in bytesets.texts(batch.column(2)):
            for row, at, name, size, digest in entries(t, length):
                yield docs[t.rows[row]], tags[t.rows[row]], at, name, size, digest


def _sent(parts: int, hot: np.ndarray, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in _read(batches, length):
            held.append(found)
            n += len(found[5])
            if n >= BUFFER:
                yield from _task(held, parts, hot)
                held, n = [], 0
        if held:
            yield from _task(held, parts, hot)

    return run


def _names(length: int):
    """``name, n``: entries of each name in a part of the rows, counted batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, name, _, _ in _read(batches, length):
            names, n = np.unique(name, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])

    return run


def _verified(parts: int):
    """Entries of names to the windows that aren't the first of theirs, and windows that pass, packed by ranges of rows."""

    def flush(held):
        doc, tag, first, last = (np.concatenate(x) for x in zip(*held, strict=True))
        part = _of_row(doc, tag, parts)
        order = np.lexsort((first, tag, doc, part))
        part, cols = part[order], [x[order] for x in (doc, tag, first, last)]
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        blobs = [bytesets.pack(*(c[a:b] for c in cols)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for kinds, docs, tags, blobs in _by_part(batches, "kind", "doc", "tag", "blob"):
            passing = [(d, g, np.frombuffer(b, "<i8").reshape(-1, 2)) for k, d, g, b in zip(kinds, docs, tags, blobs, strict=True) if k == SETTLED]
            if passing:
                sizes = [len(r) for _, _, r in passing]
                ranges = np.concatenate([r for _, _, r in passing])
                held.append((np.repeat(np.array([d for d, _, _ in passing], np.int64), sizes), np.repeat(np.array([g for _, g, _ in passing], np.int64), sizes), ranges[:, 0], ranges[:, 1]))
                n += len(ranges)
            lists = [bytesets.unpack(b) for b, kind in zip(blobs, kinds, strict=True) if kind == ENTRIES]
            if lists:
                doc, tag, at, name, size, digest = (np.concatenate(x) for x in zip(*lists, strict=True))
                lists.clear()
                size = size.astype(np.int64)
                start = np.r_[0, np.cumsum(size)[:-1]]
                order = np.lexsort((at, tag, doc))
                digest = digest[_expanded(start[order], size[order])]
                doc, tag, at, name, size = (x[order] for x in (doc, tag, at.astype(np.int64), name, size))
                place, entry = _expanded(at, size), np.repeat(np.arange(len(size)), size)
                first = _first_of(name[entry], digest)
                here = np.flatnonzero((doc[entry] != doc[entry[first]]) | (tag[entry] != tag[entry[first]]) | (place != place[first]))
                if len(here):
                    cut = np.flatnonzero(np.r_[True, (np.diff(entry[here]) != 0) | (np.diff(place[here]) != 1)])
                    mine = entry[here[cut]]
                    held.append((doc[mine], tag[mine], place[here[cut]], place[here[np.r_[cut[1:], len(here)] - 1]]))
                    n += len(cut)
            if n >= BUFFER:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_doc, _tag, windows``: all ranges of repeated windows of each row."""
    for (blobs,) in _by_part(batches, "blob"):
        doc, tag, first, last = (np.concatenate(x) for x in zip(*map(bytesets.unpack, blobs), strict=True))
        order = np.lexsort((first, tag, doc))
        doc, tag, ranges = doc[order], tag[order], np.stack([first[order], last[order]], axis=1).astype("<i8")
        edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), True])
        windows = [ranges[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[edge[:-1]]), pa.array(tag[edge[:-1]]), pa.array(windows, pa.binary())], ["_doc", "_tag", "windows"])


def _frequent(keyed: DataFrame, n: int, length: int) -> np.ndarray:
    """Names with most entries in one of ``HOT_ONE_IN`` rows by hash, at most ``HOT`` a partition; they only decide how entries are dealt."""
    part = keyed.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(HOT_ONE_IN)) == 0)
    counts = part.mapInArrow(_names(length), "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "name").limit(n * HOT).select("name").collect()
    return np.array([r["name"] for r in found], np.int64).view(U64)


def repeated_words(docs: DataFrame, make, schema: str, length: int = LENGTH) -> DataFrame:
    """Apply ``make(ids, texts, spans)`` (Arrow columns and lists of word ranges) to all rows; the texts are exchanged once."""
    n = scratch.width(docs.sparkSession)
    parts = n * _PARTS
    text = F.coalesce("text", F.lit(""))
    doc, tag = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag")
    keyed = docs.select(doc, tag, "text")
    sent = keyed.mapInArrow(_sent(parts, _frequent(keyed, n, length), length), ROWS)
    found = _dealt(sent, n).mapInArrow(_verified(parts), "part int, blob binary")
    windows = _dealt(found, n).mapInArrow(_gathered, "_doc long, _tag long, windows binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc, tag, text.alias("text"))
    rows = texts.join(windows.hint("shuffle_hash"), (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", "text", "windows")

    def apply(batches):
        for batch in bytesets.slices(batches):
            yield make(batch.column(0), batch.column(1), [_spans(w and [w], length) for w in batch.column(2).to_pylist()])

    return rows.mapInArrow(apply, schema)


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """The words outside the spans, joined by one space."""
    if not spans:
        return b" ".join(words)
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return b" ".join(out + words[at:])


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, text, removed``: the kept words joined by one space and the ranges of removed words."""

    def make(ids, texts, spans):
        left = [kept_words(t.encode().split(), s).decode() for t, s in zip(texts.to_pylist(), spans, strict=True)]
        removed = [[{"start": a, "end": b} for a, b in s] for s in spans]
        return pa.RecordBatch.from_arrays([ids, pa.array(left, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "text", "removed"])

    return repeated_words(docs, make, "doc_id long, text string, removed array<struct<start:long,end:long>>", length)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""

    def make(ids, texts, spans):
        rows = []
        for t, s in zip(texts.to_pylist(), spans, strict=True):
            words = t.encode().split()  # bytes split at \x20 and \x09-\x0D
            rows.append((len(words), sum(b - a for a, b in s), hashlib.sha256(kept_words(words, s)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated_words(docs, make, "doc_id long, n_words long, n_removed long, kept_sha256 string", length)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
