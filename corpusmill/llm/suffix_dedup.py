"""Suffix-array dedup: remove every byte that a repeated string of ``LENGTH`` bytes covers.

A distributed string merge sort of sampled suffixes:

1. *Anchors.*  Of each window of ``LENGTH`` bytes the place of its least ``CORE``-byte hash is taken
   (the leftmost on a tie), a choice that depends on the window's bytes alone: equal windows have
   their anchor at the same offset.  Only suffixes at anchors are sorted, about one in 85; an anchor
   stands for the run of windows that chose it.
2. *Distinguishing prefixes.*  Anchors whose first ``CORE`` bytes occur once can't share a longer
   prefix with another and aren't exchanged.
3. *Runs.*  Each task sorts its suffixes, collapses equal contexts, front-codes the rest (length of
   the prefix shared with the one before, then the remaining bytes) and sends each key range its part.
4. *Merge.*  A loser tree merges the runs of a range.  It knows how far each contender agrees with
   the last winner: of two, the one that agrees further is smaller, and only equal ones are
   compared, from there on.  Suffixes that share ``CORE`` bytes come out as a group with their
   common prefix lengths.
5. *Groups.*  A window at offset ``o`` before its anchor is repeated if another member agrees ``o``
   bytes to the left and ``LENGTH - o`` to the right.  Members are joined by falling common prefix,
   the smaller side into the larger, and each meets its neighbours in left order: that yields every
   pair that matters in O(n log n).  A group over ``GROUP`` different contexts is not held: its
   windows are counted one by one by their digests in another exchange, and the anchors of the most
   frequent cores (at most ``HOT`` a partition) take that way from the start.

Ranges split at sampled ``CORE``-byte prefixes.  Equal contexts leave a task once, however many
copies it has, so a hot passage costs at most one entry a task and context.  Every partition is
``PARTS`` smaller ranges; Spark sorts it by them (spilling where it must) and a worker holds one at
a time.

Rows are told apart by id and text: a row is ``doc`` (its id, or a hash of its text where that is
null) and ``tag`` (another hash of the text).  Rows equal in both are the same bytes at several places, so all
their strings of ``LENGTH`` bytes are repeated, and each of the rows gets the same spans.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets, scratch
from .bytesets import U64

LENGTH = 200
CORE = 32
GROUP = 20_000
SEGMENT = 1 << 19
RUN_ENTRIES = 400_000
RUN_SUFFIXES = 40_000
SAMPLE_ONE_IN = 8
SAMPLES_PER_RANGE = 64
PARTS = 8
HOT = 4
NOBODY = -1  # the place of an entry that stands for a core or context without being a row's own


# ---- anchors


def core_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the CORE bytes from each place, by doubling."""
    h, step = bytesets.second_table()[data], 1
    while step < CORE:
        h = h[:-step] * U64(0x9FB21C651E98DF25 + 2 * step) + h[step:]
        step *= 2
    return bytesets.mix(h)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: place, first window, last window and core hash of each anchor."""
    found = []
    span = length - CORE + 1
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        piece = data[at : at + SEGMENT + length - 1]
        h = core_hashes(piece)
        least = h & ~U64((1 << 20) - 1) | np.arange(len(h), dtype=U64)
        have = 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        chosen = (least & U64((1 << 20) - 1)).astype(np.int64)
        window = np.arange(len(chosen))
        # windows that reach into the next text aren't any
        last = np.searchsorted(starts, at + window, "right") - 1
        ok = at + window + length <= ends[last]
        window, chosen, owner = window[ok], chosen[ok], last[ok]
        if len(window):
            first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(window) != 1)])
            final = np.r_[first[1:], len(window)] - 1
            found.append((at + chosen[first], at + window[first], at + window[final], h[chosen[first]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def core_hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hashes of the cores at these places only."""
    h, step = bytesets.second_table()[data[places[:, None] + np.arange(CORE)]], 1
    while step < CORE:
        h = h[:, :-step] * U64(0x9FB21C651E98DF25 + 2 * step) + h[:, step:]
        step *= 2
    return bytesets.mix(h[:, 0])


# ---- which cores repeat

LIST, SAMPLE, FREQUENT = 0, 1, 2
ANCHOR = np.dtype([("at", "<i8"), ("far", "<u2"), ("near", "<u2")])


def _ranges(key: np.ndarray, parts: int) -> np.ndarray:
    """Even ranges of mixed keys: anchors have the least hashes of their windows, so those alone would crowd the first ranges."""
    key = bytesets.mix(key)
    return ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


def _of_row(doc: np.ndarray, tag: np.ndarray, parts: int) -> np.ndarray:
    """A range for what belongs to a row, so that many rows spread over all ranges."""
    return _ranges(doc.view(U64) ^ bytesets.mix(tag.view(U64)), parts)


def _by_part(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """Columns of the rows of one range after another, from batches sorted by ``part``."""
    held, at = [], None
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            if held and part[a] != at:
                yield tuple([x for h in held for x in h.column(c).to_pylist()] for c in columns)
                held = []
            at = part[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield tuple([x for h in held for x in h.column(c).to_pylist()] for c in columns)


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows of a range together, ranges in order within partitions."""
    return df.withColumn("pid", F.expr(f"part div {PARTS}").cast("int")).repartitionById(n, F.col("pid")).sortWithinPartitions("part").drop("pid")


ALONE, SETTLED, STANDS = 0, 1, 2


def _cores(parts: int, length: int):
    """Anchors in packed runs by core hash: ``part, kind, run`` with hash, row, place, offsets and sampled cores.

    A core that a task holds twice is settled there: its anchors go on by row, and the hash goes
    once, with their number.
    """

    def emit(held, kmers):
        h, doc, tag, at, far, near = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, tag, at, far, near = (x[order] for x in (h, doc, tag, at, far, near))
        new = np.r_[True, h[1:] != h[:-1]]
        twice = ~new
        twice[:-1] |= ~new[1:]
        lead = np.flatnonzero(new & twice)
        size = np.diff(np.r_[np.flatnonzero(new), len(h)])[np.searchsorted(np.flatnonzero(new), lead)]
        none = np.zeros(len(lead), np.int64)
        cols = [np.r_[h, h[lead]], np.r_[doc, none], np.r_[tag, none], np.r_[at, size], np.r_[far, none.astype(np.uint16)], np.r_[near, none.astype(np.uint16)]]
        cols.append(np.r_[np.where(twice, SETTLED, ALONE), np.full(len(lead), STANDS)].astype(np.uint8))
        part = np.r_[np.where(twice, _of_row(doc, tag, parts), _ranges(h, parts)), _ranges(h[lead], parts)]
        order = np.lexsort((cols[0], part))
        part, cols = part[order], [c[order] for c in cols]
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[start[1:], len(part)]
        runs = [bytesets.pack(*(c[a:b] for c in cols)) for a, b in zip(start, ends, strict=True)]
        where = part[start].tolist()
        for h0, kmer in kmers.items():
            runs.append(bytesets.pack(np.array([h0], U64), np.frombuffer(kmer, np.uint8)))
            where.append(int(_ranges(np.array([h0], U64), parts)[0]))
        kinds = [LIST] * len(start) + [SAMPLE] * len(kmers)
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(kinds, pa.int32()), pa.array(runs, pa.binary())], ["part", "kind", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kmers, n = [], {}, 0
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for t in bytesets.texts(batch.column(2)):
                at, first, last, h = anchors(t.data, t.starts, t.ends, length)
                if not len(at):
                    continue
                row = bytesets.owner(t, at)
                mine = t.rows[row]
                held.append((h, docs[mine], tags[mine], at - t.starts[row], (at - first).astype(np.uint16), (at - last).astype(np.uint16)))
                for k in np.flatnonzero(h % U64(SAMPLE_ONE_IN) == 0):
                    kmers[int(h[k])] = t.data[at[k] : at[k] + CORE].tobytes()
                n += len(at)
                if n >= RUN_ENTRIES:
                    yield emit(held, kmers)
                    held, kmers, n = [], {}, 0
        if n:
            yield emit(held, kmers)

    return run


def _repeated(frequent: int):
    """Runs of hash ranges to the anchors whose core repeats, as ``kind, doc, tag, blob`` rows.

    Also the sampled cores among them, and the hash and number of each core with over ``frequent`` anchors.
    """

    def rows(kind: int, doc: np.ndarray, tag: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(doc), pa.int32()), pa.array(doc), pa.array(tag), pa.array(blobs, pa.binary())], ["kind", "doc", "tag", "blob"])

    def listed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, tag, at, far, near = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, tag, doc))
        doc, tag, at, far, near = (x[order] for x in (doc, tag, at, far, near))
        # rows equal in id and text name each place once
        new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1])]
        doc, tag, at, far, near = (x[new] for x in (doc, tag, at, far, near))
        start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        ends = np.r_[start[1:], len(doc)]
        packed = np.empty(len(at), ANCHOR)
        packed["at"], packed["far"], packed["near"] = at, far, near
        return rows(LIST, doc[start], tag[start], [packed[a:b].tobytes() for a, b in zip(start.tolist(), ends.tolist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for kinds, runs in _by_part(batches, "kind", "run"):
            lists, kmers = [], {}
            for kind, blob in zip(kinds, runs, strict=True):
                if kind == LIST:
                    lists.append(bytesets.unpack(blob))
                else:
                    h, kmer = bytesets.unpack(blob)
                    kmers[int(h[0])] = kmer.tobytes()
            if not lists:
                continue
            h, doc, tag, at, far, near, known = (np.concatenate(x) for x in zip(*lists, strict=True))
            lists.clear()
            counted = known != SETTLED
            cores, where = np.unique(h[counted], return_inverse=True)
            number = np.bincount(where, np.where(known[counted] == STANDS, at[counted], 1), len(cores)).astype(np.int64)
            again = known == SETTLED
            again[np.flatnonzero(counted)] = number[where] > 1
            again &= known != STANDS
            held.append(tuple(x[again] for x in (doc, tag, at, far, near)))
            size += len(held[-1][0])
            if size >= RUN_ENTRIES:
                yield listed(held)
                held, size = [], 0
            kept = [x for x in cores[number > 1].tolist() if x in kmers]
            if kept:
                yield rows(SAMPLE, np.array(kept, U64).view(np.int64), np.zeros(len(kept), np.int64), [kmers[x] for x in kept])
            often = number > frequent
            if often.any():
                yield rows(FREQUENT, cores[often].view(np.int64), number[often], [b""] * int(often.sum()))
        if size:
            yield listed(held)

    return run


# ---- sorted runs


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix of two strings that agree up to ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 1:
        mid = (low + high) >> 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Suffix:
    """An anchor's context: bytes from it on, bytes before it backwards, and whose it is."""

    __slots__ = ("right", "left", "far", "near", "doc", "tag", "at", "found")

    def __init__(self, right, left, far, near, doc, tag, at):
        self.right, self.left, self.far, self.near, self.doc, self.tag, self.at, self.found = right, left, far, near, doc, tag, at, None

    def same(self, other: Suffix) -> bool:
        return self.right == other.right and self.left == other.left and self.near == other.near


def front_code(run: list[Suffix]) -> bytes:
    """A sorted run in one compressed value."""
    shared, rest, before = [], [], b""
    for s in run:
        k = common(before, s.right)
        shared.append(k)
        rest.append(s.right[k:])
        before = s.right
    text = np.frombuffer(b"".join(rest) + b"".join(s.left for s in run), np.uint8)
    column = lambda values, kind: np.array(values, kind)
    return bytesets.pack(column(shared, np.uint16), column([len(x) for x in rest], np.uint16), column([len(s.left) for s in run], np.uint16), column([s.near for s in run], np.uint16), column([s.doc for s in run], np.int64), column([s.tag for s in run], np.int64), column([s.at for s in run], np.int64), text)


def decode_run(blob: bytes) -> Iterator[tuple[int, Suffix]]:
    """The run's suffixes with the length of the prefix shared with the one before."""
    shared, sizes, lefts, near, doc, tag, at, text = bytesets.unpack(blob)
    raw = text.tobytes()
    a, b, before = 0, int(sizes.sum(dtype=np.int64)), b""
    for k, size, m, n, d, g, p in zip(shared.tolist(), sizes.tolist(), lefts.tolist(), near.tolist(), doc.tolist(), tag.tolist(), at.tolist(), strict=True):
        before = before[:k] + raw[a : a + size]
        yield k, Suffix(before, raw[b : b + m], m, n, d, g, p)
        a, b = a + size, b + m


def loser_tree(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """Merge sorted runs; yields each suffix with the length of the prefix shared with the one before.

    Every contender carries how far it agrees with the last winner, so known prefixes are never
    compared again.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[Suffix | None] = [None] * width
    agree = [0] * width
    for k, run in enumerate(runs):
        first = next(run, None)
        if first:
            heads[k] = first[1]

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser of two contenders; the loser then knows how far it agrees with the winner."""
        a, b = heads[x], heads[y]
        if b is None:
            return x, y
        if a is None:
            return y, x
        if agree[x] != agree[y]:
            return (x, y) if agree[x] > agree[y] else (y, x)
        k = common(a.right, b.right, agree[x])
        first = a.right[k:] <= b.right[k:] if k == len(a.right) or k == len(b.right) else a.right[k] < b.right[k]
        win, lose = (x, y) if first else (y, x)
        agree[lose] = k
        return win, lose

    losers = [0] * width
    level = list(range(width))
    base = width
    while len(level) > 1:
        base //= 2
        above = []
        for k in range(base):
            win, lose = play(level[2 * k], level[2 * k + 1])
            losers[base + k] = lose
            above.append(win)
        level = above
    top = level[0]
    while heads[top] is not None:
        yield agree[top], heads[top]
        after = next(runs[top], None)
        heads[top], agree[top] = (after[1], after[0]) if after else (None, 0)
        node = (width + top) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1


# ---- groups


def solve(group: list[Suffix], shared: list[int], length: int = LENGTH) -> None:
    """Add to each suffix's ``found`` the offsets ``(low, high)`` of windows that another member holds.

    ``shared[i]`` is the common prefix of members ``i - 1`` and ``i``; members differ from each other.
    """

    def meet(x: Suffix, y: Suffix, right: int) -> None:
        left = common(x.left, y.left)
        low = length - right
        if low > left:
            return
        for s in (x, y):
            a, b = max(low, s.near), min(left, s.far)
            if a <= b:
                s.found.append((a, b))

    n = len(group)
    for s in group:
        if s.found is None:
            s.found = []
    if n <= 6:
        for i in range(n):
            right = 1 << 30
            for j in range(i + 1, n):
                right = min(right, shared[j])
                meet(group[i], group[j], right)
        return
    block = [[(s.left, k)] for k, s in enumerate(group)]
    lead = list(range(n))

    def find(k: int) -> int:
        while lead[k] != k:
            lead[k] = lead[lead[k]]
            k = lead[k]
        return k

    for i in sorted(range(1, n), key=lambda k: -shared[k]):
        a, b = find(i - 1), find(i)
        if len(block[a]) < len(block[b]):
            a, b = b, a
        large, right = block[a], shared[i]
        for item in block[b]:
            at = bisect_left(large, item)
            if at:
                meet(group[item[1]], group[large[at - 1][1]], right)
            if at < len(large):
                meet(group[item[1]], group[large[at][1]], right)
            large.insert(at, item)
        block[b] = []
        lead[b] = a


# ---- the exchange

RUN, WINDOWS, DIGESTS = 0, 1, 2
ROWS = "part int, kind int, doc long, tag long, blob binary"


def _rows(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "kind", "doc", "tag", "blob"])


def _window_rows(found: dict[tuple[int, int], list], parts: int) -> list[tuple[int, int, int, int, bytes]]:
    """First and last window of each repeated range, by row."""
    if not found:
        return []
    keys = np.array(list(found), np.int64)
    where = _of_row(keys[:, 0].copy(), keys[:, 1].copy(), parts).tolist()
    return [(p, WINDOWS, doc, tag, np.array([x for r in sorted(ranges) for x in r], "<i8").tobytes()) for p, ((doc, tag), ranges) in zip(where, found.items(), strict=True)]


def _digest_rows(group: list[Suffix], parts: int, length: int) -> list[tuple[int, int, int, int, bytes]]:
    """The digest of every window of some contexts, in ranges of digests."""
    digests, doc, tag, at = [], [], [], []
    for s in group:
        for o in range(s.near, s.far + 1):
            digests.append(hashlib.blake2b(s.left[:o][::-1] + s.right[: length - o], digest_size=16).digest())
            # a context that a task held twice is settled, and so is each equal to it
            doc.append(s.doc)
            tag.append(s.tag)
            at.append(s.at - o if s.at >= 0 else NOBODY)
    if not digests:
        return []
    key = np.frombuffer(b"".join(digests), U64).reshape(-1, 2)
    part = _ranges(key[:, 0], parts)
    order = np.argsort(part, kind="stable")
    cols = [key[order, 0], key[order, 1], *(np.array(c, np.int64)[order] for c in (doc, tag, at))]
    start = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    ends = np.r_[start[1:], len(order)]
    return [(int(part[order[a]]), DIGESTS, 0, 0, bytesets.pack(*(c[a:b] for c in cols))) for a, b in zip(start, ends, strict=True)]


def _sorted_runs(splitters: list[bytes], hot: np.ndarray, parts: int, length: int):
    """Rows ``doc, tag, text, lists`` to front-coded runs, settled windows, and digests at hot cores."""
    cuts = np.array(splitters, f"S{CORE}") if splitters else np.zeros(0, f"S{CORE}")

    def emit(held: list[Suffix]) -> list[tuple[int, int, int, int, bytes]]:
        held.sort(key=lambda s: (s.right, s.left))
        found: dict[tuple[int, int], list] = {}
        runs: dict[int, list[Suffix]] = {}
        frequent: list[Suffix] = []
        where = np.searchsorted(cuts, np.array([s.right[:CORE] for s in held], f"S{CORE}"), "right").tolist()
        i = 0
        while i < len(held):
            j = i + 1
            while j < len(held) and held[i].same(held[j]):
                j += 1
            lead = held[i]
            if j > i + 1:
                for s in held[i:j]:
                    found.setdefault((s.doc, s.tag), []).append((s.at - s.far, s.at - s.near))
                lead = Suffix(lead.right, lead.left, lead.far, lead.near, 0, 0, NOBODY)
                lead.found = held[i].found
            if lead.found is HOT_CORE:
                lead.found = None
                frequent.append(lead)
            else:
                runs.setdefault(where[i], []).append(lead)
            i = j
        rows = [(part, RUN, 0, 0, front_code(run)) for part, run in runs.items()]
        return rows + _window_rows(found, parts) + _digest_rows(frequent, parts, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Suffix] = []
        for batch in bytesets.slices(batches):
            for doc, tag, text, lists in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "text", "lists")), strict=True):
                text = text.encode()
                # a place comes in two lists if it was settled in one task and not in another
                for p, (f, m, often) in _places(lists, text, hot).items():
                    held.append(Suffix(text[p : p - m + length], text[p - f : p][::-1], f, m, doc, tag, p))
                    if often:
                        held[-1].found = HOT_CORE
                if len(held) >= RUN_SUFFIXES:
                    yield _rows(emit(held))
                    held = []
        if held:
            yield _rows(emit(held))

    return run


HOT_CORE: list = []


def _places(lists: list[bytes], text: bytes, hot: np.ndarray) -> dict[int, tuple[int, int, bool]]:
    """Each anchor's place with its offsets and whether its core is a hot one."""
    found = np.frombuffer(b"".join(lists), ANCHOR)
    often = np.isin(core_hashes_at(np.frombuffer(text, np.uint8), found["at"]), hot).tolist() if len(hot) else [False] * len(found)
    return dict(zip(found["at"].tolist(), zip(found["far"].tolist(), found["near"].tolist(), often, strict=True), strict=True))


def _merge(parts: int, length: int, limit: int):
    """The runs of key ranges to repeated windows; windows of overfull groups to digests."""

    def passing(batches: Iterator[pa.RecordBatch], through: list) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("kind").to_numpy() == RUN
            if not mine.all():
                through.append(batch.filter(pa.array(~mine)))
                batch = batch.filter(pa.array(mine))
            yield batch

    def merge(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        group: list[Suffix] = []
        shared: list[int] = []
        overfull = False

        def digest_rows() -> list:
            for s in group:
                if s.found:
                    settle(s)
            return _digest_rows(group, parts, length)

        def settle(s: Suffix) -> None:
            if s.at >= 0:
                found.setdefault((s.doc, s.tag), []).extend((s.at - b, s.at - a) for a, b in s.found)

        def close() -> list:
            if overfull:
                return digest_rows()
            if len(group) > 1:
                solve(group, shared, length)
            for s in group:
                if s.found:
                    settle(s)
            return []

        same_right: dict[tuple[bytes, int], Suffix] = {}
        for k, s in loser_tree([decode_run(b) for b in blobs]):
            if k < CORE:
                if rows := close():
                    yield _rows(rows)
                group, shared, overfull, same_right = [], [], False, {}
            if not group or s.right != group[-1].right:
                same_right = {}
            twin = same_right.get((s.left, s.near))
            if twin is None:
                same_right[s.left, s.near] = s
                shared.append(k)
                group.append(s)
            else:
                whole = [(s.near, s.far)]
                twin.found, s.found = whole, whole
                settle(s)
            if len(group) > limit:
                overfull = True
                if rows := digest_rows():
                    yield _rows(rows)
                last = group[-1]
                group, shared = [], []
                same_right = {key: x for key, x in same_right.items() if x is not last and x.right == last.right}
                same_right[last.left, last.near] = last
        if rows := close():
            yield _rows(rows)
        if rows := _window_rows(found, parts):
            yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through: list[pa.RecordBatch] = []
        for (blobs,) in _by_part(passing(batches, through), "blob"):
            yield from through
            through.clear()
            yield from merge(blobs)
        yield from through

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests that come twice to repeated windows; windows pass."""
    for kinds, docs, tags, blobs in _by_part(batches, "kind", "doc", "tag", "blob"):
        windows = [(0, WINDOWS, d, g, x) for k, d, g, x in zip(kinds, docs, tags, blobs, strict=True) if k == WINDOWS]
        if windows:
            yield _rows(windows)
        lists = [bytesets.unpack(x) for k, x in zip(kinds, blobs, strict=True) if k == DIGESTS]
        if lists:
            a, b, doc, tag, at = (np.concatenate(x) for x in zip(*lists, strict=True))
            order = np.lexsort((b, a))
            a, b, doc, tag, at = (x[order] for x in (a, b, doc, tag, at))
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            twice = (np.r_[False, same] | np.r_[same, False]) & (at >= 0)
            found: dict[tuple[int, int], list] = {}
            for d, g, p in zip(doc[twice].tolist(), tag[twice].tolist(), at[twice].tolist(), strict=True):
                found.setdefault((d, g), []).append((p, p))
            if found:
                yield _rows(_window_rows(found, 1))


def _spans(blobs: list[bytes] | None, length: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges of a row."""
    if not blobs:
        return []
    r = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
    r = r[np.argsort(r[:, 0], kind="stable")]
    end = np.maximum.accumulate(r[:, 1] + length)
    new = np.r_[True, r[1:, 0] > end[:-1]]
    return list(zip(r[new, 0].tolist(), end[np.r_[np.flatnonzero(new)[1:] - 1, len(r) - 1]].tolist(), strict=True))


def repeated_spans(docs: DataFrame, make, schema: str, length: int = LENGTH, limit: int = GROUP) -> DataFrame:
    """Apply ``make(ids, texts, spans)`` (Arrow columns and lists) to all rows with their repeated spans.

    The texts are exchanged once, by id and text hash; sorting and applying read the same exchange.
    A null text is empty.  Every row is a document of its own: rows that share an id, null included,
    get the spans of their own text, and rows equal in id and text repeat each other.
    """
    spark = docs.sparkSession
    n = scratch.width(spark)
    parts = n * PARTS
    text = F.coalesce("text", F.lit(""))
    doc, tag = F.coalesce("doc_id", F.xxhash64(text, F.lit("row"))).alias("doc"), F.xxhash64(text).alias("tag")
    cores = docs.select(doc, tag, "text").mapInArrow(_cores(parts, length), "part int, kind int, run binary")
    lists = scratch.save(_dealt(cores, n).mapInArrow(_repeated(limit), "kind int, doc long, tag long, blob binary"), "suffix-anchors")
    sample = lists.where(F.col("kind") == SAMPLE).orderBy("doc").limit(n * SAMPLES_PER_RANGE).select("blob").collect()
    found = sorted(bytes(r["blob"]) for r in sample)
    splitters = sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []
    often = lists.where(F.col("kind") == FREQUENT).orderBy(F.desc("tag"), "doc").limit(n * HOT).select("doc").collect()
    hot = np.array(sorted(r["doc"] for r in often), np.int64).view(U64)
    texts = docs.select("doc_id", doc, tag, text.alias("text"))  # the same columns in both joins, so that one exchange serves them
    own = (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    row = F.col("doc").alias("_doc"), F.col("tag").alias("_tag")
    per_row = lists.where(F.col("kind") == LIST).groupBy(*row).agg(F.collect_list("blob").alias("lists"))
    both = texts.join(per_row.hint("shuffle_hash"), own).select("doc_id", "doc", "tag", "text", "lists")
    runs = both.mapInArrow(_sorted_runs(splitters, hot, parts, length), ROWS)
    merged = _dealt(runs, n).mapInArrow(_merge(parts, length, limit), ROWS)
    counted = _dealt(merged, n).mapInArrow(_count, ROWS)
    windows = counted.groupBy(*row).agg(F.collect_list("blob").alias("windows"))
    rows = texts.join(windows.hint("shuffle_hash"), own, "left").select("doc_id", "text", "windows")

    def apply(batches):
        for batch in bytesets.slices(batches):
            yield make(batch.column(0), batch.column(1), [_spans(w, length) for w in batch.column(2).to_pylist()])

    return rows.mapInArrow(apply, schema)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, text, removed``: the remaining text (cut characters become U+FFFD) and the removed byte ranges."""

    def make(ids, texts, spans):
        left = [cut(t.encode(), s).decode("utf-8", "replace") for t, s in zip(texts.to_pylist(), spans, strict=True)]
        removed = [[{"start": a, "end": b} for a, b in s] for s in spans]
        return pa.RecordBatch.from_arrays([ids, pa.array(left, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "text", "removed"])

    return repeated_spans(docs, make, "doc_id long, text string, removed array<struct<start:long,end:long>>", length)


def digests(docs: DataFrame, length: int = LENGTH, limit: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; a null text is empty."""

    def make(ids, texts, spans):
        rows = []
        for t, s in zip(texts.to_pylist(), spans, strict=True):
            raw = t.encode()
            rows.append((len(raw), sum(b - a for a, b in s), len(s), hashlib.sha256(cut(raw, s)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(docs, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, limit)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
