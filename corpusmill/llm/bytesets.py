"""Vectorised text scanning over Arrow batches: bytes, words, lines and their hashes.

All hashes are functions of the bytes alone, so equal strings agree on every machine and in every
run.  Short strings (words, mostly) get 64 bits from a table of 256 random words and a polynomial in
wrapping arithmetic; that is weak against long structured strings, so strings over ``SHORT`` bytes
get xxh3.  Keys that decide alone, such as those of lines, are 128-bit digests (:func:`span_digests`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 19
SHORT = 64
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=U64) | U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Texts:
    """Whole texts laid end to end: ``data[starts[i]:ends[i]]`` is row ``i``."""

    rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def texts(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[Texts]:
    """Runs of whole texts of about ``limit`` bytes (a longer text is alone); null counts as empty."""
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(array):
            continue
        array = array.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = array.buffers()
        offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(array):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield Texts(np.arange(i, j), raw[offs[i] : offs[j]], offs[i:j] - offs[i], offs[i + 1 : j + 1] - offs[i])
            i = j


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small parts of batches: few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 2**64)
        both = []
        for base in (_BASE, inverse):
            p = np.full(m, U64(base))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if m > 4 * CHUNK:
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest (xxh3) of each ``data[start:end]``."""
    raw = data.tobytes()
    found = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    both = np.frombuffer(found, U64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def second_table() -> np.ndarray:
    """Another byte table, for hashes that must not depend on those of words."""
    return mix(_TABLE ^ U64(0xA5A5A5A5A5A5A5A5)) | U64(1)


def runs(inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes, cut where one text meets the next."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prev = np.empty(len(inside), bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    prev[starts[starts < len(inside)]] = False
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = ends[ends > starts] - 1
    after[last] = False
    return np.flatnonzero(inside & ~prev), np.flatnonzero(inside & ~after) + 1


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row number (within the run) of each maximal run of non-space bytes."""
    s, e = runs(~SPACE[t.data], t.starts, t.ends)
    return s, e, owner(t, s)


def owner(t: Texts, positions: np.ndarray) -> np.ndarray:
    """Which text holds each position."""
    filled = np.flatnonzero(t.ends > t.starts)
    return filled[np.searchsorted(t.starts[filled], positions, "right") - 1] if len(filled) else np.zeros(0, np.int64)


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row number of each line; an empty text is one empty line."""
    cuts = np.flatnonzero(t.data == 10)
    starts = np.concatenate([t.starts, cuts + 1])
    rows = np.concatenate([np.arange(len(t.starts)), owner(t, cuts)])
    ends = np.concatenate([cuts, t.ends])
    tail = np.concatenate([owner(t, cuts), np.arange(len(t.starts))])
    a, b = np.lexsort((starts, rows)), np.lexsort((ends, tail))
    return starts[a], ends[b], rows[a]


def code_points(data: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte; has one more entry than ``data``."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value."""
    head = [f"{a.dtype.str}:{len(a)}" for a in arrays]
    return zlib.compress(",".join(head).encode() + b"\n" + b"".join(a.tobytes() for a in arrays), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    at = raw.index(b"\n")
    out, start = [], at + 1
    for part in raw[:at].decode().split(","):
        kind, n = part.split(":")
        out.append(np.frombuffer(raw, kind, int(n), start))
        start += int(n) * np.dtype(kind).itemsize
    return out
