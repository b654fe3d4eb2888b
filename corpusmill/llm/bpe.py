"""BPE encoding and decoding: merge rounds in numpy over many words at once.

The distinct words of a run of texts lie as symbols in one flat array.  In each round every
neighbouring pair inside a word is looked up by binary search in the sorted pair keys of the
merge table; each word applies its lowest-rank pair, at all its places from the left, until no
word has a pair left.  Words over ``LONG`` bytes (texts in scripts without spaces are such words) keep their
symbols in a linked list instead and their places in a queue by rank: a round takes the places of the lowest
rank of all, and only pairs beside them are looked up anew.  That applies the same merges, as a token that exists
by one merge alone is in pairs of later ranks only.  Words seen before are taken from a table of bounded bytes.

The vocabulary is read from a tokenizer file given by path; it is not part of the library.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import bytesets

# Fixed value: white space by Unicode's White_Space property.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The word pattern of byte-level BPE, with white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
KNOWN_BYTES = 32 << 20
KNOWN_ENTRY = 200  # about what a table entry takes beside its bytes
LONG = 512
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files: itself, or the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: Whether some token comes from two merges: then a merge may make a pair of lower rank, and places go one by one.
        self.twofold = len(np.unique(self.merged)) < len(self.merged)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each symbol, NONE where there is none."""
        rank = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            inside = np.flatnonzero(word[:-1] == word[1:])
            pair = symbols[inside] << 32 | symbols[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = self.keys[at] == pair
            rank[inside[hit]] = self.ranks[at[hit]]
        return rank

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Token ids of one word, in about the time of its merges."""
        n = len(word)
        symbols = self.first[np.frombuffer(word, np.uint8)]
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank = np.full(n, NONE)  # of the pair that starts at each place
        rank[:-1] = self._pair_ranks(symbols[:-1], symbols[1:])
        queue: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enqueue(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            of = rank[places]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            for r, some in zip(of[start].tolist(), np.split(places, start[1:]), strict=bool(len(of))):
                if r not in queue:
                    heappush(heap, r)
                queue.setdefault(r, []).append(some)

        enqueue(np.arange(n - 1))
        while heap:
            lowest = heappop(heap)
            places = np.unique(np.concatenate(queue.pop(lowest)))
            places = places[rank[places] == lowest]
            if not len(places):
                continue
            # of overlapping places (a run of one symbol) every second one counts, from the left
            order = np.arange(len(places))
            start = np.maximum.accumulate(np.where(np.r_[True, after[places[:-1]] != places[1:]], order, 0))
            left = places[(order - start) % 2 == 0]
            if self.twofold:
                left = left[:1]
            gone = after[left]
            symbols[left], rank[gone], alive[gone], after[left] = self.merged[lowest], NONE, False, after[gone]
            inner = left[after[left] < n]
            before[after[inner]] = inner
            near = np.unique(np.r_[left, before[left][before[left] >= 0]])
            rank[near] = NONE
            some = near[after[near] < n]
            rank[some] = self._pair_ranks(symbols[some], symbols[after[some]])
            enqueue(np.r_[near, places] if self.twofold else near)
        return symbols[alive].astype(np.uint32)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        if any(len(w) > LONG for w in words):
            short = iter(self.merge([w for w in words if len(w) <= LONG]))
            return [self.merge_long(w) if len(w) > LONG else next(short) for w in words]
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        while len(symbols):
            rank = self._ranks(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(word)])
            over = np.repeat(best == NONE, length)
            done_ids.append(symbols[over])
            done_word.append(word[over])
            symbols, word, rank = symbols[~over], word[~over], rank[~over]
            if not len(symbols):
                break
            hit = rank == np.repeat(best[best != NONE], length[best != NONE])
            # of overlapping hits (a run of one symbol) every second one counts, from the left
            places = np.flatnonzero(hit)
            begins = np.r_[True, np.diff(places) != 1]
            run = np.cumsum(begins) - 1
            places = places[(places - places[np.flatnonzero(begins)][run]) % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids, of = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(of, kind="stable")
        return np.split(ids[order].astype(np.uint32), np.searchsorted(of[order], np.arange(1, len(words))))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; special tokens spelled out in a text are recognised."""
        parts: list[list[str | int]] = []
        for text in texts:
            if self.cut and self.cut.search(text):
                found, at = [], 0
                for m in self.cut.finditer(text):
                    found += [*self.pattern.findall(text, at, m.start()), self.special[m[0]]] if m.start() > at else [self.special[m[0]]]
                    at = m.end()
                found += self.pattern.findall(text, at) if at < len(text) else []
            else:
                found = self.pattern.findall(text)
            parts.append(found)
        known = self.known
        new = {w for p in parts for w in p if w not in known and isinstance(w, str)}
        if new:
            if self.held > KNOWN_BYTES:
                known.clear()
                self.held = 0
                new = {w for p in parts for w in p if isinstance(w, str)}
            words = list(new)
            merged = [x.tobytes() for x in self.merge([w.encode() for w in words])]
            known.update(zip(words, merged, strict=True))
            self.held += sum(4 * len(w) + len(x) + KNOWN_ENTRY for w, x in zip(words, merged, strict=True))
        known.update((i, np.array([i], np.uint32).tobytes()) for i in self.special.values())
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), np.uint32) for p in parts]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes end to end, and where each token starts."""
        if not hasattr(self, "_tables"):
            n = max(self.bytes_of) + 1
            sizes = np.zeros(n + 1, np.int64)
            for i, b in self.bytes_of.items():
                sizes[i + 1] = len(b)
            self._tables = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8), np.cumsum(sizes)
        return self._tables

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, gathered in one step."""
        flat, starts = self.tables()
        begin, size = starts[ids], starts[ids + 1] - starts[ids]
        at = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(ids) else np.zeros(0, np.int64)
        return flat[at].tobytes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this worker for a vocabulary file, read once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    c = codec(path)
    for batch in batches:
        for t in bytesets.texts(batch.column(1)):
            rows = [t.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(t.starts.tolist(), t.ends.tolist(), strict=True)]
            yield batch.column(0).slice(int(t.rows[0]), len(rows)), c.encode_batch(rows)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array<int>) of each whole text; a null or empty text has no ids."""
    path = path or default_path()

    def run(batches):
        for ids, found in _encoded(batches, path):
            flat = np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)
            offs = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that aren't UTF-8 become U+FFFD; null ids give empty text."""
    path = path or default_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, then decoded again.

    A null text counts as an empty one, with no tokens; repeated rows and rows without an id get a row each.  Other columns aren't read.
    """
    path = path or default_path()

    def run(batches):
        for ids, found in _encoded(batches, path):
            c = codec(path)
            text = [hashlib.sha256(c.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
