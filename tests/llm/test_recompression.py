"""Recompression: symbols of equal windows, and the words removed, against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import bytesets, substring_dedup

from . import brute


def repeated(docs, length):
    """``[(words, removed, kept text)]`` of ``[(id, text)]`` in order of id and, of one id, text hash."""
    seen, out = set(), []
    for text in docs:
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for k in range(len(words) - length + 1):
            if tuple(words[k : k + length]) in seen:
                covered[k : k + length] = [True] * length
            seen.add(tuple(words[k : k + length]))
        out.append((len(words), sum(covered), b" ".join(w for w, c in zip(words, covered, strict=True) if not c)))
    return out


def drawn(rng, n, words):
    vocabulary = [f"w{k}" for k in range(words)]
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return [*docs, docs[0], f"{docs[1]} {docs[2]} x {docs[3]}"]


@pytest.mark.parametrize("seed", range(12))
def test_equal_windows_take_equal_symbols(seed, monkeypatch):
    rng = random.Random(seed)
    length, words = rng.choice([5, 8, 20]), rng.choice([1, 2, 3, 10, 200])
    monkeypatch.setattr(substring_dedup, "SEGMENT", rng.choice([7, 50, 1 << 17]))
    docs, key_of, n = drawn(rng, 12, words), {}, 0
    for t in bytesets.texts(pa.array(docs), rng.choice([100, 1 << 19])):
        for row, at, name, size, digest in substring_dedup.entries(t, length):
            k = 0
            for r, a, m, count in zip(row.tolist(), at.tolist(), name.tolist(), size.tolist(), strict=True):
                for j in range(count):
                    window = tuple(docs[t.rows[r]].split()[a + j : a + j + length])
                    assert key_of.setdefault(window, (m, int(digest[k]))) == (m, int(digest[k]))
                    k += 1
            n += k
    assert n == sum(max(0, len(d.split()) - length + 1) for d in docs)
    assert len(set(key_of.values())) == len(key_of)


def test_long_symbols_are_taken():
    words = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    _, took, _ = substring_dedup.chosen(words, np.r_[np.ones(4999, bool), False])
    assert len(np.unique(took)) < 5000 / 3  # a symbol stands for several windows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("small", [False, True])
def test_against_all_windows(spark, seed, small, monkeypatch):
    """With small buffers in the workers' functions most is settled by the exchange, with large ones in tasks."""
    rng = random.Random(100 + seed)
    docs = drawn(rng, 40, rng.choice([2, 5, 30])) + [None, "", " \n\t "]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    df = brute.table(spark, docs, ids=ids).repartition(7 if small else 1)
    want = repeated([t for _, t in sorted(zip(ids, docs, strict=True))], 6)
    got = sorted(map(tuple, substring_dedup.digests(df, 6).collect()))
    assert got == [(k, n, r, brute.sha(t)) for k, (n, r, t) in enumerate(want)]
    spans = {r.doc_id: sum(x.end - x.start for x in r.removed) for r in substring_dedup.dedup(df, 6).collect()}
    assert [spans[k] for k in range(len(docs))] == [r for _, r, _ in want]


def test_hot_names_are_dealt_by_digest(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_ONE_IN", 1)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 2)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(12))
    docs = [f"{rng.random()} {rng.random()} {rng.random()} {passage} {rng.random()} {rng.random()} {rng.random()}" for _ in range(60)]
    docs += docs[:20]
    got = sorted(map(tuple, substring_dedup.digests(brute.table(spark, docs).repartition(9), 8).collect()))
    assert got == [(k, n, r, brute.sha(t)) for k, (n, r, t) in enumerate(repeated(docs, 8))]


def test_ids_null_and_repeated(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (1, text + " a"), (1, text + " a"), (2, text), (2, "b " + text), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], brute.SCHEMA)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.digests(df).collect())
    # the null id comes first and keeps its words; rows equal in id and text are one; of id 2 both lose the passage
    assert got == [(False, 0, 0, 0), (False, 0, 30, 0), (True, 1, 31, 30), (True, 1, 31, 30), (True, 2, 30, 30), (True, 2, 31, 30)]


def test_very_long_text(spark):
    rng = random.Random(9)
    words = [str(rng.random()) for _ in range(60_000)]
    docs = [" ".join(words), "x " + " ".join(words[100:50_000]) + " y"]
    assert len(docs[0]) > bytesets.CHUNK
    got = sorted(map(tuple, substring_dedup.digests(brute.table(spark, docs)).collect()))
    assert [(n, r) for _, n, r, _ in got] == [(60_000, 0), (49_902, 49_900)]
