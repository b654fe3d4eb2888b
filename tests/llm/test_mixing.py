"""Source mixing against a plain version of its targets, and by what the rounding must keep."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing

from . import brute


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Give capped sources their cap and reshare the rest by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped: dict = {}
    while True:
        rest, open_ = sum(sizes.values()) - sum(capped.values()), [s for s in names if s not in capped]
        if not open_:
            return capped
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(cap * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 1, 5, 100, 3000, 10**6]) for s in [None, "", "a", "A", "b", "é", "z", "\U0001f600", "￿"][: 3 + 2 * seed]}
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = targets(sizes)
    assert set(got) == set(want)
    for s, t in want.items():
        assert abs(got[s] - t) <= 1e-6 * max(1.0, t), s


def test_many_sources(spark):
    sizes = {f"host{k}": 1 + k * k % 97 for k in range(3000)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = targets(sizes)
    assert max(abs(got[s] - t) for s, t in want.items()) < 1e-6


def odd_table(spark):
    rows = [(k, "w " * (1 + k % 7), "en", "abc"[k % 3], 0) for k in range(400)]
    rows += [(None, "same words here", "en", "a", k) for k in range(700)]  # null ids, equal texts
    rows += [(7, "v " * 30, "en", None, k) for k in range(300)]  # one id, equal texts
    rows += [(7, f"u{k} x", "en", "b", k) for k in range(50)] + [(1000, None, "en", "a", 0), (None, "", None, None, 0), (1001, " \n", "en", "zzz", 0)]
    return spark.createDataFrame(rows, brute.SCHEMA), rows


def test_taken_words_come_near_targets(spark):
    docs, rows = odd_table(spark)
    got = mixing.decide(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken, most = targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        due = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.taken == r.copies * r["size"] and (r["size"] == 0 or int(due + 1e-9) <= r.copies <= int(due - 1e-9) + 1)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= most[s]
    key = lambda x: Counter((r.doc_id, r["size"], r.source, r.copies) for r in x)
    assert key(mixing.decide(docs.repartition(3)).collect()) == key(got)
    # the mixture has the rows themselves, equal ones in any order
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == sum(r.copies for r in got if r["size"])
    assert Counter((r.doc_id, r.source) for r in mixed) == Counter((r.doc_id, r.source) for r in got if r["size"] for _ in range(r.copies))
    assert max(Counter((r.doc_id, r.text, r.source, r.n_chars) for r in mixed).values()) <= 3


def test_draws_keep_expectations(spark):
    """Over many sources with the same documents, each document is taken as often as it is due."""
    rows = [(1000 * s + k, "w " * (k + 1), "en", f"s{s:04d}", 0) for s in range(1200) for k in range(3)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    got = mixing.decide(docs, (2, 1)).groupBy(F.pmod("doc_id", F.lit(1000)).alias("k"), "target").agg(F.avg("copies").alias("copies"), F.count(F.lit(1)).alias("n")).collect()
    for r in got:
        due = r.target / 6
        assert abs(r.copies - due) < 5 * np.sqrt(0.25 / r.n), (r.k, r.copies, due)
