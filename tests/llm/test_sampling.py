"""Bounded samples: one id, no id, repeated rows; and models without any."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import langid, sampling, toxicity, weak_quality

from . import brute


@pytest.mark.parametrize("doc_id", [None, 1, 2, 7, 8])
def test_rows_of_one_id_are_neither_all_nor_none(spark, doc_id):
    rows = spark.range(40_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = [r.text for r in sampling.bounded(rows, 600, ["text"]).collect()]
    assert len(got) == len(set(got)) == 600
    assert sorted(got) == sorted(r.text for r in sampling.bounded(rows.repartition(7), 600, ["text"]).collect())


def test_repeated_rows_count_once(spark):
    rows = spark.range(40_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert [r.text for r in sampling.bounded(rows, 600, ["text"]).collect()] == ["same"]
    assert sampling.bounded(rows.limit(0), 600, ["text"]).count() == 0


def test_groups_are_bounded(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") < 2000, F.concat(F.lit("l"), F.col("id") % 4)).otherwise(F.concat(F.lit("junk"), "id")).alias("lang"))
    got = sampling.bounded(rows, 50, ["lang"], F.col("lang"), 4).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {f"l{k}": 50 for k in range(4)}


def test_dirty_languages_are_not_learned(spark):
    texts = [w for k in range(60) for w in (f"the house and the river {k}", f"das haus und der fluss {k}")]
    docs = brute.table(spark, texts + [f"x{k} y" for k in range(300)], ["en", "de"] * 60 + [f"lang{k}" for k in range(300)])
    assert langid.train(docs, 40, 2).langs == ["de", "en"]


def test_junk_is_not_kept_without_a_sample(spark):
    good = " ".join("the river and the house of the old town , where it was said that people lived .".split() * 8)
    texts = [good + f" {k}" for k in range(60)] + ["!!! ### $$$ %%% " * 20 + str(k) for k in range(40)]
    patterns = weak_quality.train(brute.table(spark, texts))
    model = weak_quality.Model(patterns.patterns, np.ones(len(patterns.patterns)), [])
    assert not model.fitted
    got = weak_quality.classify(brute.table(spark, ["!!! ###", "", None]), model).collect()
    assert [r.kept for r in got if r.doc_id > 0] == [False, False]
    assert all(r.score == r.posterior or r.score == 0 for r in got)


def test_a_repeated_labelled_id_is_bounded(spark):
    """All rows of one labelled id: the sample is full, not empty and not over the bound."""
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("vile words "), "id").alias("text"))
    docs = docs.unionByName(spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("kind words "), "id").alias("text")))
    labels = spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.lit(0).alias("toxic")).unionByName(spark.createDataFrame([(7, 1), (7, 0), (None, 1)], "doc_id long, toxic int"))
    sizes = []
    kept = toxicity.Model.__init__

    def counted(self, rows, counts, toxic):
        sizes.append((len(rows), int(toxic.sum())))
        kept(self, rows, counts, toxic)

    toxicity.Model.__init__ = counted
    try:
        toxicity.train(docs, labels, 1000)
    finally:
        toxicity.Model.__init__ = kept
    assert sizes[0][0] == 1000 and 0 < sizes[0][1] < 1000


def test_values_on_repeated_and_null_ids(spark):
    """Equal texts get equal results whatever their ids are."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = [r.text for r in docs.limit(20).collect()]
    odd = brute.table(spark, some + some + some, ids=list(range(20)) + [3] * 20 + [None] * 20)
    models = {
        "weak": weak_quality.classify(odd, weak_quality.train(docs)).select("doc_id", "score", "kept"),
        "toxic": toxicity.grade(odd, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).select("doc_id", "p_toxic", "kept"),
        "lang": langid.classify(odd, langid.train(docs)).select("doc_id", "score", "lang_pred"),
    }
    for out in models.values():
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == 60
        parts = [sorted(r[1:] for r in rows if pick(r[0])) for pick in (lambda d: d is None, lambda d: d == 3, lambda d: d not in (None, 3))]
        assert [len(p) for p in parts] == [20, 21, 19] and set(parts[2]) <= set(parts[0]) == set(parts[1])


def test_language_against_a_plain_version(spark):
    """The whole prediction from the machines' weights, text by text and gram by gram."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    k = len(model.family_machines)
    m32 = (1 << 32) - 1

    def plain(text):
        raw = text.encode()
        fold = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalpha() else 32 for c in raw)
        words = b" " + b" ".join(fold.split(b" ")) + b"  "
        while b"  " in words[:-2]:
            words = words[:-2].replace(b"  ", b" ") + words[-2:]
        total, n = [0.0] * model.weights.shape[1], 0
        for i in range(len(words) - 3):
            a, b, c, d = words[i : i + 4]
            g = a << 16 | b << 8 | c
            three = (g * 0x9E3779B1 & m32) >> (32 - langid.BITS)
            four = (((g ^ (d * 0x01000193 & m32)) * 0x85EBCA6B & m32) ^ 0x5BD1E995) >> (32 - langid.BITS)
            for j in range(len(total)):
                total[j] += float(model.weights[three, j]) + float(model.weights[four, j])
            n += 2
        margin = [t / n + b for t, b in zip(total, model.bias, strict=True)]
        if k == 0:
            family = model.families[0]
        elif k == 1:
            family = model.families[int(margin[0] < 0)]
        else:
            family = model.families[max(range(k), key=lambda j: margin[j])]
        wins = {x: [0, 0.0, x] for x in model.within[family]}
        for (x, y), d in zip(model.pairs, margin[k:], strict=True):
            if x in wins:
                wins[x if d >= 0 else y][0] += 1
                wins[x][1] += d
                wins[y][1] -= d
        return max(wins.values())[2]

    some = docs.where("length(text) < 1500 and text rlike '[a-zA-Z]'").limit(40)
    got = {r.doc_id: r.lang_pred for r in langid.classify(some, model).collect()}
    assert got == {r.doc_id: plain(r.text) for r in some.collect()}
