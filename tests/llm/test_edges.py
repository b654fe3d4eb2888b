"""Every operator on empty tables, nulls in all columns, repeated rows and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, langid, line_dedup, media, mixing, ngram_join, quality_rules, substring_dedup, suffix_dedup, toxicity, weak_quality

from . import brute

LABELS = "doc_id long, quality int, toxic int"


def operators(spark, labels):
    return {
        "suffix": suffix_dedup.digests,
        "media": lambda d: media.digests(media.text_media(d)),
        "lines": line_dedup.digests,
        "line text": line_dedup.dedup,
        "weak": lambda d: weak_quality.classify(d, weak_quality.train(d)),
        "toxic": lambda d: toxicity.grade(d, toxicity.train(d, labels)),
        "clean": lambda d: toxicity.clean(d, toxicity.train(d, labels)),
        "rules": quality_rules.judge,
        "lang": lambda d: langid.classify(d, langid.train(d)),
        "ngram": ngram_join.similar,
        "bpe": bpe.digests,
        "mix": mixing.decide,
        "recompression": substring_dedup.digests,
    }


NAMES = ["suffix", "media", "lines", "line text", "weak", "toxic", "clean", "rules", "lang", "ngram", "bpe", "mix", "recompression"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    labels = spark.createDataFrame([], LABELS)
    assert operators(spark, labels)[name](brute.table(spark, [])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, "a b c " * 5000, "fr", "s", 1), (3, "a b c " * 5000, "fr", "s", 1), (4, "wort " * 40, None, "t", None), (4, "other text", "de", "t", None), (None, "text without id", "en", "s", 3)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    for c in ("score", "kept", "size", "n_words", "doc", "tag", "pid", "_id", "_text", "copies", "toxic"):
        docs = docs.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame([(1, None, None), (3, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1)], LABELS)
    out = operators(spark, labels)[name](docs).collect()
    assert len(out) == len(rows) or name == "clean"
    if name in ("rules", "line text", "clean"):
        assert all(r["_id"] == "clash" for r in out)


def test_mixing_and_first_keep_columns(spark):
    docs = brute.table(spark, ["a b", "a b", None], sources=["x", None, "x"]).withColumn("_id", F.lit(7))
    assert mixing.mix(docs).columns == docs.columns
    assert ngram_join.first_of_each(docs).columns == docs.columns
    assert {r.doc_id for r in ngram_join.first_of_each(docs).collect()} == {0, 2}
