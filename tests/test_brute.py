"""Queries that SQL can't express, on the smallest tables against plain versions."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import registry
from corpusmill.functions import legacy_rules, repair, script, splitters

SF = "/root/testdata/sf0.001"
md5 = lambda t: hashlib.md5(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", script.as_myanmar(F.coalesce("text", F.lit(""))).alias("t"), "text").collect()
    return {r.doc_id: (r.t, r.text) for r in rows}


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_ordered_and_cleaned_text(spark, texts):
    assert {r.doc_id: r.digest for r in run(spark, "ordered_text")} == {d: md5(repair.order_text(t)) for d, (t, _) in texts.items()}
    assert {r.doc_id: r.digest for r in run(spark, "cleaned_text")} == {d: md5(repair.cleanup_text(t)) for d, (t, _) in texts.items()}


def test_legacy_conversion(spark, texts):
    convert = repair.convert_text(legacy_rules.RULES)
    assert {r.doc_id: r.digest for r in run(spark, "legacy_conversion")} == {d: md5(convert(t)) for d, (t, _) in texts.items()}
    rnd = np.random.default_rng(4)
    chars = [chr(c) for c in range(0x1000, 0x10A0)] + list(" \n\u200b.1a") + list("ေြ့်္")
    odd = ["".join(rnd.choice(chars, rnd.integers(1, 30))) for _ in range(2000)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").select("k", script.converted(F.col("t"), legacy_rules.RULES).alias("c")).collect()
    want = [convert(t) if re.search("[က-႟]", t) else t for t in odd]
    assert [r.c for r in sorted(got, key=lambda r: r.k)] == want


def test_scan_counts_with_lookarounds(spark, texts):
    def plain(t):
        repeat = len(re.findall("([က-႟]{2,4})\\1{2,}", t))
        inside = lambda c: bool(c) and re.match(f"[{script.LETTER_OR_MARK}]", c) is not None
        digit = sum(c in script.DIGITS and k > 0 and inside(t[k - 1]) and inside(t[k + 1 : k + 2]) for k, c in enumerate(t))
        return repeat, digit

    assert {r.doc_id: (r.repeat, r.digit) for r in run(spark, "scan_lookaround_counts")} == {d: plain(t) for d, (t, _) in texts.items()}


def test_exact_pieces(spark, texts):
    got = {r.doc_id: (r.pieces, r.whole) for r in run(spark, "exact_pieces")}
    for d, (_, t) in texts.items():
        if t is None:
            continue
        # the fewest pieces hold no more than the limit and none could take the next one's first sentence
        parts = splitters.split_exactly(t, 900)
        assert "".join(parts) == t and max(map(len, parts), default=0) <= 900 and got[d] == (len(parts), True)


def test_encoding_detector(spark, texts):
    letters = script.AS_MYANMAR
    rnd = np.random.default_rng(7)
    weights = rnd.normal(0, 0.05, (len(letters) + 1, len(letters) + 1))
    got = {r.doc_id: (r.p, r.category) for r in run(spark, "encoding_detector")}
    for d, (t, _) in texts.items():
        total, before, any_ = 0.0, 0, False
        for c in [*t, None]:
            now = letters.rindex(c) + 1 if c and c in letters else 0
            if before or now:
                total, any_ = total + weights[before, now], True
            before = now
        p = 1 / (1 + math.exp(-max(-700.0, min(700.0, total)))) if any_ else None
        assert got[d][1] == ("UNKNOWN" if p is None else "FIRST" if p > 0.5 else "SECOND")
        assert p is None or abs(got[d][0] - p) < 2e-6


def test_lookalike_repairs(spark, tmp_path):
    words = ["ဝက", "ဉမ", "ရလ"]
    rows = [(k, " ".join(words)) for k in range(3)] + [(3, "၀က ဥမ ၇လ ၇ရ ဝက"), (4, "၀က")]
    # the query reads Latin letters as Myanmar ones; these stay as they are
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.token, r.fixed, r.n) for r in registry.queries()["lookalike_repairs"](spark, str(tmp_path)).collect()}
    assert got == {("၀က", "ဝက", 2), ("ဥမ", "ဉမ", 1), ("၇လ", "ရလ", 1)}


def test_quotes_of_turns(spark):
    before = {(r.conv_id, r.turn): r.n for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.regexp_count(F.translate("text", "vx'", '"' * 3), F.lit('"|&quot;')).alias("n")).collect()}
    got = {(r.conv_id, r.turn): r.changes for r in run(spark, "quote_repairs")}
    assert got == {k: n or 0 for k, n in before.items()} and sum(got.values()) > 0


def test_sections_and_forms_of_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    found = run(spark, "page_sections")
    assert found and all(r.chars <= len(pages[r.page_id]) for r in found)
    for r in found:
        assert not r.heading or r.heading.split()[0] in pages[r.page_id]
