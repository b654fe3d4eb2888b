"""Queries that once handled a part of their input, against plain versions of the whole job."""

import random
from difflib import SequenceMatcher

import pytest

from corpusmill.functions import repair
from corpusmill.functions.sequences import ratio_of


def pieces(seed, letters, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(letters, k=rnd.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcdef ", "a"])
def test_ratio_of(letters):
    texts = pieces(1, letters, 60, 25)
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        want = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert ratio_of(a, b) == want
        assert all(ratio_of(a, b, x) == (want if want >= x else None) for x in (0.3, 0.45, 0.85))


def test_fuzzy_matches_against_all_pairs(spark, monkeypatch):
    from corpusmill.operators import matching

    monkeypatch.setattr(matching, "QUERY_BLOCK", 7, raising=False)
    monkeypatch.setattr(matching, "ENTRY_BLOCK", 11, raising=False)
    long = "lorem ipsum dolor sit amet " * 14
    texts = [*pieces(2, "abc de", 50, 14), "ab cd ef", "ab cd eg", "ab cd ef", "\u4f60\u597d\u4e16\u754c", "\u4f60\u597d\u4e16\u4eba", long + "x" * 400, long + "y" * 400, "w" * 320 + long, "v" * 320 + long]
    rows = list(enumerate(texts))
    want = []
    for i, a in rows:
        scored = []
        for j, b in rows:
            if len(a) > 1 and b and a != b:
                score = 0.85 if a in b or b in a else SequenceMatcher(None, a, b, autojunk=False).ratio()
                scored += [(-score, j)] if score >= 0.45 else []
        want += [(i, j, -s) for s, j in sorted(scored)[:3]]
    make = lambda c: spark.createDataFrame(rows, f"{c} long, norm string")
    assert sorted(tuple(r) for r in matching.fuzzy_matches(make("query_id"), make("entry_id")).collect()) == sorted(want)


@pytest.mark.parametrize("most", [10**6, 0])
def test_short_needles_both_ways(spark, most):
    from corpusmill.operators.corpus import contained

    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "fox"), (3, None), (4, ""), (5, "a quick brown fox")], "doc_id long, text string")
    items = spark.createDataFrame([(6, ""), (7, "fox"), (8, "quick brown fox"), (9, "x"), (10, "a q"), (11, "the quick br"), (12, "dog")], "item_id long, needle string")
    assert sorted(tuple(r) for r in contained(docs, items, most=most).collect()) == [(7, 1), (7, 2), (7, 5), (8, 1), (8, 5), (9, 1), (9, 2), (9, 5), (10, 5), (11, 1)]


def test_lexicon_segments_use_every_word(spark):
    from corpusmill.operators.repair_queries import segment_counts

    texts = ["", "  ", *(f"w{k} extraordinarily{k}\n" for k in range(30)), *pieces(3, "abcd  \n", 60, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    for words in (["ab", "abc", "cd", "dcb", "aaaaaaaaaaaaaaaa"], ["extraordinarily", "extraordinarily2", "w1", "bb"], []):
        got = {r.doc_id: (r.segments, r.known) for r in segment_counts(docs, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
        want = [repair.segment_text(t, set(words), max(map(len, words), default=1)) for t in texts]
        assert got == {k: (len(f), sum(len(x) > 1 for x in f)) for k, f in enumerate(want)}


def test_lexicon_segments_know_rare_and_long_words(spark, tmp_path):
    from corpusmill.operators.repair_queries import lexicon_segments

    words = [f"q{k}" for k in range(20_001)] + ["extraordinarily"]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = lexicon_segments(spark, str(tmp_path)).first()
    assert (r.segments, r.known) == (2 * len(words) - 1, len(words))


def test_similarity_ratio_of_whole_turns(spark, tmp_path):
    from corpusmill.operators.corpus import similarity_ratio

    texts = ["same opening " * 40 + "x" * 300, "same opening " * 40 + "y" * 300, "z" * 450 + "an ending " * 30, "w" * 450 + "an ending " * 30]
    spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.ratio for r in similarity_ratio(spark, str(tmp_path)).collect()}
    assert got == {k: round(SequenceMatcher(None, texts[k], texts[k + 1], autojunk=False).ratio(), 9) for k in range(3)}


def test_name_variants_of_every_common_word(spark, tmp_path):
    from corpusmill.operators.audit import name_variant_rows

    rnd = random.Random(4)
    names = ["".join(rnd.choices("bcdfghklmnprst", k=rnd.randint(4, 15))) for _ in range(250)]
    rows = [(k, " ".join(names)) for k in range(3)] + [(3, " ".join(n[:-1] + "a" for n in names))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = set(names) | {n[:-1] + "a" for n in names}
    want = {}
    for name in set(names):
        for run in runs:
            if abs(len(run) - len(name)) <= 1 and run not in name and name not in run:
                same, grams = run[:2] == name[:2], {run[k : k + 3] for k in range(len(run) - 2)} & {name[k : k + 3] for k in range(len(name) - 2)}
                score = round(SequenceMatcher(None, run, name, autojunk=False).ratio(), 2)
                if (same or grams) and score >= (0.72 if same else 0.86):
                    want[name] = max(want.get(name, (0, "")), (score, run))
    assert {r.name: (r.similarity, r.run) for r in name_variant_rows(spark, str(tmp_path)).collect()} == want
    assert len(want) > 200
