"""Lexicons that are met in joins give what shared ones give; walks confirmed by the reverse table against a plain walk."""

import random

import pytest

from corpusmill.functions import tries
from corpusmill.operators import two_way

LETTERS = "abcdef"


def plain_pieces(t, forward, reverse):
    """The walk as the module states it, over dictionaries."""
    steps, named = {}, {}
    for root, step, token, rank, ids in sorted(forward, key=lambda r: (r[3], r[2])):
        steps.setdefault((root, step), []).append((token, ids))
    for body, suffix, roots, rank in sorted(reverse, key=lambda r: (r[3], r[1])):
        for root in roots:
            named.setdefault((root, body), root + suffix)
    out, k = [], 0
    while k < len(t):
        if t[k].isspace():
            k += 1
            continue
        if t[k] == "{" and "}" in t[k:]:
            end = t.index("}", k) + 1
            out.append((t[k:end], None))
            k = end
            continue
        safe, name, place, step = k + 1, None, k + 1, 1
        while True:
            final = (t[k], step) not in steps
            here = next((x for x in steps.get((t[k], None if final else step), []) if t.startswith(x[0], place)), None)
            if here is None:
                break
            place += len(here[0])
            body = t[k + 1 : place][::-1]
            if here[1] and (t[k], body) in named:
                safe, name = place, named[t[k], body]
            if final:
                break
            step += 1
        out.append((t[k:safe], name))
        k = safe
    return out


def tables(rng):
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, n)))
    forward, seen = [], set()
    for _ in range(rng.randint(30, 60)):
        root, step, token = rng.choice(LETTERS[:4]), rng.choice([1, 1, 2, 3, None]), word(2)
        if (root, step, token) not in seen:
            seen.add((root, step, token))
            forward.append((root, step, token, rng.randint(0, 3), rng.random() < 0.8))
    bodies = sorted({word(4) for _ in range(rng.randint(150, 250))})
    reverse = [(b, f"-{b}{n}", rng.sample(LETTERS[:4], rng.randint(0, 4)), rng.randint(0, 2)) for b in bodies for n in range(rng.randint(1, 2))]
    texts = ["".join(rng.choice(LETTERS + "abcd .{}") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return forward, reverse, [None, "", "  ", texts[0], *texts]


FORWARD, REVERSE = "root string, step int, token string, rank int, ids boolean", "reversed string, suffix string, roots array<string>, rank int"


@pytest.mark.parametrize("most", [tries.MOST, 100, 0])  # both tables are shared, the forward one, none
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_confirmed_walk(spark, monkeypatch, most, seed):
    monkeypatch.setattr(tries, "MOST", most)
    forward, reverse, texts = tables(random.Random(seed))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id int, text string, key string")
    got = {r.id: r.pieces for r in two_way.verified_segments(docs, spark.createDataFrame(forward, FORWARD), spark.createDataFrame(reverse, REVERSE)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == (None if t is None else plain_pieces(t, forward, reverse)), t
    assert any(p.id and len(p.surface) > 2 for p in sum((got[k] for k in got if got[k]), []))


def test_what_no_suffix_confirms_falls_back(spark):
    forward = spark.createDataFrame([("a", 1, "b", 0, True), ("a", 2, "c", 0, True), ("a", None, "d", 0, True), ("a", None, "dd", 1, True)], FORWARD)
    reverse = spark.createDataFrame([("b", "-1", ["a"], 0), ("dcb", "-9", ["x"], 0), ("dcb", "-2", ["x", "a"], 1), ("cb", "-3", ["x"], 0)], REVERSE)
    docs = spark.createDataFrame([("abc",), ("abcdd",), ("abx",), ("bab",)], "text string")
    got = {r.text: [tuple(p) for p in r.pieces] for r in two_way.verified_segments(docs, forward, reverse).collect()}
    assert got == {
        "abc": [("ab", "a-1"), ("c", None)],  # bc isn't confirmed for a
        "abcdd": [("abcd", "a-2"), ("d", None)],  # the first final token that fits ends the walk
        "abx": [("ab", "a-1"), ("x", None)],
        "bab": [("b", None), ("ab", "a-1")],
    }


@pytest.mark.parametrize("no_forward", [True, False])
def test_empty_tables(spark, no_forward):
    forward = spark.createDataFrame([] if no_forward else [("a", 1, "b", 0, True)], FORWARD)
    out = two_way.verified_segments(spark.createDataFrame([("ab",), (None,)], "text string"), forward, spark.createDataFrame([], REVERSE))
    assert {r.text: r.pieces for r in out.collect()} == {"ab": [("a", None), ("b", None)], None: None}
    none = two_way.verified_segments(spark.createDataFrame([], "text string"), forward, spark.createDataFrame([], REVERSE))
    assert none.collect() == [] and none.columns == ["text", "pieces"]


def test_joined_lexicon_equals_shared(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(LETTERS + " }") for _ in range(rng.randint(1, 4))) for _ in range(120)})
    syllables = spark.createDataFrame([(w, f"S{k}") for k, w in enumerate(words)], "syllable string, id string")
    paths = sorted({tuple(f"S{rng.randrange(len(words))}" for _ in range(rng.randint(1, 2))) for _ in range(2000)})
    table = spark.createDataFrame([(list(p), [rng.choice("nvp")] * rng.randint(1, 2)) for p in paths], "path array<string>, tags array<string>")
    texts = [None, "", *("".join(rng.choice(LETTERS + " {}။1") for _ in range(rng.randint(0, 80))) for _ in range(80))]
    docs = spark.createDataFrame([(k, t, 1.5) for k, t in enumerate(texts)], "id int, text string, path double")
    read = lambda df, c: {r.id: r[c] for r in df.collect()}
    want = read(tries.segment(docs, syllables), "pieces"), read(tries.tag(docs, syllables, table), "tokens")
    assert any(len(t.syllables) > 1 for t in sum((x for x in want[1].values() if x), []))
    for most in (0, 130):  # neither table is shared; only the syllables are
        monkeypatch.setattr(tries, "MOST", most)
        assert read(tries.segment(docs, syllables), "pieces") == want[0]
        assert read(tries.tag(docs, syllables, table), "tokens") == want[1]
        assert tries.tag(docs, syllables, table).columns == ["id", "text", "path", "tokens"]


def test_a_long_run(spark, monkeypatch):
    monkeypatch.setattr(tries, "MOST", 0)
    docs = spark.createDataFrame([("ab" * 60_000,)], "text string")
    out = tries.segment(docs, spark.createDataFrame([("ab", "1"), ("aba", "2"), ("b", "3")], "syllable string, id string"))
    assert out.selectExpr("size(pieces) AS n", "pieces[0].id AS a", "pieces[1].id AS b").first() == (60_000, "2", "3")
