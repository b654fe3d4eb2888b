"""Suffix dedup, line dedup and the n-gram join against plain versions."""

import random

import pytest

from corpusmill.llm import line_dedup, ngram_join, suffix_dedup

from . import brute


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "dé", "eps", "zeta", "eta", "theta", "iota", "kappa", "a", "of"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(12)]
    common = ["Some very common line of text  ", "  another RATHER common line here\t", "short"]
    texts = [None, "", "\n", "   ", "x" * 700, "ab" * 300, "x" * 700]
    for _ in range(n):
        t = rnd.choice(base)
        if rnd.random() < 0.6:
            w = t.split(" ")
            w[rnd.randrange(len(w))] = rnd.choice(words)
            t = " ".join(w)
        if rnd.random() < 0.5:
            t = t + "\n" + rnd.choice(common)
        if rnd.random() < 0.3:
            t = rnd.choice(base) + "\n\n" + t
        texts.append(t)
    return texts


@pytest.mark.parametrize("limit", [20_000, 2])
@pytest.mark.parametrize("length", [40, 64, 200])
def test_suffix_dedup(spark, length, limit):
    texts = corpus(length)
    if length == 200:
        rnd = random.Random(8)
        noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
        passages = [noise(n) for n in (150, 199, 200, 201, 260, 900)]
        texts += [noise(rnd.randint(0, 90)) + p + noise(rnd.randint(0, 90)) for p in passages for _ in range(4)]
    want = brute.suffix_spans([(t or "").encode() for t in texts], length)
    got = {r.doc_id: r for r in suffix_dedup.digests(brute.table(spark, texts), length, limit).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(b - a for a, b in want[k]), len(want[k])), k
        assert r.kept_sha256 == brute.sha(suffix_dedup.cut(raw, want[k]))


def spans_of(spark, rows, length, limit=20_000):
    """Sorted ``(id, bytes, removed, spans, sha)`` of rows ``(id, text)``, and what brute force says."""
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], brute.SCHEMA)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, length, limit).collect()]
    raws = [(t or "").encode() for _, t in rows]
    want = [(d, len(x), sum(b - a for a, b in s), len(s), brute.sha(suffix_dedup.cut(x, s))) for (d, _), x, s in zip(rows, raws, brute.suffix_spans(raws, length), strict=True)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    return sorted(got, key=key), sorted(want, key=key)


@pytest.mark.parametrize("limit", [20_000, 2])
@pytest.mark.parametrize("ids", ["own", "null", "one", "mixed"])
def test_suffix_dedup_tells_rows_apart(spark, ids, limit):
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    head = noise(150)
    texts = [head + noise(300) for _ in range(6)]
    number = {"own": lambda k: k, "null": lambda k: None, "one": lambda k: 7, "mixed": lambda k: [None, 7, 7, -(2**63), -(2**63) + 1, 2**63 - 1][k]}[ids]
    rows = [(number(k), t) for k, t in enumerate(texts)]
    got, want = spans_of(spark, rows, 200, limit)
    assert got == want and not any(r[2] for r in got)
    # the same row once more: all of both goes
    got, want = spans_of(spark, rows + rows[:1], 200, limit)
    assert got == want and sum(r[2] for r in got) == 900


def test_suffix_dedup_of_texts_over_a_segment(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(suffix_dedup.SEGMENT + 5000))
    cut = long[suffix_dedup.SEGMENT - 150 : suffix_dedup.SEGMENT + 150]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(brute.table(spark, [long, cut, "x" * 10])).collect()}
    kept = long[: suffix_dedup.SEGMENT - 150] + long[suffix_dedup.SEGMENT + 150 :]
    assert got == {0: (300, 1, brute.sha(kept)), 1: (300, 1, brute.sha("")), 2: (0, 0, brute.sha("x" * 10))}


def test_loser_tree_keeps_order_and_prefixes():
    rnd = random.Random(3)
    make = lambda: bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12)))
    runs = [sorted(make() for _ in range(rnd.randint(0, 30))) for _ in range(7)]
    coded = [suffix_dedup.front_code([suffix_dedup.Suffix(x, b"", 0, 0, 1, 1, 1) for x in run]) for run in runs if run]
    out = list(suffix_dedup.loser_tree([suffix_dedup.decode_run(c) for c in coded]))
    assert [s.right for _, s in out] == sorted(x for run in runs for x in run)
    before = b""
    for k, s in out:
        assert k == suffix_dedup.common(before, s.right)
        before = s.right


def test_line_dedup(spark):
    texts = corpus(9)
    want = brute.line_dedup(dict(enumerate(texts)))
    assert any(w[1] for w in want.values())
    docs = brute.table(spark, texts)
    for r in line_dedup.digests(docs).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, gone, brute.sha(kept))
    for r in line_dedup.dedup(docs).collect():
        assert r.text == (None if texts[r.doc_id] is None else want[r.doc_id][2])


def test_keep_bitmaps_round_trip():
    assert line_dedup.unpack(line_dedup.pack([0, 5, 9]), 12).tolist() == [k not in (0, 5, 9) for k in range(12)]
    assert line_dedup.unpack(None, 3).all()


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(spark, words, percent):
    texts = corpus(words, 80)
    want = brute.components(dict(enumerate(texts)), words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(brute.table(spark, texts), words, percent).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts)
    kept = {r.doc_id for r in ngram_join.first_of_each(brute.table(spark, texts), words, percent).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_ngram_join_large_groups(spark):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"v{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    want = brute.components(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(brute.table(spark, texts)).collect()}
    assert got == want


def thue_morse(n, first="a", second="b"):
    """The string and its complement: equal under any byte polynomial in wrapping 64-bit arithmetic."""
    s = "".join((first, second)[bin(k).count("1") % 2] for k in range(n))
    return s, s.translate(str.maketrans(first + second, second + first))


def test_lines_with_equal_polynomials_are_not_equal(spark):
    a, b = thue_morse(2048)
    docs = {0: a, 1: a, 2: b, 3: "x " + a, 4: b + "\n" + a, 5: a}
    want = brute.line_dedup(docs)
    assert want[2][1] == 0 and want[0][1] == 1
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(brute.table(spark, list(docs.values()))).collect()}
    assert got == {d: (n, k, brute.sha(t)) for d, (n, k, t) in want.items()}


def test_long_words_with_equal_polynomials_are_not_equal(spark):
    a, b = thue_morse(2048)
    got = {r.doc_id: r.component_id for r in ngram_join.similar(brute.table(spark, [f"{a} w", f"{b} w", f"{a} w"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_line_dedup_of_null_and_repeated_ids(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (None, line), (None, line + "\nother"), (4, line), (4, line), (4, line + "\nsecond text"), (9, "Z")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], brute.SCHEMA)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_dedup.digests(docs).collect())
    # a null id is one document, the smallest: two documents hold the line
    assert got == sorted((d is not None, d or 0, t.count("\n") + 1, 0) for d, t in rows)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_dropped) for r in line_dedup.digests(docs.union(docs.limit(0)).unionByName(spark.createDataFrame([(5, line, "en", "s", 1)], brute.SCHEMA))).collect())
    assert got == sorted([(False, 0, 1)] * 3 + [(True, 4, 1)] * 3 + [(True, 5, 0), (True, 9, 0)])


def grouped(rows, words=4, percent=85):
    """Of rows ``(id, text)``: ``(id, set size, smallest id of the component that isn't null)`` of each, and how many components."""
    found = brute.components({k: t for k, (_, t) in enumerate(rows)}, words, percent)
    ids = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(found[k][1], []).append(d)
    least = {c: min((d for d in x if d is not None), default=None) for c, x in ids.items()}
    return [(d, found[k][0], least[found[k][1]]) for k, (d, _) in enumerate(rows)], ids


def odd_rows():
    rnd = random.Random(11)
    prose = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]

    def near(w):
        w = list(w)
        w[3] = "other"
        return " ".join(w)

    a, b, c, e = prose(120), prose(120), prose(90), prose(100)
    rows = [(5, " ".join(a)), (9, " ".join(b)), (None, near(a)), (None, near(b))]
    rows += [(7, " ".join(c)), (7, " ".join(e)), (3, near(e)), (None, "only null"), (None, "only null"), (None, ""), (None, None), (1, ""), (1, "  \n"), (4, "x"), (4, "x"), (4, "y")]
    return rows


def test_ngram_join_tells_rows_apart(spark):
    rows = odd_rows()
    want, ids = grouped(rows)
    docs = spark.createDataFrame([(d, t, "en", "s", k) for k, (d, t) in enumerate(rows)], brute.SCHEMA)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = ngram_join.similar(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    kept = ngram_join.first_of_each(docs, 4, 85).collect()
    wordless = [k for k, (_, t) in enumerate(rows) if not (t or "").split()]
    assert {r.n_chars for r in kept} >= set(wordless)
    worded = [r.doc_id for r in kept if r.n_chars not in wordless]
    groups = [x for c, x in ids.items() if (rows[c][1] or "").split()]
    assert sorted(worded, key=lambda d: (d is not None, d or 0)) == sorted((min((d for d in x if d is not None), default=None) for x in groups), key=lambda d: (d is not None, d or 0))
    assert all(r.text == rows[r.n_chars][1] for r in kept)


def test_one_of_repeated_rows_stays(spark):
    docs = brute.table(spark, ["one two three four five six"] * 2, ids=[8, 8])
    assert ngram_join.first_of_each(docs).count() == 1


def test_scratch_tables_go(spark):
    from corpusmill.llm import scratch

    at = scratch.mark()
    ngram_join.similar(brute.table(spark, corpus(3, 20))).count()
    left = scratch.since(at)
    assert sorted(p.split("/")[-1].rsplit("-", 1)[0] for p in left) == ["ngram-classes", "ngram-sets"]
    scratch.release(spark, left)
    assert scratch.since(at) == []
