"""The trained operators: held-out accuracy, and parts with known answers."""

import numpy as np

from corpusmill.llm import langid, quality_rules, toxicity, weak_quality

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in langid.query(spark, SF).collect() if r.held_out]
    assert len(got) > 100
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.fold_of("17") == __import__("zlib").crc32(b"17") % 5


def test_toxic_words_are_found(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in toxicity.query(spark, SF).collect()}
    clean = [got[d].toxic for d, t in truth.items() if not t]
    bad = [got[d].toxic for d, t in truth.items() if t]
    assert np.mean(clean) < 0.02
    assert np.mean(bad) > 0.5
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 for r in got.values())
    assert all(r.kept != r.toxic for r in got.values())


def test_thresholds_are_ordered():
    rnd = np.random.default_rng(1)
    rows, counts, toxic = [], [], []
    for k in range(400):
        t = k % 4 == 0
        rows.append(np.unique(np.r_[rnd.integers(0, 300, 20), [900] if t else []].astype("<u4")))
        counts.append(np.full(len(rows[-1]), 1 + k % 8, "<u4"))
        toxic.append(t)
    m = toxicity.Model(rows, counts, np.array(toxic))
    assert 900 in m.chosen
    assert (np.diff(m.thresholds) > 0).all()


def test_weak_labels(spark):
    patterns = np.array([[1, 1, 1], [0, 0, 0], [1, 1, 0], [0, 0, 1], [2, 2, 2]])
    posterior, table, prior = weak_quality.estimate(patterns, np.array([70, 20, 5, 3, 2]))
    assert posterior[0] > 0.9 and posterior[1] < 0.1 and 0.5 < prior < 0.95
    assert np.allclose(table.sum(2), 1)
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in weak_quality.query(spark, SF).collect()}
    assert np.mean([got[d] for d, r in truth.items() if r.quality == 1]) > 0.95
    assert np.mean([got[d] for d, r in truth.items() if r.quality == 0]) < 0.1


def plain_em(patterns, counts, rounds):
    """Naive EM with dictionaries: two classes, independent labellers, the same smoothing."""
    good = [(sum(v == 1 for v in p) + 1) / (sum(v != 2 for v in p) + 2) for p in patterns]
    for _ in range(rounds):
        table = {}
        for c in (0, 1):
            mass = [n * (g if c else 1 - g) for n, g in zip(counts, good, strict=True)]
            for j in range(len(patterns[0])):
                votes = [0.5 + sum(m for m, p in zip(mass, patterns, strict=True) if p[j] == v) for v in range(3)]
                table[c, j] = [x / sum(votes) for x in votes]
        prior = (sum(n * g for n, g in zip(counts, good, strict=True)) + 1) / (sum(counts) + 2)
        new = []
        for p in patterns:
            like = [np.prod([table[c, j][v] for j, v in enumerate(p)]) * (prior if c else 1 - prior) for c in (0, 1)]
            new.append(like[1] / sum(like))
        good = new
    return good, prior


def test_em_equals_the_naive_one():
    rnd = np.random.default_rng(7)
    patterns = np.unique(rnd.integers(0, 3, (40, 4)), axis=0)
    counts = rnd.integers(1, 50, len(patterns))
    for rounds in (1, 2, 30):
        posterior, _, prior = weak_quality.estimate(patterns, counts, rounds)
        good, p = plain_em(patterns.tolist(), counts.tolist(), rounds)
        assert np.allclose(posterior, good, atol=1e-8) and abs(prior - p) < 1e-8


def test_em_finds_the_labellers_errors():
    """Votes drawn from known accuracies: EM recovers them without a label."""
    rnd = np.random.default_rng(3)
    right = np.array([0.9, 0.8, 0.75, 0.7, 0.6])
    truth = rnd.random(40_000) < 0.7
    votes = np.where(rnd.random((len(truth), 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, table, prior = weak_quality.estimate(patterns, counts, 2000)
    assert abs(prior - 0.7) < 0.03
    assert np.abs(table[1, :, 1] - right).max() < 0.04 and np.abs(table[0, :, 0] - right).max() < 0.04


def test_votes_do_not_jump_at_a_length():
    import pyarrow as pa

    from corpusmill.llm import bytesets

    texts = [" ".join(["word"] * n) for n in (400, 1999, 2000, 2001, 30_000)]
    found = [v for t in bytesets.texts(pa.array(texts)) for v in weak_quality.votes(weak_quality.measures(t)).tolist()]
    assert all(v == found[0] for v in found) and found[0][6] == 0


def test_scorer_separates_what_it_was_given():
    rnd = np.random.default_rng(5)
    rows = []
    for k in range(300):
        cols = np.unique(rnd.integers(0, 500, 20)) + (0 if k % 2 else 1000)
        rows.append((k % 2, cols.astype("<u4"), np.full(len(cols), 1 / len(cols), "<f4")))
    m = weak_quality.Model(np.zeros(0, np.int64), np.zeros(0), [])
    m._fit(np.array([r[0] for r in rows], float), [r[1] for r in rows], [r[2] for r in rows])
    z = np.array([(m.weights[r[1].astype(int)] * r[2]).sum() + m.bias for r in rows])
    assert ((z > 0) == (np.arange(300) % 2 == 1)).all()


def test_ordinal_gradient():
    rnd = np.random.default_rng(1)
    n, m = 30, 5
    row, at = np.repeat(np.arange(n), 3), rnd.integers(0, m, 3 * n)
    x, grade = np.log2(1 + rnd.integers(1, 9, 3 * n)), rnd.integers(0, toxicity.GRADES, n)
    w, theta = rnd.normal(size=m), rnd.normal(size=toxicity.GRADES - 1)
    _, g = toxicity.gradient(w, theta, row, at, x, grade)

    def likelihood(both):
        """Plain form: each grade's probability as the difference of two sigmoids."""
        w, theta = both[:m], both[m:]
        cuts = [theta[0]]
        for t in theta[1:]:
            cuts.append(cuts[-1] + np.exp(t))
        total = -toxicity.RIDGE / 2 * (w**2).sum()
        for k in range(n):
            f = sum(x[i] * w[at[i]] for i in range(len(row)) if row[i] == k)
            up = [1.0] + [1 / (1 + np.exp(c - f)) for c in cuts] + [0.0]
            total += np.log(up[grade[k]] - up[grade[k] + 1])
        return total

    both = np.r_[w, theta]
    assert abs(likelihood(both) - toxicity.gradient(w, theta, row, at, x, grade)[0]) < 1e-8
    for k in range(len(both)):
        step = np.zeros(len(both))
        step[k] = 1e-5
        assert abs((likelihood(both + step) - likelihood(both - step)) / 2e-5 - g[k]) < 1e-4


def test_expected_severity_follows_counts():
    """Held-out texts that say the telling word more often get a higher grade."""
    import pyarrow as pa

    from corpusmill.llm import bytesets

    rnd = np.random.default_rng(2)
    made = lambda bad: " ".join([f"w{x}" for x in rnd.integers(0, 300, 30)] + ["vile"] * bad)
    texts = [made([0, 0, 1, 3, 8][k % 5]) for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
    rows = [(c, n) for b in toxicity._vectors(iter([batch])) for c, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    m = toxicity.Model([np.frombuffer(c, "<u4") for c, _ in rows], [np.frombuffer(n, "u1") for _, n in rows], np.array([k % 5 > 1 for k in range(1000)]))
    assert (np.diff(m.thresholds) > 0).all()
    p = np.concatenate([m.score(t) for t in bytesets.texts(pa.array([made(n) for n in (0, 1, 3, 8, 20)]))])
    severity = p.sum(1)
    assert (np.diff(severity) > -1e-9).all() and severity[0] < 0.2
    assert [(x >= 0.5).sum() for x in p[:4]] == [0, 1, 2, 3]


def test_languages_in_a_small_table(spark):
    from . import brute

    texts, langs = [], []
    for k in range(40):
        for lang, words in (("en", "the house and the river"), ("de", "das haus und der fluss"), ("fr", "la maison et le fleuve")):
            texts.append(f"{words} {k}")
            langs.append(lang)
    odd = [None, "", "123 ...", "the house and the river", "the house and the river", "é"]
    docs = brute.table(spark, texts + odd, langs + [None] * 4 + ["de", "de"])
    got = {r.doc_id: r for r in langid.classify(docs, langid.train(docs.where("doc_id < 120"))).collect()}
    assert all(got[k].lang_pred == lang for k, lang in enumerate(langs))
    assert [(got[120 + k].lang_pred, got[120 + k].score) for k in range(3)] == [("und", 0.0)] * 3
    assert got[123][2:] == got[124][2:] == ("en", got[123].score) and got[125].lang_pred in ("en", "de", "fr")
    assert {r.lang_pred for r in langid.classify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_repeated_windows(spark):
    def plain(w):
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        return len({j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 3)})

    texts = ["a b c a b c", "a a a a", "a b c d e", "x y", "a b a b a b a b z a b a", "", None]
    got = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {k: plain((t or "").split()) for k, t in enumerate(texts)}


def test_no_column_is_lost_by_the_rules(spark):
    """Working names, as a user might have them, and others that differ by case only."""
    names = ["_text", "_words", "_lines", "_grams", "_sorted", "_marks", "rules_text", "_rules_WORDS"]
    docs = spark.createDataFrame([(1, "a b c " * 40), (1, None)], "doc_id long, text string").selectExpr("*", *[f"'{n} kept' AS `{n}`" for n in names])
    out = quality_rules.judge(docs)
    assert set(names) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n} kept" for n in names]
        assert r.n_words in (120, 0) and r.base_failed
