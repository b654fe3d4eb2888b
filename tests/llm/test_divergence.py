"""Source divergence against a plain version."""

import re
from collections import Counter, defaultdict

import pyarrow as pa

from corpusmill.llm import source_divergence

from . import brute

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_docs, top):
    """Rows of ``[(text, lang, source)]``."""
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        groups[lang].add(source)
        seen[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in seen[lang].items() if n >= min_docs]
        share = {}
        for s in [*sources, None]:
            of = {w: sum(count[lang, x][w] for x in (sources if s is None else [s])) for w in kept}
            n = sum(of.values())
            share[s] = {w: 1 + 10**9 * (of[w] + 5) // (n + 5 * len(kept)) for w in kept}
        for s in sources:
            parts = {"pair": [(sum(abs(share[s][w] - share[x][w]) for w in kept), x) for x in sources - {s}]}
            parts["term"] = [(share[s][w] - share[None][w], w) for w in kept if count[lang, s][w] and share[s][w] > share[None][w]]
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def rows(spark, docs, min_docs, top):
    df = brute.table(spark, [t for t, _, _ in docs], langs=[x for _, x, _ in docs], sources=[x for _, _, x in docs])
    df = df.selectExpr("*", "1 AS term", "'x' AS n", "0 AS v", "1 AS salt", "2 AS item")
    return sorted(map(tuple, source_divergence.audit(df, min_docs, top).collect()))


def test_against_a_plain_version(spark):
    words = "The the THE été Été naïve x1y café über 漢字 a".split()
    docs = [(" ".join(words[(k * j) % len(words)] for j in range(k % 13)), ["en", "fr", None][k % 3], ["a", "b", "c", None, ""][k % 5]) for k in range(120)]
    docs += [(None, "en", "only null"), ("", "de", "x"), ("123 !?", "de", "y"), docs[5], docs[5]]
    assert rows(spark, docs, 3, 4) == plain(docs, 3, 4)


def test_ties_go_by_bytes_and_no_terms_give_zero(spark):
    docs = [("zeta alpha Éa beta", "en", "a"), ("zeta alpha Éa beta", "en", "b"), ("gamma", "en", "c"), ("solo", "xx", "a")]
    got = rows(spark, docs, 2, 2)
    assert got == plain(docs, 2, 2)
    assert [r[3] for r in got if r[:3] == ("en", "a", "pair")] == ["b", "c"] or [r[3] for r in got if r[:3] == ("en", "a", "pair")] == ["c", "b"]
    assert {r[4] for r in rows(spark, docs, 99, 2)} == {0}
    assert not [r for r in got if r[0] == "xx"]


def test_counts_beyond_the_range_of_doubles(spark):
    """Shares are exact where a count times a billion leaves 64 bits."""
    size, v, n = 40_000_000_000_000, 7, 39_999_999_999_989
    got = spark.createDataFrame([(n, size, v)], "c long, n long, v long").selectExpr(f"{source_divergence._share('c', 'n')} AS p").first().p
    assert got == 1 + 10**9 * (n + 5) // (size + 5 * v)


def test_empty_table(spark):
    assert rows(spark, [], 1, 5) == []


def test_words_are_counted_before_rows_are_made(spark):
    """Counts by language and term come by one exchange, and no row is made for a word of a text."""
    df = brute.table(spark, ["a b"], langs=["en"], sources=["x"])
    plan = source_divergence.kept_terms(source_divergence.term_counts(df), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate " not in plan


def test_counts_of_runs_add_up(monkeypatch):
    """Runs of a few bytes and rows: terms meet at the ends of texts, case, zero bytes and code points of several bytes."""
    texts = ["ab", "AB ab", "", "b\x00B\x7fb", "é[É`é@x{", "漢字 a漢", "12 !", "ab" * 30, "\u0085a\u00a0b", "ſK İ"] * 7
    docs = [(x, ["en", "fr", ""][k % 3], ["s", "t"][k % 2]) for k, x in enumerate(texts)]
    table = pa.table([pa.array(c, pa.string()) for c in ([d[1] for d in docs], [d[2] for d in docs], texts)], ["lang", "source", "text"])
    want_n, want_docs = Counter(), Counter()
    for text, lang, source in docs:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOW))
        want_n.update((lang, source, w) for w in words)
        want_docs.update((lang, source, w) for w in set(words))
    for run, rows_at_once in [(1, 1), (16, 7), (50, 1000), (1 << 24, 1 << 16)]:
        monkeypatch.setattr(source_divergence, "RUN", run)
        monkeypatch.setattr(source_divergence, "ROWS", rows_at_once)
        n, n_docs = Counter(), Counter()
        for batch in source_divergence._counts(iter(table.to_batches())):
            found = batch.to_pylist()
            assert len({(r["lang"], r["source"], r["term"]) for r in found}) == len(found)
            for r in found:
                n[r["lang"], r["source"], r["term"]] += r["n"]
                n_docs[r["lang"], r["source"], r["term"]] += r["n_docs"]
        assert n == want_n and n_docs == want_docs
