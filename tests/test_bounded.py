"""Work on texts holds a bounded part of a batch, with the results of the whole."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import clusters, layout, repair, script


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    letters = [*script.MARK_ORDER, *"ကခသဥ \n#1a", "é"]
    return [None, "", *("".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(300)), "ကိ" * 400, None]


def test_parts_hold_all(monkeypatch):
    monkeypatch.setattr(clusters, "PART", 10)
    rows = pa.array(["abc", None, "x" * 25, "", "de", "fghijklm", None, "n", ""])
    got = [p.to_pylist() for p in clusters.parts(rows)]
    assert sum(got, []) == rows.to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in got) and len(got) > 2
    assert list(clusters.parts(rows.slice(0, 0))) == []


def test_arrays_are_of_a_part(spark, texts, monkeypatch):
    sizes = []
    made = clusters.Batch.__init__

    def seen(self, rows):
        sizes.append(sum(len(t.encode()) for t in rows) if len(rows) > 1 else 0)
        made(self, rows)

    monkeypatch.setattr(clusters.Batch, "__init__", seen)
    monkeypatch.setattr(clusters, "PART", 500)
    rows = pa.array(texts)
    score = clusters._scores(rows)
    whole = clusters.counts([t or "" for t in texts])
    assert score.field("marks").to_pylist() == whole["marks"].tolist() and len(score) == len(texts)
    assert max(sizes[:-1]) <= 500


def test_columns_over_parts(spark, texts):
    def column(f):
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", f.alias("o")).collect()
        return [r.o for r in sorted(rows, key=lambda r: r.k)]

    maybe = lambda f: [None if t is None else f(t) for t in texts]
    assert column(clusters.order_column(repair.GLUE)("t")) == maybe(repair.order_text)
    assert column(clusters.text_column(lambda x: clusters.sorted_marks(x, ""))("t")) == maybe(repair.reorder_text)
    assert column(F.transform(clusters.spans(F.col("t")), lambda x: F.array(x["a"], x["b"]))) == maybe(lambda t: [list(s) for s in repair.cluster_spans(t)])


def test_lines_of_large_files(spark, tmp_path):
    from corpusmill.sources import files

    rnd = random.Random(3)
    texts = {f"f{k}": "\n".join("".join(rnd.choices("ab \r\u2028", k=rnd.randint(0, 60))) for _ in range(rnd.randint(1, 400))) for k in range(4)} | {"last": "a\n\n"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode() + b"\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # parts of files
    try:
        parts = files.loose_lines(spark, str(tmp_path)).rdd.getNumPartitions()
        got = {(r.path.rsplit("/", 1)[1], r.k, r.line) for r in files.text_lines(spark, str(tmp_path)).collect()}
        loose = sorted(r.line for r in files.loose_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert parts > len(texts)
    assert got == {(name, k, line) for name, t in texts.items() for k, line in enumerate(t.split("\n"))}
    assert loose == sorted(line for t in texts.values() for line in t.split("\n"))


def test_modes_in_one_pass(spark, texts, monkeypatch):
    monkeypatch.setattr(clusters, "PART", 300)
    some = [*texts, "God of  Slaughter က {x}  ၁၂ 34", "{{}}"]
    d = spark.createDataFrame(list(enumerate(some)), "k int, t string")
    one = d.select("k", layout.every_mode(F.col("t")).alias("m"), *[layout.normaliser(m)(F.col("t")).alias(m) for m in layout.MODES[:-1]])
    wrapped = d.select("k", layout.wrap_blocks(layout.engine_normalise(F.col("t"))).alias("w"))
    rows = one.join(wrapped, "k").collect()
    assert len(rows) == len(some)
    assert all((r.m.normalize, r.m.mynormalize, r.m.mapper) == (r.normalize, r.mynormalize, r.w) and r.mapper == r.w for r in rows)


def test_prefix_pairs_compare_no_others(spark):
    from corpusmill.functions import links
    from corpusmill.operators.text_queries import prefix_pairs

    rnd = random.Random(6)
    paths = ["", "/", "//", "/a/", *("".join(rnd.choices("/ab", k=rnd.randint(0, 9))) for _ in range(150))]
    urls = [None, "x", "ftp:/a", *(f"http://{rnd.choice(['h', 'H', 'g'])}{'/' if p and p[0] != '/' else ''}{p}{rnd.choice(['', '?q=/a', '#/b'])}" for p in paths)]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, u string")
    a, b = p.alias("a"), p.alias("b")
    want = a.crossJoin(b).where(links.is_prefix_child(F.col("b.u"), F.col("a.u"))).select("a.page_id", "b.page_id")
    out = prefix_pairs(p, "u")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1000
    assert "startswith" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("spaced", [False, True])
def test_facts_of_tokens(spark, monkeypatch, spaced):
    from corpusmill.functions import tries

    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcd။" + (" }" if spaced else "")) for _ in range(rng.randint(1, 3))) for _ in range(40)})
    ids = [f"S{k % 25}" for k in range(len(words))]  # some share an id
    syllables = spark.createDataFrame(list(zip(words, ids, strict=True)), "syllable string, id string")
    paths = sorted({tuple(rng.choice(ids) for _ in range(rng.randint(1, 5))) for _ in range(900)})
    table = spark.createDataFrame([(list(p), rng.sample("nvp", rng.randint(1, 3))) for p in paths], "path array<string>, tags array<string>")
    texts = [None, "", " \n", *("".join(rng.choice("abcd။1  \n\u2003" + rng.choice(["", "{}"])) for _ in range(rng.randint(0, 80))) for _ in range(150))]
    texts += [f"{t} {t}" for t in texts[3:60]]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "id int, text string, x double")
    monkeypatch.setattr(tries, "WORDS", 20)
    want, lines, crossing = {}, {}, 0
    first, second = tries.Trie(list(zip(words, ids, strict=True))), tries.Trie((r.path, r.tags) for r in table.collect())
    for k, t in enumerate(texts):
        if t is None:
            want[k], lines[k] = (None, None), None
            continue
        surface, found = tries._pieces(t, first)
        tokens, at = [], 0
        for end, tags in tries._tokens(surface, found, second):
            tokens.append((at, end, tags))
            crossing += "".join(surface[at:end]) not in t
            at = end
        final = lambda tags: "rbvn" if sorted(tags) == ["n", "v"] else tags[0]
        counts = (len(surface), len(tokens), sum(len(g) > 1 for *_, g in tokens), sum(final(g) == "rbvn" for *_, g in tokens))
        want[k] = (*counts, " ".join(f"{''.join(surface[a:b])}{{{final(g)}}}" for a, b, g in tokens)), (*counts, " ".join("".join(x or "" for x in found[a:b]) for a, b, _ in tokens))
        lines[k] = "  ".join(surface)
    assert crossing > 20  # tokens over white space
    for most in (10**6, 0):
        monkeypatch.setattr(tries, "MOST", most)
        for n, merged in enumerate((False, True)):
            out = tries.token_facts(docs, syllables, table, merged)
            assert out.columns == ["id", "x", "facts"]
            assert {r.id: r.facts and tuple(r.facts) for r in out.collect()} == {k: w[n] for k, w in want.items()}
        assert {r.id: r.facts for r in tries.line_facts(docs, syllables).collect()} == lines


def test_upsert_holds_no_texts(spark, monkeypatch):
    from corpusmill.operators import repair_queries

    rnd = random.Random(9)
    long = ["w" * 220 + str(k) for k in range(9)]
    row = lambda k: (k, f"a{k % 3}", rnd.choice("pqrstuvw"), rnd.choice([*long, "short", None, *(f" {t}\n" for t in long)]), rnd.choice(["", "g"]), rnd.choice(["", "", *"xyz"]))
    stored = [(k, "s", f"b{k}", f"old {k}", None, "") for k in range(3)]
    arriving = [row(k) for k in range(70)] + [(70, "a", "p", "short", "", "")] * 2  # two rows that are equal in all
    kept, by_sha, by_text, by_book, tally = [], {}, {}, {}, [0, 0, 0]
    for new, rows in ((0, stored), (1, arriving)):
        for _, *r in rows:
            r = [x or "" for x in r]
            t, k = r[2].strip(), None
            if new:
                k = by_sha.get(r[4]) if r[4] else None
                k = by_text.get(t) if k is None else k
                if k is not None:
                    old = kept[k]
                    if old[2].strip() == t and (old[1] != r[1] or old[4] == r[4]):
                        tally[2] += 1
                        continue
                    r[1] = old[1]
                else:
                    k = by_book.get(r[1])
            if k is None:
                k = len(kept)
                kept.append(r)
                by_book.setdefault(r[1], k)
                tally[0] += new
            else:
                kept[k] = r
                tally[1] += 1
            if r[4]:
                by_sha[r[4]] = k
            if len(t) >= 200:
                by_text[t] = k
    schema = "seq long, author string, book string, text string, segmented string, sha256 string"
    out = repair_queries.guarded_upsert(spark.createDataFrame(stored, schema), spark.createDataFrame(arriving, schema))
    got = out.collect()
    assert sorted((r.author, r.book, r.text, r.segmented, r.sha256) for r in got) == sorted(map(tuple, kept))
    assert [sum(r[c] for r in got) for c in ("added", "replaced", "denied")] == tally and min(tally) > 0
    plan = out.select("added")._jdf.queryExecution().optimizedPlan().toString()
    assert "first(text" not in plan  # texts are only met where they are asked for


def test_fragments_by_a_shared_lexicon_and_by_joins(spark, monkeypatch):
    from corpusmill import registry
    from corpusmill.functions import tries

    run = lambda: registry.queries()["fragment_classes"](spark, "/root/testdata/sf0.001")
    exchanged = lambda df: "t3" in "".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)
    shared = run()
    assert not exchanged(shared)
    monkeypatch.setattr(tries, "MOST", 0)
    joined = run()
    assert exchanged(joined)
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, joined.collect())) != []


def test_conversion_is_one_step(spark, texts):
    from corpusmill.functions import legacy_rules

    convert = repair.convert_text(legacy_rules.RULES)
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", script.converted(F.col("t"), legacy_rules.RULES).alias("o"))
    assert {r.k: r.o for r in d.collect()} == {k: t and (convert(t) if any("က" <= c <= "႟" for c in t) else t) for k, t in enumerate(texts)}
    assert "regexp_replace" not in d._jdf.queryExecution().optimizedPlan().toString()
