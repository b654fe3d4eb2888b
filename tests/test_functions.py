"""Functions against literals worked out by hand, and repairs by their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import clusters, html, links, repair, script
from corpusmill.operators import ordered
from corpusmill.operators.repair_queries import guarded_upsert
from corpusmill.sources import sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("token,want", [("09123456789", "phone"), ("2024.12.25", "exactdate"), ("၁၃၈၆", "year"), ("၁၂၃/", "addr"), ("1500", "count")])
def test_number_class(spark, token, want):
    assert one(spark, token, script.number_class) == want


def test_structural_score(spark):
    score = lambda t: one(spark, t, clusters.structural_score)
    assert (score("abc").score, score("abc").marks, score(None).score) == (0.0, 0, 0.0)
    assert score("ိ").orphan == 1.0 and score("ကိ").orphan == 0.0
    assert score("ကးိ").disorder == 1.0 and score("ကိး").disorder == 0.0
    assert score("ကိိ").duplicate == 0.5


@pytest.mark.parametrize("text,want", [("ababab", "ab"), ("aaaa", "a"), ("abababababab", "abababababab"), ("abc", "abc")])
def test_overprint(spark, text, want):
    assert one(spark, text, script.collapse_overprint) == want


@pytest.mark.parametrize("text,want", [("一百八十一", 181), ("十", 10), ("六四", 4), ("三千零五", 3005)])
def test_chinese_numeral(spark, text, want):
    assert one(spark, text, script.chinese_numeral) == want


def test_urls(spark):
    assert one(spark, "HTTP://EX.com:80/a?b#c", links.canonical) == "http://ex.com/a?b"
    assert one(spark, "ftp://ex.com/", links.canonical) is None
    assert one(spark, "http://ex.com/?share=1", links.guard) is None
    assert one(spark, "http://ex.com?utm_x=1&a=2", links.guard) == "http://ex.com/?a=2"
    assert one(spark, "http://ex.com/a?fbclid=1&b=2", links.variants) == ["http://ex.com/a", "http://ex.com/a?b=2", "http://ex.com/a?fbclid=1&b=2"]
    assert one(spark, "https://www.x.org/a/b/c", links.ancestors) == ["/a", "/a/b", "/a/b/c"]
    assert one(spark, "https://drive.google.com/file/d/abcdefghijkl/view", links.drive_id) == "abcdefghijkl"
    assert one(spark, "https://sub.mega.nz/x", links.provider) == "mega"


def test_rate_limit_is_anchored(spark):
    out = one(spark, [10, 20, 30, 71], lambda c: ordered.rate_limit(c, 60, 2), "array<bigint>")
    assert [r.ok for r in out] == [True, True, False, True] and out[2].retry == 40


def test_greedy_chunks(spark):
    assert one(spark, [3, 3, 5], lambda c: ordered.greedy_chunks(c, 6), "array<int>") == [0, 0, 1]


def test_text_roles(spark):
    role = lambda t, blank=True: one(spark, t, lambda c: ordered.text_role(c, F.lit(blank)))
    assert [role(""), role("--- Page 3 ---"), role("Title"), role("Title", False), role("A sentence.")] == ["blank", "page_number", "heading", "paragraph", "paragraph"]


def test_repairs():
    assert repair.reorder_text("ကးိ") == "ကိး"
    assert repair.drop_impossible_text("ေို") == "ေ"
    assert repair.normalize_text("က​ိ") == "ကိ"
    assert repair.replace_imposters("သြေ်") == "ဪ"
    assert repair.repair_token("၀ါ", {"ဝါ"}) == "ဝါ" and repair.repair_token("ဝါ", {"ဝါ"}) is None
    assert repair.split_number("သဒ္ဒါ၁", {"သဒ္ဒါ"}) == ("သဒ္ဒါ", "၁")
    assert repair.split_number("၁သဒ္ဒါ", {"သဒ္ဒါ"}) == ("၁", "သဒ္ဒါ")
    assert repair.segment_text("abcab", {"ab", "abc"}, 3) == ["abc", "ab"]
    assert repair.convert_text([("a", "b"), ("b+", "c")])("aab") == "c"


def test_order_text_is_idempotent():
    rnd = random.Random(1)
    letters = "ကခဂ" + script.MARK_ORDER + " \n္a"
    for _ in range(300):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25)))
        once = repair.reorder_text(t)
        assert repair.reorder_text(once) == once


def test_formats(spark):
    toks = [("ab", ["n", "v"]), ("။", [])]
    line = one(spark, toks, sinks.tagged_format, "array<struct<surface:string,tags:array<string>>>")
    assert line == "ab{n,v}  ။"
    assert [(r.surface, r.tags) for r in one(spark, line, sinks.parse_tagged)] == [("ab", ["n", "v"]), ("။", [])]
    assert one(spark, ["a", " ", "b"], sinks.line_format, "array<string>") == "a  b"


def test_html():
    p = html.parse("<h1>T</h1><p>a <b>b</b></p><script>x</script><a href='/q'>L</a><form action='/s' method=POST><input name=z value=1></form>")
    assert p.sections[1] == ["T", ["a", "b", "L"]] and p.links == [["/q", "L"]] and p.forms == [["post", "/s", ["z=1"]]]


def test_guarded_upsert(spark):
    long = "word " * 60
    cols = "seq long, author string, book string, text string, segmented string, sha256 string"
    stored = spark.createDataFrame([(0, "", "A", long, "", "h1"), (1, "", "B", long + "b", "", "")], cols)
    new = spark.createDataFrame([
        (0, "", "C", long + "c", "", "h3"),  # new book
        (1, "", "Z", long, "", "h9"),  # the words of A under another name
        (2, "", "A", long, "", "h2"),  # A again from another file
        (3, "", "X", long + "better", "", "h3"),  # the file of C read better: its name stays
        (4, "", "S", "short", "", ""),  # too short to match by text
        (5, "", "T", "short", "", ""),
    ], cols)
    out = guarded_upsert(stored, new).collect()
    assert {(r.book, r.sha256) for r in out} == {("A", "h2"), ("B", ""), ("C", "h3"), ("S", ""), ("T", "")}
    assert (sum(r.added for r in out), sum(r.replaced for r in out), sum(r.denied for r in out)) == (3, 2, 1)
    assert next(r.text for r in out if r.book == "C") == long + "better"


def test_streaming_rate_limit(spark, tmp_path):
    from corpusmill.streaming import state

    spark.createDataFrame([("k", 10), ("k", 20), ("k", 30), ("k", 71), ("j", 5)], "k string, at long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, at long").parquet(f"{tmp_path}/in")
    q = state.anchored_rate_limit(stream, "k", 60, 2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = sorted((r.k, r.at, r.ok) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("j", 5, True), ("k", 10, True), ("k", 20, True), ("k", 30, False), ("k", 71, True)]


def test_sources(spark, tmp_path):
    from corpusmill.sources import files

    (tmp_path / "j.jsonl").write_text('{"u": "a", "c": ["b", "c"]}\n\n{"u": "torn\n')
    assert sorted((r.src, r.dst) for r in files.crawl_edges(spark, str(tmp_path / "j.jsonl")).collect()) == [("a", "b"), ("a", "c")]
    (tmp_path / "t.log").write_text("03-04 05:06:07 start all good\nnoise\n")
    row = files.timeline(spark, str(tmp_path / "t.log"), 2024).first()
    assert (row.event, row.detail, row.ts.month) == ("start", "all good", 3)
    (tmp_path / "n.txt").write_text("Anna = အန်နာ # x\nအီဗာ = Eva\nprose\n")
    assert {(r.key, r.reversed) for r in files.key_values(spark, str(tmp_path / "n.txt")).collect()} == {("Anna", False), ("Eva", True)}
    spark.createDataFrame([("b", "t")], "book string, text string").write.parquet(f"{tmp_path}/col")
    assert files.collection(spark, f"{tmp_path}/col").first().asDict() == {"author": "", "book": "b", "text": "t", "segmented": "", "sha256": ""}
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.pdf", b"abc")
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>hi</w:t><w:t> there</w:t></w:p></w:document>')
    f = files.files(spark, str(tmp_path / "a.zip"))
    assert {(r.name, r.pdf) for r in files.by_file(f, files.zip_members, files.ZIP).collect()} == {("x.pdf", True), ("word/document.xml", False)}
    assert [r.paragraph for r in files.by_file(f, files.docx_paragraphs, files.DOCX).collect()] == ["hi there"]


def test_tagger(spark):
    from corpusmill.functions import tries

    syllables = spark.createDataFrame([("က", "A001"), ("ကာ", "A002"), ("မ", "A003")], "syllable string, id string")
    paths = spark.createDataFrame([(["A002", "A003"], ["n", "v"]), (["A002"], ["n"]), (["A001"], ["p", "q"])], "path array<string>, tags array<string>")
    docs = spark.createDataFrame([(1, "ကာမ က။ {abc}၁၂"), (2, None)], "id int, text string")
    out = {r.id: r.resolved for r in tries.pipeline(docs, syllables, paths, "site").collect()}
    assert [(t.surface, t.final) for t in out[1]] == [("ကာမ", "rbvn"), ("က", "p"), ("။", "eos"), ("{abc}", "en"), ("၁", "count"), ("၂", "count")]
    assert out[2] is None
    assert tries.pipeline(docs, syllables, paths, "public").orderBy("id").first().line == "ကာ  မ  က  ။  {abc}  ၁  ၂"
    assert [len(u) for u in tries.fold_units(list("a။b။c"))] == [4, 1]


def test_splitters():
    from corpusmill.functions import splitters

    for limit in (1, 3, 7, 50):
        t = "One two. Three! Four? Five" * 3
        got = splitters.split_exactly(t, limit)
        assert "".join(got) == t and max(map(len, got)) <= limit
    assert splitters.numbers_of("1-2,5, 2") == [1, 2, 5]
    with pytest.raises(ValueError):
        splitters.numbers_of("4-2")


QUOTED = {
    '"abc" he said: "x"': ("“abc” he said: “x”", ["line start", "closes an open quote", "after a colon", "closes an open quote"]),
    '"外"里"内"': ("“外“里”内”", ["line start", "opens a nested term", "closes a nested term", "closes an open quote"]),
    '"外" 里"内"': ("“外” 里“内”", ["line start", "closes an open quote", "by default", "closes an open quote"]),
    '"外"七个字长的间隔"内"': ("“外”七个字长的间隔“内”", ["line start", "closes an open quote", "by default", "closes an open quote"]),
    '他说。"': ("他说。”", ["line end"]),
    '他说。"好': ("他说。”好", ["after a stop"]),
    '他"好"说。"走': ("他“好”说。“走", ["by default", "closes an open quote", "after narrative"]),
    '真!"好': ("真!”好", ["after a sentence"]),
    '好",走': ("好”,走", ["before punctuation"]),
    '说：",走': ("说：“,走", ["after a colon"]),
    '“"好"': ("“好”", ["doubled opening", "closes an open quote"]),
    "&quot;好&quot;": ("“好”", ["line start", "closes an open quote"]),
    '  "  ': ("  “  ", ["line start"]),
    '“好" 走"吧': ("“好” 走“吧", ["closes an open quote", "by default"]),
    '“好” 走"吧': ("“好” 走“吧", ["by default"]),
    "none": ("none", []),
    "": ("", []),
}


def test_quotes_of_lines(spark):
    from corpusmill.functions import splitters

    df = spark.createDataFrame([(k,) for k in QUOTED], "line string").select("line", splitters.repair_line(F.col("line")).alias("q"))
    for r in df.collect():
        text, reasons = QUOTED[r.line]
        assert (r.q.text, [c.reason for c in r.q.changes]) == (text, reasons), r.line
        assert all(r.line[c.column - 1] in '"&' for c in r.q.changes)
    whole = "\n".join(QUOTED)
    r = spark.createDataFrame([(whole,), (None,), ("",)], "t string").select(splitters.quote_repair(F.col("t")).alias("q")).collect()
    assert r[0].q.text == "\n".join(x for x, _ in QUOTED.values()) and r[0].q.changes == sum(len(x) for _, x in QUOTED.values())
    assert [(x.q.text, x.q.changes) for x in r[1:]] == [("", 0), ("", 0)]


def test_shapes():
    import numpy as np

    from corpusmill.functions import shapes

    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    assert shapes.area(square) == 4 and len(shapes.resample(square, 16)) == 16
    mask = np.zeros((5, 5), bool)
    mask[2, 2] = True
    field = shapes.distance_field(mask)
    assert field[2, 4] == 2 and abs(field[0, 0] - 2 * 2**0.5) < 1e-9 and field[1, 0] == pytest.approx(1 + 2**0.5)
    assert (shapes.distance_field(np.stack([mask, mask.T])) == np.stack([field, shapes.distance_field(mask.T)])).all()


def test_mends_and_suggestions():
    assert repair.faults("ကိ") == 0 and repair.faults("ိက") == 1
    assert repair.cluster_spans("ကိ မ") == [(0, 2), (3, 4)]
    assert repair.without_one_i("ကို") == ["ကု"]
    assert "ကိ" in repair.insertions("က")
    assert repair.fragment_class("b", ["a"], {"ab"}) == "unit" and repair.fragment_class("zz", [], set()) == "loan"
    assert repair.better_reading({"score": 0.5, "marks": 80, "faults": 9}, {"score": 0.9, "marks": 80, "faults": 1})


def test_pdf_pages(spark, tmp_path):
    import zlib

    from corpusmill.sources import files, pdf

    content = zlib.compress(b"BT /F1 12 Tf 10 700 Td (Hello) Tj ( world) Tj 0 -20 Td [<0102> -300 <03>] TJ ET")
    cmap = b"beginbfchar <01> <0041> endbfchar beginbfrange <02> <03> <1000> endbfrange"
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj",
        b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj",
        b"3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F2 5 0 R >> >> >> endobj",
        b"4 0 obj << /Filter /FlateDecode >> stream\n" + content + b"\nendstream endobj",
        b"5 0 obj << /Type /Font /ToUnicode 6 0 R >> endobj",
        b"6 0 obj << >> stream\n" + cmap + b"\nendstream endobj",
        b"7 0 obj << /Title (A \\(b\\)) /Author <FEFF1000> >> endobj",
    ]
    raw = b"%PDF-1.4\n" + b"\n".join(parts)
    (tmp_path / "a.pdf").write_bytes(raw)
    got = files.by_file(files.files(spark, str(tmp_path / "a.pdf")), pdf.pages, pdf.PAGES).collect()
    assert len(got) == 1 and got[0].text.split("\n")[0] == "Hello world" and got[0].lines[0].size == 12
    assert pdf.Pdf(raw).info() == {"Title": "A (b)", "Author": "က"}
    assert pdf.character_map(cmap) == {1: "A", 2: "က", 3: "ခ"}
    assert pdf.shown(b"\x01\x02\x03", pdf.character_map(cmap)) == "Aကခ"


@pytest.mark.parametrize("most", [10**6, 0])
def test_containment_both_ways(spark, most):
    from corpusmill.operators.corpus import contained

    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "nothing of it"), (3, None), (4, "a quick brown fox runs")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox"), (8, "brown fox jumps"), (9, "not there at all")], "item_id long, needle string")
    assert sorted(tuple(r) for r in contained(docs, items, most=most).collect()) == [(7, 1), (7, 4), (8, 1)]


def test_grammar_rules(spark):
    from corpusmill.operators import grammar

    rows = [("s", 0, "သူ", ["pn"]), ("s", 1, "စာအုပ်", ["n"]), ("s", 2, "များ", []), ("s", 3, "ဖတ်", ["v"]), ("s", 4, "မည်", [])]
    tokens = spark.createDataFrame(rows, "sentence string, k int, text string, tags array<string>")
    hits = {r.k: {h.id for h in r.hits} for r in grammar.classify(tokens).collect()}
    assert hits[0] == {"pronoun-11c"} and hits[4] == {"tense-24c"} and "verb-16" in hits[3]
    assert {"noun-7b", "noun-15", "number-19b", "gender-17c"} <= hits[1] and "number-19a" not in hits[1]
    best = {r.k: r.module for r in grammar.resolve(grammar.classify(tokens)).collect()}
    assert best[3] == "verb" and best[4] == "tense"
    s = grammar.sentence_types(tokens.union(spark.createDataFrame([("q", 0, "လား", [])], tokens.schema))).collect()
    assert {r.sentence: (r.meaning, r.construction) for r in s} == {"s": ("statement", "simple"), "q": ("question", "simple")}


def test_clusters_equal_the_plain_versions(spark):
    rnd = random.Random(1)
    chars = "ကခဥဧအဣ" + script.MARK_ORDER + "္" + " \n" + "aေေြြိုံ\u200b"
    texts = ["", " ", "ေ", "ေက", "aေြက ိက"] + ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    assert clusters.ordered(texts, repair.GLUE) == [repair.order_text(t) for t in texts]
    rows = spark.createDataFrame([(0, None), (1, "ြေက"), (2, "")], "k int, t string").select("k", clusters.order_column(repair.GLUE)("t").alias("t")).collect()
    assert {r.k: r.t for r in rows} == {0: None, 1: repair.order_text("ြေက"), 2: ""}


def test_walks_go_to_their_end(spark):
    from corpusmill.operators import graph

    n = 210
    chain = spark.createDataFrame([(k, [f"k{k}", f"k{k + 1}"]) for k in range(n)] + [(1000, None), (1001, [None])], "row long, keys array<string>")
    got = {r.row: r.group for r in graph.connected(chain).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1001}
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "src long, dst long")
    far = graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()
    assert {r.node: r.depth for r in far} == {k: k for k in range(31)}
