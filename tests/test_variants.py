"""Normaliser variants, legacy layouts and readings against plain walks; files in memory by round trips."""

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill import registry
from corpusmill.functions import clusters, layout, legacy_rules, repair, script
from corpusmill.functions.tries import surface_class
from corpusmill.sources import files, pdf, writers

SF = "/root/testdata/sf0.001"
md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
KINDS = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", script.DIGITS)


def strings(seed, letters, n=1500, most=14):
    rnd = random.Random(seed)
    return ["", *("".join(rnd.choices(letters, k=rnd.randint(1, most))) for _ in range(n))]


def column(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", f(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.k)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("raw"), script.as_myanmar(F.coalesce("text", F.lit(""))).alias("t")).collect()
    return {r.doc_id: (r.t, r.raw) for r in rows}


def blocks(t, wrap):
    """A walk over the text: from a letter or digit on, its kind and punctuation belong to the block."""
    out, k = "", 0
    while k < len(t):
        kind = next((x for x in KINDS if t[k] in x), None)
        end = k + 1
        if kind is None:
            out += t[k]
        else:
            while end < len(t) and (t[end] in kind or t[end] in ",.:;/()-!? "):
                end += 1
            block = re.sub(" +", " ", t[k:end])
            out += ("{" + block.rstrip(" ") + "}" if wrap else "") + (" " if block.endswith(" ") else "")
        k = end
    return out


def in_turn(t):
    for k in sorted(layout.IMPOSTERS, key=len, reverse=True):
        t = layout.IMPOSTERS[k].join(t.split(k))
    return t


def engine(t):
    return in_turn(repair.reorder_text("".join(c for c in unicodedata.normalize("NFC", t) if c not in layout.GLUE)))


def deletion(t):
    return repair.reorder_text(in_turn(blocks(unicodedata.normalize("NFC", t), False)))


def digits(t):
    """Character by character, each seeing what was decided before it; the second turn in three passes."""
    word = lambda c: bool(c) and re.match("[က-အဥဧ္" + script.MARK_ORDER + "]", c) is not None
    digit = lambda c: bool(c) and c in script.DIGITS
    s = list(t)
    for k, c in enumerate(s):
        before, after = s[k - 1] if k else "", s[k + 1] if k + 1 < len(s) else ""
        consonant = bool(after) and "က" <= after <= "အ"
        if c == "၀" and ((after and after in script.MARK_ORDER) or (word(before) and word(after)) or (not digit(before) and not word(before) and consonant)):
            s[k] = "ဝ"
    for _ in range(3):
        for k, c in enumerate(s):
            before, after = s[k - 1] if k else "", s[k + 1] if k + 1 < len(s) else ""
            if c == "ရ" and (digit(before) or digit(after)) and (not word(after) or after == "ရ"):
                s[k] = "၇"
    return "".join(s)


def drawn(t):
    for pattern, by in layout.LAYOUT_RULES:
        t = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", by), t)
    return digits(t)


def test_blocks(spark):
    some = strings(1, "ab1၂,.-  ?က\n", most=18)
    assert column(spark, some, layout.wrap_blocks) == [blocks(t, True) for t in some]
    assert column(spark, some, layout.delete_blocks) == [blocks(t, False) for t in some]
    assert column(spark, ["God of  Slaughter က", None, "(၁)"], layout.wrap_blocks) == ["{God of Slaughter} က", None, "({၁)}"]


def test_digit_letters(spark):
    some = strings(2, "၀၀ရရရ၁၇ကဥာ္ x", 6000, 9)
    assert column(spark, some, layout.digit_letters) == [digits(t) for t in some]
    assert column(spark, ["ရရရရ၁", "၁ရရက", None], layout.digit_letters) == ["ရ၇၇၇၁", "၁၇ရက", None]


def test_legacy_layout(spark):
    some = strings(3, ["ေ", "ြ", "က", "င", "င်္", "္ခ", "ျ", "ိ", "၀", "ရ", " ", "ဥ", "ီး", "​"], 4000, 9)
    assert column(spark, some, layout.legacy_layout) == [drawn(t) for t in some]


def test_normalisers(spark):
    some = strings(4, [*script.MARK_ORDER, *"ကသဥဉ  \n{}#", "a", "é", "é", "1", "​", *layout.IMPOSTERS], 3000, 10)
    assert column(spark, some, layout.engine_normalise) == [engine(t) for t in some]
    assert column(spark, some, layout.mapper_normalise) == [blocks(engine(t), True) for t in some]
    assert column(spark, some, layout.deletion_normalise) == [deletion(t) for t in some]
    assert column(spark, ["က.က!", None], lambda t: layout.engine_normalise(t, True)) == ["ကက", None]
    assert layout.normaliser("My-Normalize") is layout.deletion_normalise and layout.normaliser(None) is layout.normaliser("none") is None
    with pytest.raises(ValueError):
        layout.normaliser("other")


def test_queries_of_normalisers_and_layouts(spark, texts):
    run = lambda name: registry.queries()[name](spark, SF).collect()
    halves = {d: f"{t} {raw[::-1]}" for d, (t, raw) in texts.items()}
    assert {r.doc_id: (r.normalize, r.mynormalize, r.mapper) for r in run("normaliser_modes")} == {d: (md5(engine(t)), md5(deletion(t)), md5(blocks(engine(t), True))) for d, t in halves.items()}
    assert {r.doc_id: r.digest for r in run("digit_letters")} == {d: md5(digits(t.translate(str.maketrans("တစ", "ရ၀")))) for d, (t, _) in texts.items()}
    assert {r.doc_id: r.digest for r in run("legacy_layouts")} == {d: md5(drawn(t)) for d, (t, _) in texts.items()}
    lines = {}
    for t, _ in texts.values():
        for line in re.split("\r\n|\r|\n", t):
            h = md5(blocks(engine(line), True))
            lines[h] = lines.get(h, 0) + 1
    assert {r.digest: r.n for r in run("normalised_scan")} == lines


def test_chosen_readings(spark, texts):
    convert = repair.convert_text(legacy_rules.RULES)
    want = {}
    for d, (t, _) in texts.items():
        own = t[::-1] if d % 3 == 0 else t
        kinds = {"own": own, "converted": convert(own) if re.search("[က-႟]", own) else own, "reversed": own[::-1]}
        scores = {}
        for kind, x in kinds.items():
            c = clusters.counts([repair.order_text(x)])
            at = lambda a, b: c[a][0] / max(c[b][0], 1)  # noqa: B023, E731
            scores[kind] = (1 - max(at("orphans", "marks"), at("disorder", "pairs")) if c["marks"][0] else 0.0, int(c["marks"][0]))
        best = max(("converted", "reversed"), key=lambda k: (scores[k][0], k == "converted"))
        kind = best if scores["own"][1] >= 50 and round(scores[best][0] - scores["own"][0], 12) >= 0.03 else "own"
        want[d] = (kind, md5(kinds[kind]), round(scores[kind][0], 9))
    got = {r.doc_id: (r.kind, r.digest, r.score) for r in registry.queries()["chosen_readings"](spark, SF).collect()}
    assert got == want and len({k for k, *_ in got.values()}) > 1


def test_readings_without_one_in_hand(spark):
    good, bad = "ကို " * 60, "xိုx " * 60
    rows = [(1, 0, "a", bad), (1, 1, "b", good), (2, 1, "b", bad), (2, 2, "c", good), (3, 0, "a", None), (3, 1, "b", good), (4, 0, "a", good), (4, 1, "b", good)]
    found = layout.choose_readings(spark.createDataFrame(rows, "doc_id int, place int, kind string, text string")).collect()
    assert {r.doc_id: r.kind for r in found} == {1: "b", 2: "c", 3: "a", 4: "a"}


def test_pages(spark):
    some = ["<html>", " <!-- a --> <P>", "﻿<!DOCTYPE HTML>", "<!-- never closed", "text <p>", "", None, "<!-- a --> text", "%PDF-1.4", "<b>"]
    assert column(spark, some, layout.looks_like_page) == [True, True, True, True, False, False, False, False, False, False]


def test_written_files_are_read_again():
    odd = ["က 1 <&>", "", "x\ty", "\U0001f600 ok"]
    assert [p for _, p in files.docx_paragraphs(writers.docx_bytes(odd))] == odd
    made = writers.pdf_bytes([["က (a) \\", "b", "\U0001f600"], ["c"]], "A က")
    assert [t for *_, t in pdf.pages(made)] == ["က (a) \\\nb\n\U0001f600", "c"] and dict(pdf.metadata(made)) == {"Title": "A က"}
    assert list(pdf.pages(writers.pdf_bytes([]))) == []
    found = list(files.zip_members(writers.zip_bytes([("a/b.PDF", b"xx"), ("c", b"")])))
    assert [(n, s, p) for n, s, _, p in found] == [("a/b.PDF", 2, True), ("c", 0, False)]
    assert list(files.docx_paragraphs(writers.docx_bytes([]))) == []


def test_json_is_in_order(spark, tmp_path):
    from corpusmill.sources import sinks

    sinks.write_json_in_order(spark.range(1000).selectExpr("(id * 389) % 1000 as id").repartition(5), "id", f"{tmp_path}/m")
    found = [int(re.search(r"\d+", x)[0]) for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().split()]
    assert found == list(range(1000))


def test_engine_by_signature(spark, texts):
    import zlib

    seen = {}
    for t, _ in texts.values():
        for s in {t[k : k + n] for k in range(len(t)) for n in (1, 2)}:
            if re.fullmatch("[က-႟]{1,2}", s):
                seen[s] = seen.get(s, 0) + 1
    ids = {s: "S" + s.encode().hex().upper() for s, n in seen.items() if n >= 3}
    tags = lambda i: (["n"], ["v"], ["n", "v"], ["p", "q"])[zlib.crc32(i.encode()) % 4]
    lines, sites, merged = {}, {}, {}
    for d, (t, _) in texts.items():
        pieces, k = [], 0
        while k < len(t):
            end = t.find("}", k) + 1 if t[k] == "{" else 0
            n = end - k if end else next((n for n in (2, 1) if len(t[k : k + n]) == n and t[k : k + n] in ids), 1)
            if not t[k].isspace():
                pieces.append(t[k : k + n])
            k += n if not t[k].isspace() else 1
        tokens, k = [], 0
        while k < len(pieces):
            i = ids.get(pieces[k])
            if pieces[k] == "။":
                found, n = ["eos"], 1
            elif i is None:
                found, n = [surface_class(pieces[k])], 1
            elif k + 1 < len(pieces) and ids.get(pieces[k + 1]) == i:
                found, n = ["r"], 2
            else:
                found, n = tags(i), 1
            tokens.append(("".join(pieces[k : k + n]), "".join(ids.get(p, "") for p in pieces[k : k + n]), found, n))
            k += n
        final = lambda f: "rbvn" if set(f) == {"n", "v"} else f[0]
        lines[d] = md5("  ".join(pieces))
        sites[d] = (len(tokens), sum(len(f) > 1 for _, _, f, _ in tokens), md5(" ".join(f"{s}{{{final(f)}}}" for s, _, f, _ in tokens)))
        merged[d] = (len(pieces), len(tokens), md5(" ".join(i for _, i, _, _ in tokens)))
    run = lambda name: registry.queries()[name](spark, SF).collect()
    assert {r.doc_id: r.digest for r in run("engine_public")} == lines
    assert {r.doc_id: (r.tokens, r.ambiguous, r.digest) for r in run("engine_site")} == sites
    assert {r.doc_id: (r.ids, r.merged, r.digest) for r in run("engine_debugger")} == merged


def test_particles(spark):
    from corpusmill.operators import particles

    rows = [("a", 0, "သူ", ["n"]), ("a", 1, "က", None), ("a", 2, "စား", ["v"]), ("a", 3, "သည်", []), ("b", 0, "မနေ့က", []), ("b", 1, "စား", ["v"]), ("b", 2, "သည်", []), ("b", 3, None, None), ("c", 0, "၅", ["num"]), ("c", 1, "ခု", []), ("c", 2, "ပင်", []), ("d", 0, "က", [])]
    tokens = spark.createDataFrame(rows, "sentence string, k int, text string, tags array<string>")
    got = {(r.sentence, r.k, r.scope) for r in particles.classify(tokens, sets={"classifier": ("ခု",)}).collect()}
    assert got == {("a", 1, "subject_marker"), ("a", 3, "present_tense"), ("b", 2, "past_tense"), ("c", 1, "classifier"), ("c", 2, "focus_emphasis")}
    assert particles.classify(tokens.where("false")).count() == 0


def test_targets_of_a_page():
    from corpusmill.functions.controls import targets

    page = """<base href="/b/"><a href="x.pdf"> A <i>b</i></a><a href="#top">top</a><form action="f.docx"><input type=submit formaction="g.docx" title="T"><a href="y">in <a>form</form>
    <button onclick="open('h.pdf', &quot;i.pdf&quot;)">Go</button><div data-x="j.pdf"/><img src="k.pdf"> https:\\/\\/mega.nz/f.)"""
    found = [(c["url"], c["label"], c["kind"]) for c in targets(page, "http://h.example/p?q=1")]
    assert [f[0] for f in found] == [*(f"http://h.example/b/{x}" for x in ("x.pdf", "f.docx", "g.docx", "y", "h.pdf", "i.pdf", "j.pdf")), "https://mega.nz/f"]
    assert found[0] == ("http://h.example/b/x.pdf", "A b", "anchor") and found[2][1:] == ("T", "attribute") and found[4][1:] == ("Go", "code") and found[-1][2] == "plain"
    assert targets(None, None) == [] and targets("<a href='http://[bad'>x</a>", "http://h/")[1:] == []


def test_clauses_and_order(spark):
    from corpusmill.operators import clauses

    rows = [("s", 0, "က", []), ("s", 1, "a", ["n"]), ("s", 2, "b", ["v"]), ("s", 3, "ကို", []), ("s", 4, "c", ["n"]), ("s", 5, "က", []), ("s", 6, "d", ["v"]), ("s", 7, "မှာ", []), ("e", 0, None, None)]
    t = spark.createDataFrame(rows, "sentence string, k int, text string, tags array<string>")
    assert sorted((r.first, r.last, r.particle) for r in clauses.clauses(t, clauses.ENDS["noun"]).collect()) == [(0, 3, "ကို"), (4, 7, "မှာ")]
    assert clauses.clauses(t, clauses.ENDS["adverb"]).count() == 0
    more = [("p", 0, "x", ["n"]), ("p", 1, "သော", []), ("p", 2, "y", ["v"]), ("p", 3, "တွင်", []), ("p", 4, "z", ["n"]), ("p", 5, "သော", [])]
    t = t.union(spark.createDataFrame(more, t.schema))
    found = {(r.sentence, r.k, r.rule, r.right, r.wanted, r.distance) for r in clauses.word_order(t).collect()}
    assert found == {("s", 5, 207, True, None, None), ("p", 1, 208, False, "z", 3), ("p", 3, 209, False, None, None)}
