"""Templates against hand-made sentences and a plain walk."""

import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import templates as T

SF = "/root/testdata/sf0.001"
HAND = {
    "သွား{v} သည် ။": ("msp-01", None, "သွား", []),
    "အိမ်{n} ။": ("msp-02", "msp-02", None, None),
    "စာ{n} ဖတ်{v} သည်": ("msp-03", None, "ဖတ်", [("စာ", None, None, False)]),
    "အိမ်{n} ၌ နေ{VERBS} သည်": ("msp-04", None, "နေ", [("အိမ်", "၌", "place", False)]),
    "ကျောင်းသား{n} တည်း": ("msp-05", "msp-05", None, None),
    "သူ{pn} က အိမ်{n} မှ လာ{v} တယ်": ("msp-06", None, "လာ", [("အိမ်", "မှ", "source", False), ("သူ", "က", "subject", False)]),
    "အိမ်{n} မှ သူ{pn} က လာ{v} တယ်": ("msp-07", None, "လာ", [("သူ", "က", "subject", False), ("အိမ်", "မှ", "source", True)]),
    "သွား{v}": (None, None, None, None),
    "သွား{v} လား": ("msp-01", None, "သွား", []),
    "<EOS> ။": (None, None, None, None),
    "": (None, None, None, None),
    None: (None, None, None, None),
}


def plain_tokens(line):
    reg = {e.word: e for e in T.register()}
    out = []
    for part in (line or "").split():
        m = re.match(r"^(.+?)\{([^}]+)\}$", part)
        word, tag = m.groups() if m else (part, "")
        if tag in ("eos", "pan") or word == "<EOS>" or re.fullmatch("[။၊!?]+", word):
            out.append((word, "boundary", False, None, None))
        elif word in reg:
            out.append((word, "particle", False, reg[word].type, reg[word].style))
        else:
            family = T.NAMES.get(tag.upper()) or ("pronoun" if word in T.ASKING else None) or T.CODES.get(tag) or "noun"
            out.append((word, family, family == "verb" or (not tag and word not in T.ASKING), None, None))
    return out


def plain(line):
    """The walk one token at a time: template, anchored, classification, verb, arguments, nouns."""
    toks = plain_tokens(line)
    while toks and toks[-1][1] == "boundary":
        toks.pop()
    if not toks:
        return None, None, "empty", None, None, None
    is_noun = lambda t: t[1] in ("noun", "pronoun")
    k, last = len(toks) - 1, toks[-1]
    nouns = [t[0] for t in toks[:-1] if is_noun(t)]
    said = lambda: f"Ls-{last[4] or 'N'}.Fof-Fs.St-c"
    if last[1] != "particle":
        return ("msp-02", "msp-02", said(), None, None, nouns) if is_noun(last) else (None, None, "unknown", None, None, None)
    while k >= 0 and toks[k][1] == "particle":
        k -= 1
    if last[0].endswith(T.NOUN_ENDS):
        return ("msp-05", "msp-05", said(), None, None, nouns) if k >= 0 and is_noun(toks[k]) else (None, None, "unknown", None, None, None)
    if k < 0 or not toks[k][2]:
        return None, None, "unknown", None, None, None
    verb, args, mark = toks[k][0], [], None
    for j in range(k - 1, -1, -1):
        if toks[j][1] == "particle":
            continue
        if not is_noun(toks[j]) or len(args) == T.MOST_ARGUMENTS:
            break
        mark = toks[j + 1] if toks[j + 1][1] == "particle" else None
        args.append((toks[j][0], mark and mark[0], T.ROLES.get(mark[3]) if mark else None))
    roles = [a[2] for a in args]
    if "subject" in roles:
        name = "msp-07" if roles[-1] not in (None, "subject") else "msp-06"
    elif roles[:1] == ["place"] and last[0].endswith(T.STATEMENT_ENDS):
        name = "msp-04"
    else:
        name = "msp-03" if args else "msp-01"
    return name, None, said(), verb, [(*a, name == "msp-07" and i == len(args) - 1) for i, a in enumerate(args)], None


def ours(p):
    args = None if p.arguments is None else [(a.noun, a.particle, a.role, a.topic) for a in p.arguments]
    return p.template, p.anchored, p.classification, p.verb, args, p.nouns


@pytest.mark.parametrize("extra", [(), ("mill", "line", "parsed")])
def test_hand_made(spark, extra):
    rows = [(x, *["clash"] * len(extra)) for x in HAND for _ in range(2)]
    got = T.parse(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("text", *extra))), "text").collect()
    assert len(got) == 2 * len(HAND)
    for r in got:
        p = ours(r.parsed)
        assert (p[0], p[1], p[3], p[4]) == HAND[r.text], r.text
        assert p == plain(r.text)


def test_lines_of_all_texts(spark):
    rows = T.parse(T.tagged_lines(spark, SF), "text").collect()
    found = {r.parsed.template for r in rows}
    assert found == {None, *T.INHERITS} and len(rows) > 300
    for r in rows:
        assert ours(r.parsed) == plain(r.text), r.text


def test_register_is_a_parameter(spark):
    one = (T.Entry("zu", "wibat", "noun", "subject_marker", "E"), T.Entry("end", "pyitsi", "verb", "question_marker", "E"))
    d = spark.createDataFrame([("a{n} zu go{v} end",)], "text string")
    p = T.parse(d, "text", one).first().parsed
    assert (p.template, p.style, p.closing, p.inherits) == ("msp-06", "E", ["end"], [])
    assert T.parse(d, "text", ()).first().parsed.template == "msp-02"


def test_register_styles():
    styles = {e.word: e.style for e in T.register()}
    assert {w for w, s in styles.items() if s == "E"} == set(T.WRITTEN) and len(styles) == len(T.register())


def test_braces(spark):
    odd = ["a{n}b{v}", "a{b{v}", "{n}", "a{}", "a}{v}", "a{x}y}", "a{n", "a}", "{{v}", "a{ADV}", "a{adv}", "a{Verbs}", "ဘာ{v}", "ဘာ{verbs}", "က{eos}", "?!", "?a", "က{zz}"]
    d = spark.createDataFrame([(x,) for x in odd], "text string").select("text", T.tokens(F.col("text")).alias("t"))
    for r in d.collect():
        assert [(t.word, t.family, t.verb, t.type, t.style) for t in r.t] == plain_tokens(r.text), r.text


def test_empty_and_long(spark):
    assert T.parse(spark.createDataFrame([], "text string"), "text").count() == 0
    long = "a{n} က " * 60_000 + "go{v} သည်"
    assert ours(T.parse(spark.createDataFrame([(long,)], "text string"), "text").first().parsed) == plain(long)


def test_tokens_query(spark):
    got = {(r.family, r.category, r.type, r.style): (r.tokens, r.may_be_verb) for r in T.template_tokens(spark, SF).collect()}
    want, reg = {}, {e.word: e for e in T.register()}
    for r in T.tagged_lines(spark, SF).collect():
        for w, f, v, type_, style in plain_tokens(r.text):
            key = (f, reg[w].category if f == "particle" and w in reg else None, type_, style)
            n, m = want.get(key, (0, 0))
            want[key] = n + 1, m + v
    assert got == want
