"""Tokens of tagged lines by a register of particles, and sentence templates walked from the right.

A line is ``word{tag} word ...``.  The register is a parameter, a list of ``Entry``; the default follows
from the rules of particles and conjunctions.  Everything is an expression over a line's array of tokens,
so nothing is exchanged and nothing calls Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, load
from .particles import CASES, SETS, SUFFIXES, WORDS

C = Catalog()
MOST_ARGUMENTS = 5  # places of the longest template


@dataclass(frozen=True)
class Entry:
    """``style`` is E (written only), N (spoken only) or BOTH."""

    word: str
    category: str
    family: str
    type: str
    style: str = "BOTH"


# Question particles of the written style only, endings of a noun sentence and of a statement.
WRITTEN = ("နည်း", "လော", "စ")
NOUN_ENDS = ("သာတည်း", "တည်း")
STATEMENT_ENDS = ("သည်", "တယ်", "ပြီ", "မည်", "လိမ့်မည်")
# Words that ask, which are pronouns whatever their code.
ASKING = ("ဘယ်သူ", "မည်သူ", "ဘယ်", "မည်မျှ", "ဘယ်နှယောက်", "ဘယ်တော့", "မည်သည့်", "ဘာ")
# Families by a tag's name (any case) or its code.
NAMES = {"VERBS": "verb", "NOUNS": "noun", "PRONOUNS": "pronoun", "NUMBERS": "number", "ADJS": "adjective", "ADJ": "adjective", "ADVS": "adverb", "ADV": "adverb"}
CODES = {"n": "noun", "v": "verb", "pn": "pronoun", "dj": "adjective", "ps": "particle", "wi": "particle", "cj": "particle", "num": "number", "adv": "adverb"}
# A particle's type tells the role of the noun before it.
ROLES = {"subject_marker": "subject", "object_marker": "object", "ablative_source": "source", "directional_toward": "goal", "locative": "place"}
#: Templates that a template takes over, nearest last.
INHERITS = {"msp-01": (), "msp-02": (), "msp-03": ("msp-01",), "msp-04": ("msp-01", "msp-03"), "msp-05": (), "msp-06": (), "msp-07": ("msp-06",)}


def register() -> tuple[Entry, ...]:
    """Case particles, suffixes and conjunctions; of a word's several meanings the first one."""
    rows = [Entry(w, "wibat", "noun" if "n" in r.before else "verb", r.scope) for r in CASES for w in r.forms(WORDS)]
    rows += [Entry(w, "pyitsi", "noun" if set(r.before) & {"n", "num"} else "verb", r.scope) for r in SUFFIXES for w in r.forms(WORDS)]
    rows += [Entry(w, "wibat", "verb", kind) for kind in ("present_past", "future") for w in SETS[kind]]
    rows += [Entry(w, "pyitsi", "verb", "sentence_final") for w in NOUN_ENDS]
    rows += [Entry(w, "thanbanda", "sentence", kind) for kind in ("adversative", "temporal", "purposive", "causal", "conditional") for w in SETS[kind]]
    rows += [Entry(w, "pyitsi", "verb", "question_marker", "E") for w in WRITTEN]
    first: dict[str, Entry] = {}
    for e in rows:
        first.setdefault(e.word, Entry(e.word, e.category, e.family, e.type, "E" if e.word in WRITTEN else e.style))
    return tuple(first.values())


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _light(line: Column, entries: tuple[Entry, ...]) -> Column:
    """``array<struct<word, family>>``: ``known`` is a particle of the register, ``open`` a word without a tag.

    One step after another, so that each value of a token is computed once.
    """
    known = [e.word for e in entries]
    parts = F.filter(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda w: w != "")

    def read(w: Column) -> Column:
        head, tail = F.substring_index(w, "{", 1), F.substring_index(w, "{", -1)
        single = F.length(head) + F.length(tail) + 1 == F.length(w)
        # with one brace the tag is what it opens; the pattern decides where there are more
        tag = F.when((head != "") & (F.locate("}", tail) == F.length(tail)), F.left(tail, F.length(tail) - 1)).otherwise("")
        return F.struct(w.alias("part"), F.when(~w.endswith("}"), "").when(single, tag).otherwise(F.regexp_extract(w, r"^.+?\{([^}]+)\}\z", 1)).alias("tag"))

    def cut(t: Column) -> Column:
        return F.struct(F.when(t["tag"] == "", t["part"]).otherwise(F.left(t["part"], F.length(t["part"]) - F.length(t["tag"]) - 2)).alias("word"), t["tag"].alias("tag"))

    def family(t: Column) -> Column:
        word, tag = t["word"], t["tag"]
        asks = word.isin(*ASKING)
        edge = tag.isin("eos", "pan") | (word == "<EOS>") | (F.left(word, F.lit(1)).isin("။", "၊", "!", "?") & word.rlike(r"^[။၊!?]+\z"))
        codes = {k: v for k, v in CODES.items() if k.upper() not in NAMES}
        of_tag = F.when(tag == "", F.when(asks, "pronoun").otherwise("open")).when(tag.isin(*codes), F.when(asks, "pronoun").otherwise(_lookup(tag, codes))).otherwise(F.coalesce(_lookup(F.upper(tag), NAMES), F.when(asks, "pronoun"), F.lit("noun")))
        return F.struct(word.alias("word"), F.when(edge, "boundary").when(word.isin(*known) if known else F.lit(False), "known").otherwise(of_tag).alias("family"))

    return F.transform(F.transform(F.transform(parts, read), cut), family)


def _about(t: Column, entries: tuple[Entry, ...]) -> Column:
    """``struct<category, type, style>`` of a particle of the register, else null."""
    if not entries:
        return F.lit(None).cast("struct<category:string,type:string,style:string>")
    rows = F.create_map(*[x for e in entries for x in (F.lit(e.word), F.struct(*[F.lit(getattr(e, n)).alias(n) for n in ("category", "type", "style")]))])
    return F.when(t["family"] == "known", F.element_at(rows, t["word"]))


def tokens(line: Column, entries: tuple[Entry, ...] | None = None) -> Column:
    """``array<struct<word, family, noun, verb, category, type, style>>`` of a tagged line.

    Marks of the end and punctuation are of family ``boundary``.  A word of the register is a particle
    whatever its tag; others trust their tag, and without one may be noun or verb.  Null: no tokens.
    """
    entries = register() if entries is None else entries
    told = F.transform(_light(line, entries), lambda t: F.struct(t["word"].alias("word"), t["family"].alias("family"), _about(t, entries).alias("about")))

    def token(t: Column) -> Column:
        fam = t["family"]
        named = F.when(fam == "known", "particle").when(fam == "open", "noun").otherwise(fam)
        return F.struct(t["word"].alias("word"), named.alias("family"), fam.isin(*_NOUN).alias("noun"), fam.isin(*_VERB).alias("verb"), *[t["about"][n].alias(n) for n in ("category", "type", "style")])

    return F.transform(told, token)


_NOUN, _VERB, _PARTICLE = ("noun", "pronoun", "open"), ("verb", "open"), ("known", "particle")


def parse(lines: DataFrame, line: str, entries: tuple[Entry, ...] | None = None) -> DataFrame:
    """Adds ``parsed``: ``template, anchored, style, classification, verb, closing, arguments, nouns, inherits``.

    ``anchored`` is the template whose last place the last token itself takes, so only the two noun
    templates can be.  ``template`` also lets verb templates pass the particles that close a sentence;
    of those that fit, the one with most told about it: a place in front of the subject (07), a subject
    (06), a place marked before the verb of a statement (04), any noun (03), the verb alone (01).
    Arguments stand from the verb to the left, each with the particle behind it and its role, at most as
    many as the longest template has; a verb or a boundary ends them.  Without tokens the classification
    is ``empty``, without a template ``unknown``.  Null and empty lines: no tokens.  Rows are taken one
    by one, so repeated rows and ids get a result each; a column named ``parsed`` is replaced.
    """
    none = F.lit(None).cast("string")
    entries = register() if entries is None else entries
    t = F.reverse(_light(F.col(line), entries))
    d = lines.select("*", t.alias("mill_all"))
    start = F.coalesce(F.nullif(F.array_position(F.transform("mill_all", lambda x: x["family"] != "boundary"), True), F.lit(0)), F.size("mill_all") + 1)
    d = d.withColumn("mill_t", F.slice("mill_all", start.cast("int"), F.greatest(F.size("mill_all"), F.lit(1))))
    # numbered content words from the right; a particle is found again by its place
    content = F.filter(F.transform("mill_t", lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda c: ~c["x"]["family"].isin(*_PARTICLE))
    d = d.withColumn("mill_c", F.slice(content, 1, MOST_ARGUMENTS + 1))
    last, head = F.try_element_at("mill_t", F.lit(1)), F.try_element_at("mill_c", F.lit(1))
    rest = F.slice("mill_c", 2, MOST_ARGUMENTS)
    stop = F.coalesce(F.nullif(F.array_position(F.transform(rest, lambda c: c["x"]["family"].isin(*_NOUN)), False), F.lit(0)), F.size(rest) + 1)
    behind = lambda c: F.element_at("mill_t", c["at"].cast("int"))  # noqa: E731  # place ``at`` counts from 0, so this is one to the right
    marked = lambda c: F.when(behind(c)["family"].isin(*_PARTICLE), behind(c))
    args = F.transform(F.slice(rest, 1, (stop - 1).cast("int")), lambda c, i: F.struct((i + 1).alias("slot"), c["x"]["word"].alias("noun"), marked(c)["word"].alias("particle"), _lookup(F.coalesce(_about(behind(c), entries)["type"], F.lit("")), ROLES).alias("role")))
    d = d.select("*", args.alias("mill_args"), last.alias("mill_last"), head.alias("mill_head"))
    closed = F.coalesce(F.col("mill_last.family").isin(*_PARTICLE), F.lit(False))
    ends = lambda xs: F.col("mill_last.word").rlike("(" + "|".join(xs) + r")\z")
    noun_end = closed & ends(NOUN_ENDS)
    noun = F.coalesce(F.col("mill_head.x.family").isin(*_NOUN), F.lit(False))
    anchored = F.when(~closed & noun, "msp-02").when(noun_end & noun, "msp-05")
    verbal = closed & ~noun_end & F.coalesce(F.col("mill_head.x.family").isin(*_VERB), F.lit(False))
    has_subject = F.exists("mill_args", lambda a: a["role"] == "subject")
    outer = F.try_element_at("mill_args", F.lit(-1))["role"]
    deep = F.when(has_subject & outer.isNotNull() & (outer != "subject"), "msp-07").when(has_subject, "msp-06").when(ends(STATEMENT_ENDS) & (F.try_element_at("mill_args", F.lit(1))["role"] == "place"), "msp-04").when(F.size("mill_args") > 0, "msp-03").otherwise("msp-01")
    d = d.select("*", anchored.alias("mill_anchored"), F.coalesce(anchored, F.when(verbal, deep)).alias("mill_template"))
    template, by_verb = F.col("mill_template"), F.coalesce(F.col("mill_template").isin("msp-01", "msp-03", "msp-04", "msp-06", "msp-07"), F.lit(False))
    by_noun = F.coalesce(template.isin("msp-02", "msp-05"), F.lit(False))
    style = F.when(template.isNotNull(), F.coalesce(_about(F.col("mill_last"), entries)["style"], F.lit("N"))).when(F.size("mill_t") > 0, "N")
    topic = lambda a: (template == "msp-07") & (a["slot"] == F.size("mill_args"))
    arguments = F.when(by_verb, F.transform("mill_args", lambda a: F.struct(a["slot"].alias("slot"), a["noun"].alias("noun"), a["particle"].alias("particle"), a["role"].alias("role"), topic(a).alias("topic"))))
    closing = F.when(by_verb, F.reverse(F.transform(F.slice("mill_t", 1, F.col("mill_head.at").cast("int")), lambda x: x["word"])))
    nouns = F.when(by_noun, F.reverse(F.transform(F.filter(F.slice("mill_t", 2, F.size("mill_t")), lambda x: x["family"].isin(*_NOUN)), lambda x: x["word"])))
    inherits = F.element_at(F.create_map(*[x for k, v in INHERITS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]).cast("array<string>"))]), template)
    said = F.when(F.size("mill_t") == 0, "empty").when(template.isNull(), "unknown").otherwise(F.concat(F.lit("Ls-"), style, F.lit(".Fof-Fs.St-c")))
    parsed = F.struct(template.alias("template"), F.col("mill_anchored").alias("anchored"), style.alias("style"), said.alias("classification"), F.when(by_verb, F.col("mill_head.x.word")).otherwise(none).alias("verb"), closing.alias("closing"), arguments.alias("arguments"), nouns.alias("nouns"), inherits.alias("inherits"))
    return d.select(*[c for c in lines.columns if c != "parsed"], parsed.alias("parsed"))


def tagged_lines(spark, sf) -> DataFrame:
    """``doc_id, line, text``: lines of every text; words get codes by their form, every third one is a particle, every sixth one with a role, and so are most last ones."""
    words = [e.word for e in register()]
    marks = [e.word for e in register() if e.type in ROLES]
    listed = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    d = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    code = lambda w: F.when(w.rlike("(ing|ed|ment|keit)$"), "{v}").when(w.rlike("(ly|ble|lich)$"), "{dj}").when(F.length(w) % 5 == 0, "").otherwise("{n}")
    parts = F.filter(F.split("raw", r"\s+"), lambda w: w != "")
    given = F.transform(parts, lambda w, i: F.when(i % 6 == 1, listed(words, F.length(w) + i)).when(i % 6 == 4, listed(marks, F.length(w) + i)).otherwise(F.concat(w, code(w))))
    end = F.when(F.size(parts) % 4 > 0, F.concat(F.lit(" "), listed((*STATEMENT_ENDS, *NOUN_ENDS, "လား"), F.length("raw")))).otherwise("")
    return d.select("doc_id", "line", F.concat(F.array_join(given, " "), end, F.when(F.size(parts) % 2 == 0, " ။").otherwise("")).alias("text"))


@C.add("template_tokens")
def template_tokens(spark, sf):
    """Tokens of all lines by family, category and style."""
    t = tagged_lines(spark, sf).select(F.explode(tokens(F.col("text"))).alias("t"))
    return t.groupBy("t.family", "t.category", "t.type", "t.style").agg(F.count(F.lit(1)).alias("tokens"), F.count_if("t.verb").alias("may_be_verb"))


@C.add("template_parse")
def template_parse(spark, sf):
    """A row for each line of every text."""
    p = parse(tagged_lines(spark, sf), "text")
    shown = F.array_join(F.transform("parsed.arguments", lambda a: F.concat_ws(":", a["noun"], a["particle"], a["role"], F.when(a["topic"], "topic"))), " ")
    return p.select("doc_id", "line", "parsed.template", "parsed.anchored", "parsed.style", "parsed.classification", "parsed.verb", F.array_join("parsed.closing", " ").alias("closing"), shown.alias("arguments"), F.size("parsed.nouns").alias("nouns"), F.size("parsed.inherits").alias("inherited"))
