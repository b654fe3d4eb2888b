"""Variants of the normaliser, order and digits of legacy layouts, and the choice among readings."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clusters
from .script import DIGITS, MARK_ORDER

# What the engine's normaliser drops, and what it takes as punctuation.
GLUE = "\u200b\u200c\u200d\u2060\ufeff\u180e\u200e\u200f\u202a\u202b\u25cc\u00a0\u034f$#^{}√"
PUNCTUATION = ",.'/+-=%÷×()[]@&;!?"
# Sequences that the engine's normaliser takes for other letters.
IMPOSTERS = {
    "က္က": "ဣ",
    "ီိး": "ီး",
    "ိီး": "ီး",
    "သ္သ": "ဿ",
    "သြ": "ဩ",
    "သြေ်": "ဪ",
    "ဩြေ်": "ဪ",
    "၄င်း": "၎င်း",
    "ဥာဋ်": "ဉာဋ်",
    "ဦး": "ဦး",
    "ဥိီး": "ဦး",
    "ဉီး": "ဦး",
    "ဉိီး": "ဦး",
    "ဉုံ": "ဥုံ",
    "ဉမ်": "ဥမ်",
}
# The kinds of characters that make a block, and the punctuation that a block takes in.
BLOCK_KINDS = ("A-Za-z", "0-9", DIGITS)
BLOCK_MARKS = r",.:;/()\-!? "
_INNER = BLOCK_MARKS.rstrip(" ")
#: A block up to its last character that isn't a space, then the spaces behind it, of which one is captured.
BLOCK = "(" + "|".join(f"[{k}](?:[{k}{BLOCK_MARKS}]*[{k}{_INNER}])?" for k in BLOCK_KINDS) + ")( ?) *"
_WORD = f"က-အဥဧ္{MARK_ORDER}"
MODES = ("normalize", "mynormalize", "mapper", "none")

_KINZI = "င်္"
# The order of legacy layouts, as patterns and replacements that apply in turn.
LAYOUT_RULES = (
    ("\u200b", ""),
    (f"([ေြ]+)([က-အ၀၇၈])((?:{_KINZI})?)((?:္[က-အ])*)", "$3$2$4$1"),
    (f"([က-အ][ါ-ှ]*)({_KINZI})(?![က-အ])", "$2$1"),
    ("(ေ)([ျွဲှ္ြ]+)", "$2$1"),
    (f"([က-အ])([က-အ])({_KINZI})", "$1$3$2"),
    ("ဦး", "ဦး"),
)


def wrap_blocks(t: Column) -> Column:
    """Runs of Latin letters, of digits and of Myanmar digits in braces, with the punctuation between and behind them.

    Spaces within are squeezed; spaces behind become one, outside the braces.  Braces of the text itself go first.
    """
    parts = F.split(F.regexp_replace(F.translate(t, "{}", ""), BLOCK, r"{$1}$2"), "[{}]")
    return F.array_join(F.transform(parts, lambda p, k: F.when(k % 2 == 1, F.concat(F.lit("{"), F.regexp_replace(p, " +", " "), F.lit("}"))).otherwise(p)), "")


def delete_blocks(t: Column) -> Column:
    """The text without the runs that :func:`wrap_blocks` finds; one space stays of those behind a run."""
    return F.regexp_replace(t, BLOCK, "$2")


def replace_in_turn(t: Column, table: dict[str, str]) -> Column:
    """Replacements one after another, the longest first; a later one reads what an earlier one wrote."""
    for k in sorted(table, key=len, reverse=True):
        t = F.replace(t, F.lit(k), F.lit(table[k]))
    return t


def _composed(texts: list[str]) -> list[str]:
    return [unicodedata.normalize("NFC", t) for t in texts]


_BLOCKS, _SPACES = re.compile(BLOCK), re.compile(" +")


def _imposters_replaced(t: str) -> str:
    """:func:`replace_in_turn` with the imposters, of one text."""
    for k in sorted(IMPOSTERS, key=len, reverse=True):
        t = t.replace(k, IMPOSTERS[k])
    return t


def _wrapped(t: str) -> str:
    """:func:`wrap_blocks` of one text."""
    return _BLOCKS.sub(lambda m: f"{{{_SPACES.sub(' ', m[1])}}}{m[2]}", t.replace("{", "").replace("}", ""))


def _engine(composed: list[str], glue: str = GLUE) -> list[str]:
    return [_imposters_replaced(t) for t in clusters.sorted_marks(composed, glue)]


def _deletion(composed: list[str]) -> list[str]:
    return clusters.sorted_marks([_imposters_replaced(_BLOCKS.sub(r"\2", t)) for t in composed])


def engine_normalise(t: Column, punctuation: bool = False) -> Column:
    """Composed, without glue (and punctuation), marks in order, then the imposters; null stays null."""
    glue = GLUE + (PUNCTUATION if punctuation else "")
    return clusters.text_column(lambda texts: _engine(_composed(texts), glue))(t)


def deletion_normalise(t: Column) -> Column:
    """Composed, without blocks, imposters replaced, then marks in order; glue stays."""
    return clusters.text_column(lambda texts: _deletion(_composed(texts)))(t)


def mapper_normalise(t: Column) -> Column:
    """:func:`engine_normalise`, then blocks in braces."""
    return clusters.text_column(lambda texts: [_wrapped(x) for x in _engine(_composed(texts))])(t)


def every_mode(t: Column) -> Column:
    """``struct(normalize, mynormalize, mapper)`` of a text in one pass; nulls where it is null."""

    def run(texts: pa.Array) -> pa.Array:
        done = []
        for part in clusters.parts(texts):
            known = part.is_valid().to_pylist()
            composed = _composed(part.drop_null().to_pylist())
            engine = _engine(composed)
            made = [iter(x) for x in (engine, _deletion(composed), map(_wrapped, engine))]
            done.append(pa.StructArray.from_arrays([pa.array((next(x) if k else None for k in known), pa.string()) for x in made], list(MODES[:-1])))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct([(m, pa.string()) for m in MODES[:-1]]))

    return F.arrow_udf(run, ", ".join(f"{m} string" for m in MODES[:-1]))(t)


def normaliser(mode: str | None):
    """The function of a mode; None for ``none`` and nothing, an error for unknown ones."""
    name = (mode or "none").lower().replace(" ", "").replace("_", "").replace("-", "")
    known = {"normalize": engine_normalise, "mynormalize": deletion_normalise, "mapper": mapper_normalise, "mappernormalize": mapper_normalise, "none": None}
    if name not in known:
        raise ValueError(f"unknown mode {mode!r}, use one of {', '.join(MODES)}")
    return known[name]


def digits_to_letters(t: Column) -> Column:
    """The digit 0 is the letter wa before a mark, before a consonant not behind a digit, and within a word before other letters.

    A 0 before another never changes, so one pass over the text sees what a walk would.
    """
    return F.regexp_replace(t, f"၀(?=[{MARK_ORDER}])|(?<![{DIGITS}])၀(?=[က-အ])|(?<=[{_WORD}])၀(?=[ဥဧ္])", "ဝ")



def letters_to_digits(t: Column) -> Column:
    """The letter ra is the digit 7 next to a digit, unless a letter or mark other than ra follows.

    Behind a digit a whole run of them turns; before a digit the last three.
    """
    t = F.regexp_replace(t, rf"(?:(?<=[{DIGITS}])|(?<=ရ)\G)ရ(?=ရ|[^{_WORD}]|\z)", "၇")
    return F.regexp_replace(t, f"ရ(?=ရ{{0,2}}[{DIGITS}])", "၇")


def digit_letters(t: Column) -> Column:
    """Both turns, digits to letters first."""
    return letters_to_digits(digits_to_letters(t))


def legacy_layout(t: Column) -> Column:
    """Text in the order it was drawn, in the order it is stored; then digits and letters of one shape."""
    for pattern, by in LAYOUT_RULES:
        t = F.regexp_replace(t, pattern, by)
    return digit_letters(t)


def choose_readings(readings: DataFrame, key: str = "doc_id", margin: float = 0.03, least_marks: int = 50) -> DataFrame:
    """The reading of each key that counts: ``key, kind, text, score``.

    ``readings`` has ``key``, ``place`` (0 for the reading in hand), ``kind`` and ``text``.  Each is put in
    order and scored by its structure.  Another reading takes the place of the one in hand only if that
    has enough marks to judge by and the other's score leads by the margin; of those that do, the best,
    then the first.  A null text scores 0; a key without a reading in hand gets its best one.
    """
    from .repair import GLUE as ALL_GLUE

    s = clusters.structural_score(clusters.order_column(ALL_GLUE)("text"))
    r = readings.select(key, "place", "kind", "text", s.alias("s"))
    own, other = F.col("place") == 0, F.col("place") != 0
    row = F.struct(F.col("s.score").alias("score"), (-F.col("place")).alias("order"), "kind", "text", F.col("s.marks").alias("marks"))
    g = r.groupBy(key).agg(F.max(F.when(own, row)).alias("a"), F.max(F.when(other, row)).alias("b"))
    taken = F.col("a").isNull() | ((F.col("a.marks") >= least_marks) & (F.round(F.col("b.score") - F.col("a.score"), 12) >= margin))
    best = F.when(F.col("b").isNotNull() & taken, F.col("b")).otherwise(F.col("a"))
    return g.select(key, best.alias("r")).select(key, "r.kind", "r.text", "r.score")


# The tags that a page may begin with.
PAGE_TAGS = ("!doctype html", "html", "head", "body", "meta", "title", "script", "form", "a", "div", "p", "span", "button", "table", "ul", "ol", "nav", "main", "article", "section", "iframe", "img")
LEAD = r"(?s)^\x{FEFF}?[ \t\r\n]*(?:<!--.*?-->[ \t\r\n]*)*"
PAGE = "^<(?:!--|" + "|".join(PAGE_TAGS) + ")"


def looks_like_page(head: Column, window: int = 1024) -> Column:
    """Whether text begins as an HTML page, behind a mark of byte order, white space and comments; an unfinished comment counts."""
    rest = F.regexp_replace(F.lower(F.left(head, F.lit(window))), LEAD, "")
    return F.coalesce(rest.rlike(PAGE), F.lit(False))
