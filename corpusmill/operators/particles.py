"""Case, verb and suffix particles by a table of rules joined with tokens.

A rule is a row: the particles it is about, the tags that the token before and the token behind may
have, and the tense that the sentence's time words must tell.  The table is small and fixed, so the
join broadcasts it; neighbours come from one window over each sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from .grammar import _WORDS, SETS, tagged_words

C = Catalog()

# Particles that the rules name; the sets without words come from a lexicon.
WORDS: dict[str, tuple[str, ...]] = SETS | {
    "locative": ("၌", "တွင်", "ဝယ်", "ဝက"),
    "future_end": ("မည်", "လိမ့်မည်"),
    "statement_end": ("သည်", "၏", "ပြီ"),
    "gender": (*SETS["male"], *SETS["female"]),
    "focus": ("ပင်", "သာ", "ချည်း", "တော့", "တောင်"),
    "vocative": ("အို", "ဟယ်", "ရှင်", "ရေ", "ဗျို့", "ခင်ဗျာ", "ဗျာ", "ဟေ့"),
    "adverb_former": ("စွာ", "တတ်", "တ", "ချည်"),
    "classifier": (),
    "sentence_final": (),
    "auxiliary": (),
}


@dataclass(frozen=True)
class Particle:
    """``words`` is a set's name or one particle; no tags before or behind mean any neighbour or none."""

    id: str
    scope: str
    confidence: float
    words: str
    before: tuple[str, ...] = ()
    behind: tuple[str, ...] = ()
    past: bool | None = None

    def forms(self, sets: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
        return sets.get(self.words, (self.words,))


# The rules by the grammar's sections, with their confidence.
CASES = (
    Particle("53", "subject_marker", 0.9, "သည်", ("n",), ("v",)),
    Particle("53-ka", "subject_marker", 0.85, "က", ("n",), ("v",)),
    Particle("53-hma", "subject_marker", 0.85, "မှာ", ("n",), ("v",)),
    Particle("54", "object_marker", 0.95, "ကို", ("n",), ("v",)),
    Particle("55", "ablative_source", 0.9, "မှ", ("n",), ("v",)),
    Particle("56", "directional_toward", 0.9, "သို့", ("n",), ("v",)),
    Particle("61", "locative", 0.9, "locative", ("n",), ("v", "dj")),
    Particle("63", "possessive", 0.95, "၏", ("n",), ("n",)),
    Particle("75", "present_tense", 0.75, "statement_end", ("v",), past=False),
    Particle("77", "past_tense", 0.85, "statement_end", ("v",), past=True),
    Particle("78", "future_tense", 0.95, "future_end", ("v",)),
    Particle("81", "imperative_command", 0.95, "လော့", ("v",)),
    Particle("82", "suggestion_hortative", 0.9, "စို့", ("v",)),
    Particle("84", "decree_order", 0.9, "စေ", ("v",)),
)
SUFFIXES = (
    Particle("100", "classifier", 0.95, "classifier", ("num",)),
    Particle("102", "gender_marker", 0.9, "gender", ("n",)),
    Particle("104", "plural_marker", 0.95, "plural", ("n",)),
    Particle("106", "focus_emphasis", 0.85, "focus"),
    Particle("108", "question_marker", 0.95, "question_end"),
    Particle("110", "sentence_final", 0.9, "sentence_final"),
    Particle("112", "verb_auxiliary", 0.9, "auxiliary", ("v",)),
    Particle("113", "vocative", 0.95, "vocative"),
    Particle("114", "adjectivalizer", 0.9, "adjective_former", ("v", "n")),
    Particle("116", "adverbializer", 0.85, "adverb_former", ("dj",)),
)


def rule_rows(rules: tuple[Particle, ...], sets: dict[str, tuple[str, ...]]) -> list[tuple]:
    """One row for each particle of each rule."""
    return [(r.id, r.scope, r.confidence, w, list(r.before), list(r.behind), r.past) for r in rules for w in dict.fromkeys(r.forms(sets))]


def classify(tokens: DataFrame, rules: tuple[Particle, ...] = CASES + SUFFIXES, sets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``sentence, k, text, id, scope, confidence``: a row for each rule that holds at a token.

    A sentence tells of the past if it has a time word of the past and none of the future.  Null tags
    count as none, null texts as no particle.
    """
    words = WORDS | (sets or {})
    table = tokens.sparkSession.createDataFrame(rule_rows(rules, words), "id string, scope string, confidence double, text string, before array<string>, behind array<string>, past boolean")
    whole = Window.partitionBy("sentence")
    w = whole.orderBy("k")
    told = lambda name: F.coalesce(F.bool_or(F.col("text").isin(*words[name])).over(whole), F.lit(False))
    none = F.array().cast("array<string>")
    near = lambda f: F.coalesce(f("tags").over(w), none)
    t = tokens.select("sentence", "k", "text", near(F.lag).alias("tags_before"), near(F.lead).alias("tags_behind"), (told("past_time") & ~told("future_time")).alias("told_past"))
    fits = lambda have, want: (F.size(want) == 0) | F.arrays_overlap(have, want)
    hits = t.join(F.broadcast(table), "text").where(fits("tags_before", "before") & fits("tags_behind", "behind") & (F.col("past").isNull() | (F.col("past") == F.col("told_past"))))
    return hits.select("sentence", "k", "text", "id", "scope", "confidence")


_EXTRA = {"classifier": ("ယောက်", "ခု"), "sentence_final": ("ပေါ့", "ကော"), "auxiliary": ("နိုင်", "ချင်")}
_FORMS = tuple(dict.fromkeys(row[3] for row in rule_rows(CASES + SUFFIXES, WORDS | _EXTRA)))
_PAST, _FUTURE = SETS["past_time"][0], SETS["future_time"][0]


def _with_particles(tokens: DataFrame) -> DataFrame:
    """Every third word is a particle by its length; some texts begin with a time word."""
    forms = F.array(*[F.lit(f) for f in _FORMS])
    time = F.when((F.col("k") == 0) & (F.col("sentence") % 4 == 1), _PAST).when((F.col("k") == 0) & (F.col("sentence") % 4 == 2), _FUTURE).when((F.col("k") == 3) & (F.col("sentence") % 8 == 1), _FUTURE)
    text = F.when(F.col("k") % 3 == 1, F.element_at(forms, ((F.length("text") + F.col("k")) % len(_FORMS) + 1).cast("int"))).otherwise(F.coalesce(time, "text"))
    return tokens.select("sentence", "k", text.alias("text"), "tags")


def _sql(rules: tuple[Particle, ...]) -> str:
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rows = ", ".join(f"('{a}', '{b}', {c}, '{w}', {listed(x)}, {listed(y)}, {'NULL' if p is None else p}::BOOLEAN)" for a, b, c, w, x, y, p in rule_rows(rules, WORDS | _EXTRA))
    return f"""{_WORDS},
p AS (SELECT sentence, k, CASE WHEN k % 3 = 1 THEN list_extract({listed(_FORMS)}, (length(text) + k) % {len(_FORMS)} + 1) WHEN k = 0 AND sentence % 4 = 1 THEN '{_PAST}' WHEN k = 0 AND sentence % 4 = 2 THEN '{_FUTURE}' WHEN k = 3 AND sentence % 8 = 1 THEN '{_FUTURE}' ELSE text END AS text,
  list_filter([CASE WHEN v THEN 'v' END, CASE WHEN n THEN 'n' END, CASE WHEN dj THEN 'dj' END, CASE WHEN num THEN 'num' END], lambda x: x IS NOT NULL) AS tags FROM t),
q AS (SELECT *, coalesce(lag(tags) OVER s, []) AS b, coalesce(lead(tags) OVER s, []) AS a, (bool_or(text IN {WORDS['past_time']}) OVER z AND NOT bool_or(text IN {WORDS['future_time']}) OVER z) AS told FROM p WINDOW s AS (PARTITION BY sentence ORDER BY k), z AS (PARTITION BY sentence)),
rules(id, scope, confidence, word, before, behind, past) AS (VALUES {rows})
SELECT sentence, id, scope, count(*) AS hits, CAST(round(sum(confidence), 6) AS DOUBLE) AS weight FROM q JOIN rules ON text = word
WHERE (len(before) = 0 OR list_has_any(b, before)) AND (len(behind) = 0 OR list_has_any(a, behind)) AND (past IS NULL OR past = told) GROUP BY sentence, id, scope"""


def _hits(spark, sf, rules: tuple[Particle, ...]) -> DataFrame:
    hits = classify(_with_particles(tagged_words(spark, sf)), rules, _EXTRA)
    return hits.groupBy("sentence", "id", "scope").agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum("confidence"), 6).alias("weight"))


@C.add("case_particles", _sql(CASES))
def case_particles(spark, sf):
    return _hits(spark, sf, CASES)


@C.add("suffix_particles", _sql(SUFFIXES))
def suffix_particles(spark, sf):
    return _hits(spark, sf, SUFFIXES)
