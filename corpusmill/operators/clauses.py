"""Clauses that end at a particle, and the order of words around particles, by windows over sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from .grammar import _WORDS, tagged_words
from .particles import WORDS

C = Catalog()

# The particles that end a clause of each kind.
ENDS: dict[str, tuple[str, ...]] = {
    "noun": ("ကို", "မှာ", "က"),
    "adjective": ("သော", "သည့်", "မည့်"),
    "adverb": ("သောအခါ", "သောကြောင့်", "သဖြင့်", "လျှင်", "မှ", "အောင်", "ရန်", "သလို", "သကဲ့သို့", "လျက်", "ကာ", "၍", "ရင်း"),
}
# Particles of time and place, which want a verb behind them.
TIME_PLACE = ("က", "၌", "တွင်", "မှ", "သို့")
ADVERBS = (*WORDS["adverb_former"], "ချည်ချည်")
SUBJECTS = WORDS["subject"]


def clauses(tokens: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """``sentence, first, last, particle``: the clauses of a sentence one after another, by place from 0.

    A clause ends at the first particle with a verb since the clause before it; a particle without one
    doesn't end it.  As no verb lies before such a particle, the verbs since the particle before tell.
    """
    w = Window.partitionBy("sentence").orderBy("k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    verb = F.coalesce(F.array_contains("tags", "v"), F.lit(False)).cast("int")
    t = tokens.select("sentence", "k", "text", verb.alias("verb"), F.coalesce(F.col("text").isin(*ends), F.lit(False)).alias("end"))
    t = t.select("*", (F.row_number().over(w) - 1).alias("place"), F.sum("verb").over(w).alias("verbs"))
    seen = F.coalesce(F.max(F.when(F.col("end"), F.col("verbs"))).over(before), F.lit(0))
    t = t.withColumn("closes", F.col("end") & (F.col("verbs") > seen))
    first = F.coalesce(F.max(F.when(F.col("closes"), F.col("place") + 1)).over(before), F.lit(0))
    return t.select("sentence", first.alias("first"), F.col("place").alias("last"), F.col("text").alias("particle"), "closes").where("closes").drop("closes")


def word_order(tokens: DataFrame) -> DataFrame:
    """``sentence, k, rule, right, wanted, distance`` at each particle that the rules of order are about.

    Right: a subject's particle between noun and verb (207), an adjective's before a noun (208), an
    adverb's before a verb (209).  Wrong: an adjective's before something else, a particle of time or place
    before something other than a verb; then the word that was wanted and how far it is, null if none
    follows.  A subject can't be parted from its verb by another one, as the nearest verb is its own.
    The first and last token of a sentence are never judged.
    """
    w = Window.partitionBy("sentence").orderBy("k")
    # read backwards, so that each row adds to what the one behind it saw
    ahead = Window.partitionBy("sentence").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    has = lambda tag: F.coalesce(F.array_contains("tags", tag), F.lit(False))
    t = tokens.select("sentence", "k", "text", has("n").alias("n"), has("v").alias("v"), F.row_number().over(w).alias("place"))
    near = lambda tag: F.last(F.when(F.col(tag), F.struct("place", "text")), ignorenulls=True).over(ahead)
    t = t.select("*", F.lag("n").over(w).alias("n_before"), F.lead("n").over(w).alias("n_behind"), F.lead("v").over(w).alias("v_behind"), near("n").alias("noun"), near("v").alias("verb"))
    t = t.where("n_before is not null and n_behind is not null")
    is_ = lambda forms: F.col("text").isin(*forms)
    row = lambda rule, right, to: F.struct(F.lit(rule).alias("rule"), F.lit(right).alias("right"), (to["text"] if to is not None else F.lit(None).cast("string")).alias("wanted"), ((to["place"] - F.col("place")) if to is not None else F.lit(None).cast("int")).alias("distance"))
    found = F.array(
        F.when(is_(SUBJECTS) & F.col("n_before") & F.col("v_behind"), row(207, True, None)),
        F.when(is_(ENDS["adjective"]) & F.col("n_behind"), row(208, True, None)),
        F.when(is_(ENDS["adjective"]) & ~F.col("n_behind"), row(208, False, F.col("noun"))),
        F.when(is_(ADVERBS) & F.col("v_behind"), row(209, True, None)),
        F.when(is_(TIME_PLACE) & ~F.col("v_behind"), row(209, False, F.col("verb"))),
    )
    return t.select("sentence", "k", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("sentence", "k", "f.*")


_FORMS = tuple(dict.fromkeys([*ENDS["noun"], *ENDS["adjective"], *ENDS["adverb"], *SUBJECTS, *TIME_PLACE, *ADVERBS]))


def _tokens(spark, sf) -> DataFrame:
    """Every fifth word is a particle by its length."""
    forms = F.array(*[F.lit(f) for f in _FORMS])
    t = tagged_words(spark, sf)
    part = F.col("k") % 5 == 3
    text = F.when(part, F.element_at(forms, ((F.length("text") + F.col("k")) % len(_FORMS) + 1).cast("int"))).otherwise(F.col("text"))
    return t.select("sentence", "k", text.alias("text"), F.when(part, F.array().cast("array<string>")).otherwise(F.col("tags")).alias("tags"))


_in = lambda forms: "(" + ", ".join(f"'{x}'" for x in forms) + ")"
_TOKENS = f"""{_WORDS},
p AS (SELECT sentence, k, CASE WHEN k % 5 = 3 THEN list_extract([{_in(_FORMS)[1:-1]}], (length(text) + k) % {len(_FORMS)} + 1) ELSE text END AS text, k % 5 <> 3 AND v AS v, k % 5 <> 3 AND n AS n FROM t)"""


def _clause_sql(kind: str) -> str:
    return f"""{_TOKENS},
a AS (SELECT *, CAST(row_number() OVER s - 1 AS INT) AS place, sum(CAST(v AS INT)) OVER s AS verbs, text IN {_in(ENDS[kind])} AS stop FROM p WINDOW s AS (PARTITION BY sentence ORDER BY k)),
b AS (SELECT *, verbs - coalesce(lag(verbs) OVER s, 0) > 0 AS closes FROM a WHERE stop WINDOW s AS (PARTITION BY sentence ORDER BY k))
SELECT sentence, coalesce(lag(place) OVER s + 1, 0) AS first, place AS last, text AS particle FROM b WHERE closes WINDOW s AS (PARTITION BY sentence ORDER BY k)"""


def _register(kind: str) -> None:
    @C.add(f"{kind}_clauses", _clause_sql(kind))
    def rows(spark, sf):
        return clauses(_tokens(spark, sf), ENDS[kind])


for _kind in ENDS:
    _register(_kind)


@C.add("word_order", f"""{_TOKENS},
a AS (SELECT *, row_number() OVER s AS place, lag(n) OVER s AS nb, lead(n) OVER s AS na, lead(v) OVER s AS va FROM p WINDOW s AS (PARTITION BY sentence ORDER BY k)),
f AS (SELECT sentence, k, text, place, na, va, nb, min(CASE WHEN n THEN place END) OVER z AS noun, min(CASE WHEN v THEN place END) OVER z AS verb FROM a
  WINDOW z AS (PARTITION BY sentence ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
judged AS (SELECT sentence, k, place, 207 AS rule, TRUE AS ok, NULL::BIGINT AS goal FROM f WHERE nb IS NOT NULL AND na IS NOT NULL AND text IN {_in(SUBJECTS)} AND nb AND va
  UNION ALL SELECT sentence, k, place, 208, na, CASE WHEN NOT na THEN noun END FROM f WHERE nb IS NOT NULL AND na IS NOT NULL AND text IN {_in(ENDS['adjective'])}
  UNION ALL SELECT sentence, k, place, 209, TRUE, NULL FROM f WHERE nb IS NOT NULL AND na IS NOT NULL AND text IN {_in(ADVERBS)} AND va
  UNION ALL SELECT sentence, k, place, 209, FALSE, verb FROM f WHERE nb IS NOT NULL AND na IS NOT NULL AND text IN {_in(TIME_PLACE)} AND NOT va)
SELECT r.sentence, CAST(r.k AS INT) AS k, r.rule, r.ok AS "right", a.text AS wanted, CAST(r.goal - r.place AS INT) AS distance FROM judged r LEFT JOIN a ON a.sentence = r.sentence AND a.place = r.goal""")
def word_order_rows(spark, sf):
    return word_order(_tokens(spark, sf))
