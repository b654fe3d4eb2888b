"""Splitters, small parsers and quote repair: plain functions and their batch forms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[^。！？!?.၊။\n]*[。！？!?.၊။\n]*")


def split_exactly(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, cut behind sentences where possible; joined they are the text."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    out, held = [], ""
    for piece in filter(None, _SENTENCE.findall(text)):
        if held and len(held) + len(piece) > limit:
            out.append(held)
            held = ""
        while not held and len(piece) > limit:
            out.append(piece[:limit])
            piece = piece[limit:]
        held += piece
    return out + [held] if held else out


def numbers_of(spec: str) -> list[int]:
    """``"1-2,5"`` as ordered distinct numbers; a range that runs backwards is refused."""
    out: dict[int, None] = {}
    for part in filter(None, spec.replace(" ", "").split(",")):
        low, _, high = part.partition("-")
        if high and int(high) < int(low):
            raise ValueError(f"range {part!r} is reversed")
        out.update(dict.fromkeys(range(int(low), int(high or low) + 1)))
    return list(out)


def table_row(line: Column) -> Column:
    """Cells of a ``| a | b |`` line; null for other lines and rules."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.when(F.trim(line).rlike(r"^\|.*\|$") & ~F.trim(line).rlike(r"^\|[\s:|-]+\|$"), cells)


# What a quotation mark stands behind or before.
COLONS, ENDS, CLOSERS = ":：", "。！？!?.…", "，。！？；：、,.!?;:”’）)"
NEUTRAL = r"&quot;|\""

#: What a neutral mark outside quotes means: by what is before it, one letter each for a line's end, a
#: closing sign and anything else behind it.
OUTSIDE = {"start": "SSS", "colon": "EKK", "stop": "EPT", "sentence": "EPA", "word": "EPD"}
#: The letters of decisions: choice and reason.
DECISIONS = {
    "S": ("open", "line start"), "E": ("close", "line end"), "K": ("open", "after a colon"), "P": ("close", "before punctuation"),
    "T": ("close", "after a stop"), "N": ("open", "after narrative"), "A": ("close", "after a sentence"), "D": ("open", "by default"),
    "C": ("close", "closes an open quote"), "R": ("remove", "doubled opening"), "n": ("open", "opens a nested term"), "m": ("close", "closes a nested term"),
}
_OPENS = "".join(k for k, (choice, _) in DECISIONS.items() if choice != "close")


def _one_of(c: Column, chars: str) -> Column:
    return F.coalesce(F.lit(chars).contains(c), F.lit(False)) & (c != "")


def quote_decisions(line: Column, opening: str = "“", closing: str = "”") -> Column:
    """A letter of :data:`DECISIONS` for each neutral mark of a line, as one string.

    The text between marks says what each could mean outside quotes; one pass then carries whether a
    quote is open.  Of three or four marks, the second and third are a nested term where a short word
    stands between them.
    """
    pieces = F.split(line, NEUTRAL)
    n = F.size(pieces) - 1

    def local(i: Column) -> Column:
        before, behind = F.get(pieces, i), F.get(pieces, i + 1)
        left, right = F.right(F.regexp_replace(before, r"(?U)\s+$", ""), F.lit(1)), F.left(F.regexp_replace(behind, r"(?U)^\s+", ""), F.lit(1))
        kind = (
            F.when((left == "") & (i == 0), F.lit(OUTSIDE["start"]))
            .when(_one_of(left, COLONS), OUTSIDE["colon"])
            .when(left == "。", F.when((i > 0) & before.contains("。"), OUTSIDE["stop"].replace("T", "N")).otherwise(OUTSIDE["stop"]))
            .when(_one_of(left, ENDS), OUTSIDE["sentence"])
            .otherwise(OUTSIDE["word"])
        )
        at = F.when((right == "") & (i == n - 1), 1).when(_one_of(right, CLOSERS), 2).otherwise(3)
        turned = F.right(F.regexp_replace(before, f"[^{opening}{closing}]", ""), F.lit(1))
        return F.struct(F.substring(kind, at, F.lit(1)).alias("outside"), (left == opening).alias("doubled"), turned.alias("turned"))

    def step(done: Column, x: Column) -> Column:
        open_ = F.when(x["turned"] != "", x["turned"] == opening).otherwise(_one_of(F.right(done, F.lit(1)), _OPENS))
        return F.concat(done, F.when(open_ & x["doubled"], "R").when(open_, "C").otherwise(x["outside"]))

    marks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), local)).otherwise(F.array().cast("array<struct<outside:string,doubled:boolean,turned:string>>"))
    plain = F.aggregate(marks, F.lit(""), step)
    nested = plain.rlike("^SCD([CETPA m]?)$") & F.get(pieces, F.lit(2)).rlike("^[^\\s。！？!?，、；：:.,;\"“”]{1,6}$")
    return F.when(nested, F.concat(F.lit("Snm"), F.substring(plain, 4, 1))).otherwise(plain)


def repair_line(line: Column, opening: str = "“", closing: str = "”") -> Column:
    """``struct(text, changes)`` of a line: neutral marks turned to opening or closing ones, or dropped where doubled.

    ``changes`` has the column (from 1), choice and reason of each mark.
    """
    pieces, found = F.split(line, NEUTRAL), F.regexp_extract_all(line, F.lit(f"({NEUTRAL})"), F.lit(1))
    codes = F.filter(F.split(quote_decisions(line, opening, closing), ""), lambda c: c != "")
    value = lambda k: F.create_map(*[F.lit(x) for c, d in DECISIONS.items() for x in (c, d[k])])
    shown = F.create_map(*[F.lit(x) for c, (choice, _) in DECISIONS.items() for x in (c, {"open": opening, "close": closing, "remove": ""}[choice])])
    text = F.array_join(F.zip_with(pieces, F.transform(codes, lambda c: F.element_at(shown, c)), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    column = lambda i: F.length(F.array_join(F.slice(pieces, 1, i + 1), "")) + F.length(F.array_join(F.slice(found, 1, i), "")) + 1
    changes = F.transform(codes, lambda c, i: F.struct(column(i).alias("column"), F.element_at(value(0), c).alias("choice"), F.element_at(value(1), c).alias("reason")))
    return F.struct(text.alias("text"), changes.alias("changes"))


def quote_repair(text: Column) -> Column:
    """``struct(text, changes)`` of whole texts, line by line: the text and the number of marks decided."""
    text = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(NEUTRAL), repair_line(x)).otherwise(F.struct(x.alias("text"), F.array().cast("array<struct<column:int,choice:string,reason:string>>").alias("changes"))))
    none = F.struct(text.alias("text"), F.lit(0).alias("changes"))
    some = F.struct(F.array_join(F.transform(lines, lambda r: r["text"]), "\n").alias("text"), F.aggregate(F.transform(lines, lambda r: F.size(r["changes"])), F.lit(0), lambda a, b: a + b).alias("changes"))
    return F.when(text.rlike(NEUTRAL), some).otherwise(none)


def _split(limit: int):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_exactly(t, limit), na_action="ignore")

    return run


def pieces(text: Column, limit: int) -> Column:
    return F.pandas_udf(_split(limit), "array<string>")(text)
