"""Segmentation and tagging from tables of syllables and tag paths.

A lexicon is a table: ``syllable, id`` for segmentation, ``path array<id>, tags array<string>`` for
tagging.  A lexicon of up to ``MOST`` rows is shared with the workers; a larger one is met in joins (``joined``), with the
same results.  The walk always takes the longest entry at a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clusters, joined

FULL_STOP = "။"
MOST = 2_000_000
VALUE = ("value",)
TOKENS = "array<struct<syllables:array<string>,ids:array<string>,tags:array<string>>>"


class Trie:
    """Sequences with values; ``longest`` walks as far as any entry goes and returns the last value passed."""

    def __init__(self, entries):
        self.root: dict = {}
        for path, value in entries:
            node = self.root
            for step in path:
                node = node.setdefault(step, {})
            node[VALUE] = value

    def longest(self, sequence, start: int) -> tuple[int, object]:
        """End and value of the longest entry from ``start``; ``(start + 1, None)`` where none begins."""
        node, end, value = self.root, start + 1, None
        for k in range(start, len(sequence)):
            node = node.get(sequence[k])
            if node is None:
                break
            if VALUE in node:
                end, value = k + 1, node[VALUE]
        return end, value


def rows_of(table: DataFrame, most: int | None = None) -> list | None:
    """A lexicon's rows; None if there are more of them than are shared."""
    most = MOST if most is None else most
    rows = table.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _pieces(t: str, trie: Trie) -> tuple[list[str], list[str | None]]:
    """Surfaces and ids: the longest syllable at each place; braces stay whole, white space goes."""
    surface, ids, k = [], [], 0
    while k < len(t):
        if t[k].isspace():
            k += 1
            continue
        if t[k] == "{" and "}" in t[k:]:
            end, found = t.index("}", k) + 1, None
        else:
            end, found = trie.longest(t, k)
        surface.append(t[k:end])
        ids.append(found)
        k = end
    return surface, ids


def surface_class(s: str) -> str:
    """The tag of a piece without an id."""
    if s.startswith("{") and s.endswith("}"):
        return "en"
    if all(c.isdigit() or c in ".,/-" for c in s) and any(c.isdigit() for c in s):
        return "count"
    return "?" if any(c.isalnum() for c in s) else "pan"


def _tokens(surface: list[str], ids: list[str | None], trie: Trie) -> Iterator[tuple[int, list[str]]]:
    """The end and the tags of each token."""
    k = 0
    while k < len(surface):
        if surface[k] == FULL_STOP:
            end, tags = k + 1, ["eos"]
        elif ids[k] is None:
            end, tags = k + 1, [surface_class(surface[k])]
        else:
            end, tags = trie.longest(ids, k)
        yield end, list(tags or ["?"])
        k = end


def _shared(docs: DataFrame, entries):
    return docs.sparkSession.sparkContext.broadcast(Trie(entries))


SLICE = 64
PIECE = pa.struct([("surface", pa.string()), ("id", pa.string())])


def _piece_array(texts: pa.Array, walk_of) -> pa.Array:
    """Pieces of each text, ``walk_of(k, t)`` knows the longest entries of the k-th; only a slice is held as Python objects."""
    done = []
    for at in range(0, len(texts), SLICE):
        part = texts.slice(at, SLICE)
        surface, ids, cuts = [], [], [0]
        for k, t in enumerate(part.to_pylist(), at):
            if t is not None:
                one, two = _pieces(t, walk_of(k, t))
                surface += one
                ids += two
            cuts.append(len(surface))
        flat = pa.StructArray.from_arrays([pa.array(surface, pa.string()), pa.array(ids, pa.string())], ["surface", "id"])
        done.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat, mask=part.is_null()))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(PIECE))


def pieces_by_walk(docs: DataFrame, text: str, walk) -> DataFrame:
    """``pieces`` of texts by a broadcast object that knows the longest entry at a place."""

    def run(texts: pa.Array) -> pa.Array:
        return _piece_array(texts, lambda k, t: walk.value)

    return docs.withColumn("pieces", F.arrow_udf(run, "array<struct<surface:string,id:string>>")(F.col(f"`{text}`")))


def pieces_by_answers(met: DataFrame, text: str, runs: joined.Runs) -> DataFrame:
    """``pieces`` of texts that brought their answers (``mill_found``), which go."""

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        return _piece_array(texts, lambda k, t: joined.Answers(t, runs, found[k].as_py()))

    return met.withColumn("pieces", F.arrow_udf(run, "array<struct<surface:string,id:string>>")(F.col(f"`{text}`"), F.col("mill_found"))).drop("mill_found")


def _segment_joined(docs: DataFrame, syllables: DataFrame, text: str) -> DataFrame:
    entries = syllables.select(F.col("syllable").alias("path"), F.col("id").alias("value"))
    runs = joined.runs_of_alphabet(entries, "path")
    return pieces_by_answers(joined.with_answers(docs, F.col(f"`{text}`"), runs, lambda r: joined.spans(r, entries)), text, runs)


def segment(docs: DataFrame, syllables: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pieces``: ``array<struct<surface, id>>`` by the longest syllable at each place.

    Masked spans in braces stay whole, white space separates and isn't a piece, other characters
    stand alone without an id.  Null gives null.
    """
    rows = rows_of(syllables)
    if rows is None:
        return _segment_joined(docs, syllables, text)
    return pieces_by_walk(docs, text, _shared(docs, ((r["syllable"], r["id"]) for r in rows)))


def _token_array(texts: list, pieces_of, answers_of) -> pa.Array:
    """Tokens of each text: ``pieces_of(k)`` are its surfaces and ids, ``answers_of(k, ids)`` finds paths."""
    surface, ids, tags = [], [], []
    cuts, rows, tag_cuts = [0], [0], [0]
    for k, t in enumerate(texts):
        if t is not None:
            pieces, found = pieces_of(k)
            for end, names in _tokens(pieces, found, answers_of(k, found)):
                cuts.append(len(surface) + end)
                tags += names
                tag_cuts.append(len(tags))
            surface += pieces
            ids += found
        rows.append(len(cuts) - 1)
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.string()))
    token = pa.StructArray.from_arrays([lists(cuts, surface), lists(cuts, [x or "" for x in ids]), lists(tag_cuts, tags)], ["syllables", "ids", "tags"])
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), token, mask=pa.array([t is None for t in texts], pa.bool_()))


def _tag_joined(docs: DataFrame, syllables: DataFrame, paths: DataFrame, text: str) -> DataFrame:
    entries = paths.select("path", F.col("tags").alias("value"))
    cut = segment(docs.withColumn("mill_text", F.col(f"`{text}`")), syllables, "mill_text").withColumnRenamed("pieces", "mill_pieces")
    met = joined.with_answers(cut, F.col("mill_pieces.id"), joined.runs_of_ids, lambda r: joined.spans(r, entries))

    def run(pieces: pa.Array, found: pa.Array) -> pa.Array:
        texts, said = pieces.to_pylist(), found.to_pylist()
        return _token_array(texts, lambda k: ([p["surface"] for p in texts[k]], [p["id"] for p in texts[k]]), lambda k, ids: joined.Answers(ids, joined.runs_of_ids, said[k]))

    return met.withColumn("tokens", F.arrow_udf(run, TOKENS)(F.col("mill_pieces"), F.col("mill_found"))).drop("mill_pieces", "mill_found", "mill_text")


def tag(docs: DataFrame, syllables: DataFrame, paths: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens``: segments, then the longest path of ids at each place and its tags.

    A full stop is ``eos``; a piece without an id gets the class of its surface; an id that begins no
    path is ``?``.  Where both tables are shared, both walks are one step, so segments don't cross between the JVM and Python.
    """
    one, two = rows_of(syllables), rows_of(paths)
    if one is None or two is None:
        return _tag_joined(docs, syllables, paths, text)
    first = _shared(docs, ((r["syllable"], r["id"]) for r in one))
    second = _shared(docs, ((r["path"], r["tags"]) for r in two))

    def run(texts: pa.Array) -> pa.Array:
        done = []
        for part in clusters.parts(texts):
            part = part.to_pylist()
            done.append(_token_array(part, lambda k: _pieces(part[k], first.value), lambda k, ids: second.value))  # noqa: B023
        return pa.concat_arrays(done) if done else _token_array([], None, None)

    return docs.withColumn("tokens", F.arrow_udf(run, TOKENS)(F.col(text)))


def resolve(tokens):
    """Resolved tokens: exactly the tags n and v make ``rbvn``; else the first tag is final."""
    pair = lambda t: (F.size(t["tags"]) == 2) & F.array_contains(t["tags"], "n") & F.array_contains(t["tags"], "v")
    return F.transform(tokens, lambda t, k: F.struct(F.array_join(t["syllables"], "").alias("surface"), F.array_join(t["ids"], "").alias("id"), t["tags"].alias("tags"), F.when(pair(t), "rbvn").otherwise(F.get(t["tags"], F.lit(0))).alias("final"), (F.size(t["syllables"]) == 1).alias("single"), (F.size(t["tags"]) > 1).alias("ambiguous"), k.alias("position")))


#: Words that a worker remembers with their tokens or as lines, the length of the longest, and bytes of text whose results are sent at once.
WORDS, LINES, WORD, SENT = 100_000, 400_000, 40, 1 << 20
FACTS = "pieces int, tokens int, ambiguous int, joined int, line string"
_FACTS = pa.struct([(f.split()[0], pa.string() if f.endswith("string") else pa.int32()) for f in FACTS.split(", ")])


class _Word:
    """Pieces of what lies between white space, and the facts of its tokens by the piece where they begin."""

    __slots__ = ("surface", "ids", "at")

    def __init__(self, surface: list[str], ids: list[str | None]):
        self.surface, self.ids, self.at = surface, ids, {}


class Facts:
    """What is told of a text's tokens, without the tokens: words and the ends of words are walked once each.

    A syllable without white space never crosses it, so a word's pieces are its own.  Paths may cross it: tokens of a word are
    settled up to the first whose path could go on behind it, and from there on by the pieces that follow, as many as a path takes in.
    A text with masked spans is one word, as is any if a syllable has white space.
    """

    def __init__(self, syllables: list, paths: list, merged: bool):
        self.syllables, self.paths, self.merged = Trie(syllables), Trie(paths), merged
        self.depth = max((len(p) for p, _ in paths), default=1)
        self.cut = not any(c.isspace() for s, _ in syllables for c in s)
        self.words: dict[str, _Word] = {}
        self.ends: dict[tuple, tuple] = {}
        self.lines: dict[str, str] = {}

    def whole(self, t: str) -> bool:
        return not self.cut or ("{" in t and "}" in t)

    def words_of(self, t: str) -> list[_Word]:
        if self.whole(t):
            return [_Word(*_pieces(t, self.syllables))]
        found, known = [], self.words
        for w in t.split():
            word = known.get(w)
            if word is None:
                word = _Word(*_pieces(w, self.syllables))
                if len(w) <= WORD:
                    if len(known) >= WORDS:
                        known.clear()
                    known[w] = word
            found.append(word)
        return found

    def _path(self, ids: list, k: int) -> tuple[int, object, bool]:
        """End and value of the longest path, and whether one could go on behind the last id."""
        node, end, value = self.paths.root, k + 1, None
        for i in range(k, len(ids)):
            node = node.get(ids[i])
            if node is None:
                return end, value, False
            if VALUE in node:
                end, value = i + 1, node[VALUE]
        return end, value, len(node) > (VALUE in node)

    def _settle(self, surface: list, ids: list, k: int, own: int, last: bool) -> tuple:
        """Where tokens from piece ``k`` on are settled up to, their number, ambiguous and joined ones, and their line (None without any).

        Tokens begin before piece ``own``; unless it is the ``last`` that is known, one that could go on is left.
        """
        tokens = ambiguous = joined = 0
        shown = []
        while k < own:
            if surface[k] == FULL_STOP:
                end, tags = k + 1, ["eos"]
            elif ids[k] is None:
                end, tags = k + 1, [surface_class(surface[k])]
            else:
                end, tags, more = self._path(ids, k)
                if more and not last:
                    break
                tags = tags or ["?"]
            pair = len(tags) == 2 and "n" in tags and "v" in tags
            tokens += 1
            ambiguous += len(tags) > 1
            joined += pair
            if self.merged:
                shown.append("".join(x or "" for x in ids[k:end]))
            elif pair or tags[0] is not None:
                shown.append(f"{''.join(surface[k:end])}{{{'rbvn' if pair else tags[0]}}}")
            k = end
        return k, tokens, ambiguous, joined, " ".join(shown) if shown else None

    def of(self, t: str) -> tuple[int, int, int, int, str]:
        words = self.words_of(t)
        pieces = tokens = ambiguous = joined = over = 0
        lines = []
        for i, word in enumerate(words):
            n = len(word.ids)
            pieces += n
            if over >= n:  # a path before took it in
                over -= n
                continue
            settled = word.at.get(over)
            if settled is None:
                settled = word.at[over] = self._settle(word.surface, word.ids, over, n, False)
            k, a, b, c, line = settled
            tokens, ambiguous, joined = tokens + a, ambiguous + b, joined + c
            if line is not None:
                lines.append(line)
            if k < n:
                k, a, b, c, line = self._end(words, i, k)
                tokens, ambiguous, joined = tokens + a, ambiguous + b, joined + c
                if line is not None:
                    lines.append(line)
            over = k - n
        return pieces, tokens, ambiguous, joined, " ".join(lines)

    def _end(self, words: list[_Word], i: int, k: int) -> tuple:
        """The tokens of a word from piece ``k`` on, by the pieces that follow."""
        word, need, behind, j = words[i], self.depth - 1, [], i + 1
        while len(behind) < need and j < len(words):
            behind += zip(words[j].surface[:need], words[j].ids[:need], strict=True)
            j += 1
        behind = behind[:need]
        key = (tuple(word.surface[k:]), tuple(behind))
        found = self.ends.get(key)
        if found is None:
            own = len(word.ids) - k
            surface, ids = word.surface[k:] + [s for s, _ in behind], word.ids[k:] + [x for _, x in behind]
            found = self._settle(surface, ids, 0, own, True)
            if own <= WORD:
                if len(self.ends) >= WORDS:
                    self.ends.clear()
                self.ends[key] = found
        return (found[0] + k, *found[1:])

    def line(self, t: str) -> str:
        if self.whole(t):
            return "  ".join(_pieces(t, self.syllables)[0])
        shown, known = [], self.lines
        for w in t.split():
            line = known.get(w)
            if line is None:
                line = "  ".join(_pieces(w, self.syllables)[0])
                if len(w) <= WORD:
                    if len(known) >= LINES:
                        known.clear()
                    known[w] = line
            shown.append(line)
        return "  ".join(shown)


def _facts_frame(docs: DataFrame, text: str, facts, schema: str, of) -> DataFrame:
    """``docs`` with columns that ``of`` makes of a text (an Arrow array of a list of texts) in place of the text."""
    kept = [c for c in docs.columns if c != text]
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = facts.value
        for batch in batches:
            at = 0
            for part in clusters.parts(batch.column(0), SENT):
                rows = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], of(shared, part.to_pylist())], [*kept, "facts"])

    first = docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in kept])
    out = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("facts", spark.createDataFrame([], f"x {schema}").schema["x"].dataType)
    return first.mapInArrow(run, out)


def _facts_of(shared: Facts, texts: list) -> pa.Array:
    return pa.array([None if t is None else dict(zip(_FACTS.names, shared.of(t), strict=True)) for t in texts], _FACTS)


def _lines_of(shared: Facts, texts: list) -> pa.Array:
    return pa.array([None if t is None else shared.line(t) for t in texts], pa.string())


def token_facts(docs: DataFrame, syllables: DataFrame, paths: DataFrame, merged: bool = False, text: str = "text") -> DataFrame:
    """``docs`` with ``facts`` in place of the text: ``struct(pieces, tokens, ambiguous, joined, line)`` of what :func:`pipeline` resolves.

    The line has each token's surface with its final tag in braces or, if ``merged``, its ids; joined are tokens that end as ``rbvn``.
    Tokens themselves never leave a worker, as they are a hundred times the size of their letters.  Null gives null.
    """
    one, two = rows_of(syllables), rows_of(paths)
    if one is not None and two is not None:
        facts = Facts([(r["syllable"], r["id"]) for r in one], [(r["path"], r["tags"]) for r in two], merged)
        return _facts_frame(docs, text, docs.sparkSession.sparkContext.broadcast(facts), f"struct<{FACTS.replace(' ', ':').replace(',:', ',')}>", _facts_of)
    t = F.col("mill_tokens")
    out = tag(docs.withColumnRenamed(text, "mill_said"), syllables, paths, "mill_said")
    out = out.withColumn("mill_pieces", F.flatten("tokens.ids")).withColumn("mill_tokens", resolve(F.col("tokens")))
    shown = F.transform(t, lambda x: x["id"] if merged else F.concat(x["surface"], F.lit("{"), x["final"], F.lit("}")))
    count = lambda f: F.size(F.filter(t, f))
    pieces = F.size("mill_pieces")
    facts = F.struct(pieces.alias("pieces"), F.size(t).alias("tokens"), count(lambda x: x["ambiguous"]).alias("ambiguous"), count(lambda x: x["final"] == "rbvn").alias("joined"), F.array_join(shown, " ").alias("line"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.when(t.isNotNull(), facts).alias("facts"))


def line_facts(docs: DataFrame, syllables: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``facts`` in place of the text: its segments as a line."""
    rows = rows_of(syllables)
    if rows is not None:
        facts = Facts([(r["syllable"], r["id"]) for r in rows], [], False)
        return _facts_frame(docs, text, docs.sparkSession.sparkContext.broadcast(facts), "string", _lines_of)
    out = segment(docs, syllables, text).withColumn("facts", F.array_join(F.col("pieces.surface"), "  "))
    return out.drop("pieces", text)


def pipeline(docs: DataFrame, syllables: DataFrame, paths: DataFrame, signature: str = "public") -> DataFrame:
    """Text to segments (``public``, ``scraper``), to resolved tokens (``site``, ``proofreading``) or both with all views (``debugger``)."""
    if signature not in ("public", "scraper", "site", "proofreading", "debugger"):
        raise ValueError(f"unknown signature {signature!r}")
    if signature in ("public", "scraper"):
        return segment(docs, syllables).withColumn("line", F.array_join(F.col("pieces.surface"), "  ")).drop("pieces")
    out = tag(docs, syllables, paths).withColumn("resolved", resolve(F.col("tokens")))
    if signature == "debugger":
        return out.withColumn("ids", F.flatten("tokens.ids")).withColumn("merged", F.transform("tokens", lambda t: F.array_join(t["ids"], "")))
    return out.drop("tokens")


def fold_units(pieces: list[str]) -> Iterator[list[str]]:
    """Pieces by unit: a unit closes at every second full stop, what is left is the last."""
    held, stops = [], 0
    for p in pieces:
        held.append(p)
        stops += p == FULL_STOP
        if stops == 2:
            yield held
            held, stops = [], 0
    if held:
        yield held
