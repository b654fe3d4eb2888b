"""Repair of conversation structure at least cost, by a forward Viterbi walk over four grammar states.

Rows of a conversation, by turn, are kept, given another role or deleted, and turns are inserted, so
that role initials read ``(s?(ua)+)?``.  Keeping is free, a new role and an insertion cost 2, a deletion 3 (a must
for blank and repeated rows), and a truncated row that stays costs 1 more.  Of the cheapest edits those
of the ASCII-least audit string (K, R, D and I in order) are taken; it fixes every role.

Each conversation is one walk.  A state of the grammar (nothing yet, after s, after u, after a) carries the
least (cost, audit string) of a path to it; a row's layer closes with at most two insertions, since a third one
only leads where a shorter path leads already.  Strings aren't compared or copied: audit strings of one layer
end with the letter of its row and have equally many such letters, so none begins another, and their *rank* decides for all that
follows.  Costs of a layer are kept relative to its cheapest state, and a state over ``WORST`` dearer is
dropped, because from any other state its future costs at most that much more.  What is left has few
forms, so each step is looked up.  Paths are settled every ``SEGMENT`` rows (or ``SEGMENT_BYTES``): each live state then carries the
running digest of its own repaired rows, and only its audit string grows.

Rows are exchanged once, by conversation, and sorted by Spark (which spills) before a worker streams through them:
a conversation of any size is read in order by one task, as its digest asks, in the memory of a
segment and four audit strings.  Repeated rows are found by a window over the same exchange.

Rows of one turn are taken by role and text.  A null id is a conversation of its own; a null role or text counts as one space;
null turns come first and count for no gap.  Repeated rows are duplicates.  Other columns aren't read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
WORST = 5
SEGMENT = 4096
SEGMENT_BYTES = 8 << 20

#: Insertions that close a layer: the states they lead to from each state, by the letters they cost.
CLOSE = {
    START: (("", START), ("I", AFTER_U), ("II", AFTER_A)),
    AFTER_S: (("", AFTER_S), ("I", AFTER_U), ("II", AFTER_A)),
    AFTER_U: (("", AFTER_U), ("I", AFTER_A)),
    AFTER_A: (("", AFTER_A), ("I", AFTER_U)),
}
ACCEPT = (START, AFTER_A)


def follow(state: int, initial: str) -> int | None:
    """The state after a turn with this role initial, if the grammar has one."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


def wanted(state: int) -> str:
    """The role of a turn that is inserted or renamed in this state."""
    return "assistant" if state == AFTER_U else "user"


#: A layer: ``(state, cost over the cheapest, rank of its audit string)`` of each live state.
Layer = tuple[tuple[int, int, int], ...]
FIRST: Layer = ((START, 0, 0),)


@lru_cache(maxsize=100_000)
def step(layer: Layer, initial: str, must_go: bool, truncated: bool) -> tuple[int, Layer, dict[int, tuple[int, str]]]:
    """The next layer over a row: what the cheapest cost grows by, the layer, and each state's predecessor and letters."""
    best: dict[int, tuple[int, int, str, int]] = {}

    def offer(to: int | None, key: tuple[int, int, str, int]) -> None:
        if to is not None and (to not in best or key < best[to]):
            best[to] = key

    for state, cost, rank in layer:
        for letters, at in CLOSE[state]:
            paid = cost + len(letters) * COST[INSERT]
            offer(at, (paid + COST[DELETE], rank, letters + DELETE, state))
            if not must_go:
                paid += TRUNCATED * truncated
                offer(follow(at, initial), (paid + COST[KEEP], rank, letters + KEEP, state))
                offer(follow(at, wanted(at)[0]), (paid + COST[REROLE], rank, letters + REROLE, state))
    least = min(k[0] for k in best.values())
    live = {s: k for s, k in best.items() if k[0] <= least + WORST}
    ranks = {s: r for r, s in enumerate(sorted(live, key=lambda s: live[s][1:3]))}
    return least, tuple((s, k[0] - least, ranks[s]) for s, k in sorted(live.items())), {s: (k[3], k[2]) for s, k in live.items()}


def close(layer: Layer) -> tuple[int, int, str]:
    """Cost over the cheapest, state and closing insertions of the best end."""
    ends = [(cost + len(letters) * COST[INSERT], rank, letters, state) for state, cost, rank in layer for letters, at in CLOSE[state] if at in ACCEPT]
    cost, _, letters, state = min(ends)
    return cost, state, letters


def replay(state: int, audit: str, rows: Iterator) -> Iterator[tuple[str, str | None, object]]:
    """``letter, role, row`` of each edit from a state on; role None keeps the row's own, row None is an insertion."""
    for letter in audit:
        row = None if letter == INSERT else next(rows)
        role = None if letter in (KEEP, DELETE) else wanted(state)
        yield letter, role, row
        if letter != DELETE:
            state = follow(state, role[0] if role else row[0][:1])


class Walk:
    """One conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.layer, self.cost = conv, FIRST, 0
        self.rows: list[tuple[str, str]] = []
        self.back: list[dict[int, tuple[int, str]]] = []
        self.bytes = 0
        #: of each live state at the start of the segment: audit so far (linked), digest, whether rows came already
        self.paths = {START: ((None, ""), hashlib.sha256(), False)}
        self.counts = [0, 0, 0, 0]
        self.role = self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            if self.high != turn:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = turn
        if fault:
            self.counts[fault - 1] += 1
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.role = role
        must_go = fault in (BLANK, DUPLICATE)
        grown, self.layer, back = step(self.layer, role[:1], must_go, fault == CUT)
        self.cost += grown
        self.back.append(back)
        self.rows.append((role, "" if must_go else text))
        self.bytes += len(self.rows[-1][1])
        if len(self.rows) >= SEGMENT or self.bytes >= SEGMENT_BYTES:
            self.settle()

    def settle(self) -> None:
        """Carry every live path over the segment and forget its rows."""
        after = {}
        for state, _, _ in self.layer:
            letters, at = [], state
            for back in reversed(self.back):
                at, edit = back[at]
                letters.append(edit)
            audit = "".join(reversed(letters))
            parent, digest, some = self.paths[at]
            digest = digest.copy()
            for letter, role, row in replay(at, audit, iter(self.rows)):
                if letter != DELETE:
                    line = f"{role or row[0]}:{row[1] if row else ''}"
                    digest.update((b"\n" if some else b"") + line.encode("utf-8", "surrogatepass"))
                    some = True
            after[state] = ((parent, audit), digest, some)
        self.paths, self.rows, self.back, self.bytes = after, [], [], 0

    def end(self) -> tuple:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``"""
        self.settle()
        more, state, letters = close(self.layer)
        node, digest, some = self.paths[state]
        for _, role, _ in replay(state, letters, iter(())):
            digest.update((b"\n" if some else b"") + f"{role}:".encode())
            some = True
        parts = [letters]
        while node:
            node, part = node
            parts.append(part)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts, self.cost + more, "".join(reversed(parts)), digest.hexdigest())


# ---- rows and faults

BLANK, DUPLICATE, CUT = 1, 2, 3
SOLID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
ROWS = ["conv_id", "turn", "role", "text", "fault"]
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _space(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults planted by a checksum of id and turn: of ``% 20``, 0 drops a row, 1 empties
    its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes it the user's.

    ``conv_id, turn, role, text, gone``; a dropped row stays with ``gone`` and without role and text, so that its conversation is known.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    drawn = conversations.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), (F.crc32(key) % 20).cast("int").alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    gone = F.col("draw") == 0
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return drawn.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted, with the first fault of each (0: none); ``gone`` rows have a null fault."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", F.when(~gone, _space("role")).alias("role"), F.when(~gone, _space("text")).alias("text"))
    dealt = rows.repartition(scratch.width(rows.sparkSession), "conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    fault = F.when(F.col("text").isNull(), None).when(~F.col("text").rlike(SOLID), BLANK).when(again, DUPLICATE).when(~F.col("text").rlike(ENDED), CUT).otherwise(0)
    return dealt.select("conv_id", "turn", "role", "text", fault.alias("fault")).sortWithinPartitions("conv_id", "turn", "role", "text", "fault")


def _by_row(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[Walk]:
    walk = None
    for conv, turn, role, text, fault in _by_row(batches):
        if walk is None or walk.conv != conv:
            if walk is not None:
                yield walk
            walk = Walk(conv)
        if fault is not None:
            walk.add(turn, role, text, fault)
    if walk is not None:
        yield walk


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows, size = [], 0
    for walk in _walks(batches):
        rows.append(walk.end())
        size += 200 + len(rows[-1][7])
        if size >= 4 << 20:
            yield packed(rows)
            rows, size = [], 0
    if rows:
        yield packed(rows)


def digests(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of each conversation; ``conversations`` may have ``gone`` rows as from :func:`damage`."""
    return ordered(conversations).mapInArrow(_digests, DIGEST)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, place`` (from 0), ``turn`` (null: inserted), ``role, text, edit``.

    Audit strings come first (:func:`digests`, written to the shared folder); a second pass over the sorted
    rows replays each beside its rows, so no conversation is held.
    """
    audits = scratch.save(digests(conversations).select("conv_id", "audit"), "audits")
    rows = ordered(conversations).where("fault IS NOT NULL").withColumn("audit", F.lit(None).cast("string"))
    heads = audits.select("conv_id", *(F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "int"))), "audit")
    both = heads.unionByName(rows).repartition(scratch.width(conversations.sparkSession), "conv_id")
    both = both.sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text", "fault")

    def edits(batches):
        """Every edit with its row; a head starts a conversation and its last insertions end it."""
        audit, at, state, conv, place = "", 0, START, None, 0

        def inserted(stop):
            nonlocal at, state, place
            while at < stop and audit[at] == INSERT:
                role = wanted(state)
                yield conv, place, None, role, "", INSERT
                state, at, place = follow(state, role[0]), at + 1, place + 1

        for c, turn, role, text, _, head in _by_row(batches):
            if head is not None:
                yield from inserted(len(audit))
                audit, at, state, conv, place = head, 0, START, c, 0
                continue
            yield from inserted(len(audit))
            edit, at = audit[at], at + 1
            if edit != DELETE:
                role = wanted(state) if edit == REROLE else role
                yield conv, place, turn, role, text, edit
                state, place = follow(state, role[:1]), place + 1
        yield from inserted(len(audit))

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        held, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["conv_id", "place", "turn", "role", "text", "edit"])
        for row in edits(batches):
            held.append(row)
            size += 100 + len(row[4])
            if size >= 4 << 20:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    return both.mapInArrow(run, "conv_id long, place long, turn long, role string, text string, edit string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql() -> str:
    """The same by a recursive walk over whole strings: each state is a struct of cost, audit and text, the least of which is best."""
    ins = lambda e, role: f"{{'c': {e}.c + 2, 'a': {e}.a || 'I', 't': {e}.t || chr(10) || '{role}:'}}"
    gone = lambda e: f"{{'c': {e}.c + 3, 'a': {e}.a || 'D', 't': {e}.t}}"
    kept = lambda e, initial: f"CASE WHEN first = '{initial}' AND fault NOT IN (1, 2) THEN {{'c': {e}.c + cut, 'a': {e}.a || 'K', 't': {e}.t || line}} END"
    named = lambda e, role: f"CASE WHEN fault NOT IN (1, 2) THEN {{'c': {e}.c + 2 + cut, 'a': {e}.a || 'R', 't': {e}.t || chr(10) || '{role}:' || text}} END"
    to_user = ", ".join(f"{kept(e, 'u')}, {named(e, 'user')}" for e in ("e0", "e1", "e3"))
    space = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
  list_reduce(range(8), lambda d, i: xor(d >> 1, (d & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS draw FROM k),
d AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
  CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE draw WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
f AS (SELECT *, left(role, 1) AS first, chr(10) || role || ':' || text AS line, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][{space}]*\z') THEN 3 ELSE 0 END AS fault,
  (fault = 3)::INTEGER AS cut FROM n),
w AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {{'c': 1000000000, 'a': '', 't': ''}} AS s1, s1 AS s2, s1 AS s3
    FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, {gone("e0")}, least({gone("e1")}, {kept("e0", "s")}), least({gone("e2")}, {to_user}),
      least({gone("e3")}, {kept("e2", "a")}, {named("e2", "assistant")})
    FROM (SELECT conv_id, i, first, fault, cut, line, text, e0, e1, e2, least(s3, {ins("e2", "assistant")}) AS e3
      FROM (SELECT w.conv_id, f.i, first, fault, cut, line, text, s0 AS e0, s1 AS e1, s3, least(s2, {ins("s0", "user")}, {ins("s1", "user")}, {ins("s3", "user")}) AS e2
        FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
l AS (SELECT conv_id, arg_max(least(s0, s3, {ins("s2", "assistant")}, {{'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}}), i) AS x
  FROM w GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1)::BIGINT AS blank, count_if(fault = 2)::BIGINT AS duplicate,
  count_if(fault = 3)::BIGINT AS truncated, count_if(i > 1 AND before || first NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, x.c AS cost, x.a AS audit, sha256(substr(x.t, 2)) AS repaired_sha256
FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id
"""


SQL = _sql()
