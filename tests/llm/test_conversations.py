"""Conversation repair against an exhaustive search by cost and audit, and its rows."""

import hashlib
import heapq
import random

import pytest

from corpusmill.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """``cost, audit, repaired turns`` of ``(role, text, fault)``: all edits by rising cost, then audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (audit, state) in done:
            continue
        done.add((audit, state))
        for role in ("user", "assistant"):
            if role[0] in GRAMMAR[state] and not audit.endswith("III"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, role[0], (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                stays = [("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)]
                for letter, new, price in stays:
                    if new[:1] in GRAMMAR[state]:
                        heapq.heappush(heap, (cost + price + (fault == repair.CUT), audit + letter, at + 1, new[0], (*out, (new, text))))


@pytest.mark.parametrize("segment", [1, 2, 4096])
def test_walk_is_exact(segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "s", "a"]), rng.choice(["x.", "y", "z!"]), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6))]
        walk = repair.Walk(1)
        for turn, (role, text, fault) in enumerate(rows):
            walk.add(turn, role, text, fault)
        cost, audit, out = cheapest(rows)
        end = walk.end()
        assert end[6:8] == (cost, audit)
        assert end[8] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_faults_gaps_and_order(spark):
    rows = [(1, 0, "system", "be kind.", ), (1, 1, "user", "why?"), (1, 1, "user", "why?"), (1, 4, "assistant", "because"), (1, None, "user", " \t"), (2, None, None, None), (None, 3, "user", "hello.")]
    out = {r.conv_id: r for r in repair.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = out[1]
    # the blank row of the null turn is first; turns 2 and 3 are missing
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (2, 1, 1, 1, 2)
    assert (one.cost, one.audit) == (3 + 3 + 1, "DKKDK")
    assert (out[2].gaps, out[2].blank, out[2].cost, out[2].audit, out[2].repaired_sha256) == (0, 1, 3, "D", hashlib.sha256(b"").hexdigest())
    assert (out[None].cost, out[None].audit) == (2, "KI")


def test_repaired_rows_fit_the_digest(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["a.", "b", "", None, "c?"])) for c in range(30) for t in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, SCHEMA)
    digests = {r.conv_id: r for r in repair.digests(df).collect()}
    turns = {}
    for r in sorted(repair.repair(df).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append(r)
    for c, d in digests.items():
        mine = turns.get(c, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == d.repaired_sha256
        assert "".join(r.edit for r in mine) == d.audit.replace("D", "")


def test_one_long_conversation(spark, monkeypatch):
    n = 20_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, '.') AS text")
    (row,) = repair.digests(df).collect()
    assert (row.cost, row.audit) == (0, "K" * n)
    text = "\n".join(f"{'assistant' if k % 2 else 'user'}:turn {k}." for k in range(n))
    assert row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_and_damaged_away(spark):
    assert repair.digests(repair.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = repair.digests(repair.damage(spark.createDataFrame([(5, turn, "user", "x.")], SCHEMA))).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_other_columns_may_clash(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 0, "user", "hi.")], SCHEMA).selectExpr("*", "1 AS fault", "'x' AS copy", "2 AS audit", "0 AS place", "1 AS draw")
    (row,) = repair.digests(repair.damage(df)).collect()
    assert row.duplicate >= 1
    assert repair.repair(df).count() == 2
