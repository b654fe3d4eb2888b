"""Shape search against all pairs, with small blocks, bars and rivals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import shapes
from corpusmill.operators import shape_matching as m

SHAPES = "id long, label string, outlines array<array<struct<x:double,y:double>>>"


def drawn(n, seed):
    rnd = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        turn = np.linspace(0, 2 * np.pi, 24, endpoint=False)
        kind = k % 6
        r = 1 + 0.2 * (kind % 3) * np.cos((2 + kind % 3) * turn) + rnd.normal(0, 0.02, 24)
        outer = np.stack([r * np.cos(turn) * (1 + kind // 3), r * np.sin(turn)], 1)
        outlines = [outer] + ([outer * 0.4] if kind % 2 else [])
        rows.append((k, f"s{kind}", [[{"x": float(x), "y": float(y)} for x, y in o] for o in outlines[::-1]]))
    return [*rows, (n, "none", None), (n + 1, "none", []), (n + 2, "none", [[{"x": 1.0, "y": 1.0}] * 5])]


def plain_distance(a, b):
    """Two outline lists, largest first, in the unit square; None where the structure differs."""
    if len(a[2]) != len(b[2]) or abs(a[0] - b[0]) > 0.22 * max(a[0], b[0]) or any(abs(x - y) > 0.08 for x, y in zip(a[1], b[1], strict=True)):
        return None
    total = 0.0
    for p, q in zip(a[2], b[2], strict=True):
        near = lambda u, v: sum(min(((x - z) ** 2 + (y - w) ** 2) ** 0.5 for z, w in v) for x, y in u)
        total += (near(p, q) + near(q, p)) / (len(p) + len(q))
    return total / len(a[2])


def plain_signature(outlines, points):
    outlines = [np.array([(p["x"], p["y"]) for p in o]) for o in outlines]
    outlines.sort(key=lambda o: -abs(shapes.area(o)))
    every = np.concatenate(outlines)
    low, high = every.min(0), every.max(0)
    areas = [abs(shapes.area(o)) for o in outlines]
    return (high[0] - low[0]) / (high[1] - low[1]), [x / sum(areas) for x in areas], [((shapes.resample(o, points) - low) / max(high - low)).tolist() for o in outlines]


@pytest.mark.parametrize("block", [3, 2048])
def test_outlines_equal_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "SLICE", block)
    rows = drawn(40, 1)
    signs = m.signatures(spark.createDataFrame(rows, SHAPES), 16)
    assert signs.count() == 40
    got = {r.id: r for r in m.match_outlines(signs, signs, 0.05, 0.004).collect()}
    made = {i: plain_signature(o, 16) for i, _, o in rows[:40]}
    for i, _, _ in rows[:40]:
        by = {}
        for j, label, _ in rows[:40]:
            d = plain_distance(made[i], made[j]) if i != j else None
            if d is not None and d <= 0.054:
                by[label] = min(by.get(label, 9), round(d, 6))
        best = sorted((d, x) for x, d in by.items())
        assert (got[i].label, got[i].distance) == ((best[0][1], pytest.approx(best[0][0], abs=2e-6)) if best else (None, None))
        assert got[i].accepted == bool(best and best[0][0] <= 0.05 and (len(best) == 1 or best[1][0] - best[0][0] >= 0.004))


def masks(n, seed):
    rnd = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        g = np.zeros((8, 8), bool)
        g[1 + k % 3 : 6, 2:6] = True
        g[k % 4 + 1, 3] = False
        g ^= rnd.random((8, 8)) < 0.03
        rows.append((k, f"m{k % 4}", g.ravel().tolist()))
    return [*rows, (n, "x", [False] * 64), (n + 1, "x", None), (n + 2, "x", [True] * 7)]


def test_rasters_equal_all_pairs_and_rivals_decide(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 5)
    rows = masks(30, 2)
    rasters = m.raster_rows(spark.createDataFrame(rows, "id long, label string, mask array<boolean>"), 8)
    assert rasters.count() == 30
    got = {r.id: r for r in m.match_rasters(rasters, rasters, 8).collect()}

    def distance(a, b):
        ca, cb = (np.argwhere(np.array(x).reshape(8, 8)) for x in (a, b))
        octile = lambda p, q: max(abs(p - q)) + (2**0.5 - 1) * min(abs(p - q))
        there = np.mean([min(octile(p, q) for q in cb) for p in ca])
        back = np.mean([min(octile(p, q) for p in ca) for q in cb])
        aspect = [(np.ptp(c[:, 1]) + 1) / (np.ptp(c[:, 0]) + 1) for c in (ca, cb)]
        return ((there + back) / 2 + 2 * abs(np.log(aspect[0] / aspect[1]))) / 8 if 0.45 <= aspect[0] / aspect[1] <= 2.2 else None

    second = {}
    for i, _, a in rows[:30]:
        by = {}
        for j, label, b in rows[:30]:
            d = distance(a, b) if i != j else None
            if d is not None:
                by[label] = min(by.get(label, 9), round(d, 6))
        best = sorted((d, x) for x, d in by.items())
        second[i] = best[1][1]
        assert (got[i].label, got[i].distance) == (best[0][1], pytest.approx(best[0][0], abs=2e-6))
    one = next(i for i, r in got.items() if r.accepted)
    pair = spark.createDataFrame([(got[one].label, second[one], "alias")], "label string, next string, relation string")
    assert not {r.id: r for r in m.match_rasters(rasters, rasters, 8, rivals=pair).collect()}[one].accepted
    free = pair.withColumn("relation", F.lit("composition"))
    strict = {r.id: r.accepted for r in m.match_rasters(rasters, rasters, 8, margin=9.0, rivals=free).collect()}
    assert strict[one] and not all(strict.values())
    assert not {r.id: r for r in m.match_rasters(rasters, rasters, 8, bars={got[one].label: 9.0}).collect()}[one].accepted


def test_fonts_need_enough_codes(spark):
    rows = drawn(36, 3)[:36]
    signs = m.signatures(spark.createDataFrame(rows, SHAPES), 16).withColumn("font", F.concat(F.lit("f"), (F.col("id") % 2).cast("string"))).withColumn("code", F.expr("id div 2 % 9"))
    got = m.identify_fonts(signs, signs, 6).collect()
    assert {(r.font, r.name) for r in got if r["rank"] == 1} == {("f0", "f0"), ("f1", "f1")}
    assert all(r.codes == 9 and (r.distance == 0) == (r.font == r.name) for r in got)
    assert m.identify_fonts(signs, signs.where("code < 5"), 6).count() == 0


def test_no_shapes(spark):
    empty = m.signatures(spark.createDataFrame([], SHAPES))
    assert m.match_outlines(empty, empty).count() == 0
