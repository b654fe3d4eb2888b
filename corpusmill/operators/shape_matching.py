"""Shapes against labelled shapes: outlines, rasters, and whole fonts, by exact search in blocks.

A shape can only match one of like aspect, so both sides are banded by its logarithm, references in their
own band and the two beside it.  A band's references are split into blocks and its queries into slices,
as many as their numbers ask for; a task holds one block and streams one slice past it, so no pair is a row and no
band, however full, is one task's.  Within a block the triangle inequality rules most out: a
point of one outline is at least as far from another outline as their distances from a pivot differ.  What is
left is measured exactly, and only the best two labels of a block go on.

Results are those of all pairs.  References beyond ``most + margin`` never decide, so they aren't
reported; a query that none is near enough has nulls.  Ties go to the smaller label.  Null or degenerate shapes
(fewer than two points, no ink) match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes
from ..plans.catalog import Catalog, load

C = Catalog()

BLOCK = 2048
SLICE = 20_000
ASPECT_OFF, AREA_OFF = 0.22, 0.08
ASPECT_LOW, ASPECT_HIGH = 0.45, 2.2
PIVOTS = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0], [0.5, 0.5]])

SHAPE = "id long, label string, count int, log_aspect double, data binary"


# ---- outlines


class Outlines:
    """Unpacked signatures of as many outlines each: areas by size, and points in the unit square."""

    def __init__(self, rows: list[bytes], count: int):
        flat = np.array([np.frombuffer(r) for r in rows]).reshape(len(rows), -1)
        self.aspect, self.areas = flat[:, 0], flat[:, 1 : 1 + count]
        self.points = flat[:, 1 + count :].reshape(len(rows), count, -1, 2)
        radius = np.sqrt(((self.points[:, :, :, None] - PIVOTS) ** 2).sum(-1))
        self.mean, self.low, self.high = radius.mean(2), radius.min(2), radius.max(2)


def signature(outlines: list[np.ndarray], points: int | None) -> tuple[int, float, bytes] | None:
    """Number, logarithm of the aspect, and packed areas and points of a shape; largest outline first."""
    outlines = [np.asarray(o, float) for o in outlines if o is not None and len(o) > 1]
    if not outlines:
        return None
    area = np.array([abs(shapes.area(o)) for o in outlines])
    order = np.argsort(-area, kind="stable")
    everything = np.concatenate(outlines)
    low, span = everything.min(0), np.ptp(everything, axis=0)
    aspect = float(span[0] / span[1]) if span[1] > 0 else 1.0
    if span.max() <= 0 or aspect <= 0:
        return None
    made = [(shapes.resample(outlines[k], points) if points else outlines[k]) - low for k in order]
    flat = np.concatenate([m.ravel() for m in made]) / span.max()
    return len(outlines), float(np.log(aspect)), np.r_[aspect, area[order] / max(float(area.sum()), 1e-300), flat].tobytes()


def signatures(shapes_: DataFrame, points: int | None = 64) -> DataFrame:
    """``SHAPE`` rows of ``id, label, outlines`` (``array<array<struct<x, y>>>``), resampled to ``points`` an outline.

    With ``points`` None the given ones are taken, of which every outline must then have as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, outlines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = signature([[(p["x"], p["y"]) for p in o] for o in outlines or [] if o], points)
                rows += [(i, label, *s)] if s else []
            yield _packed(rows)

    return shapes_.select("id", "label", "outlines").mapInArrow(run, SHAPE)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in SHAPE.split(", ")])


def _clouds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean distance to the nearest point, both ways, of one outline (points, 2) to each of (shapes, points, 2)."""
    d = np.sqrt(((a[None, :, None] - b[:, None]) ** 2).sum(-1))
    return (d.min(2).sum(1) + d.min(1).sum(1)) / (a.shape[0] + b.shape[1])


def outline_distances(cutoff: float) -> Callable:
    """Distances of queries to a block of references, infinite beyond ``cutoff`` or where the structure differs."""

    def measure(queries: list[bytes], refs: Outlines, count: int) -> np.ndarray:
        q = Outlines(queries, count)
        out = np.full((len(queries), len(refs.aspect)), np.inf)
        for i in range(len(queries)):
            like = np.abs(q.aspect[i] - refs.aspect) <= ASPECT_OFF * np.maximum(q.aspect[i], refs.aspect)
            like &= (np.abs(q.areas[i] - refs.areas) <= AREA_OFF).all(1)
            at = np.flatnonzero(like)
            # by the triangle inequality, and as the distance to an interval is convex, means bound means
            there = np.maximum(0, np.maximum(refs.low[at] - q.mean[i], q.mean[i] - refs.high[at]))
            back = np.maximum(0, np.maximum(q.low[i] - refs.mean[at], refs.mean[at] - q.high[i]))
            at = at[((there + back) / 2).max(2).mean(1) <= cutoff]
            for lo in range(0, len(at), 256):
                some = at[lo : lo + 256]
                out[i, some] = np.mean([_clouds(q.points[i, k], refs.points[some, k]) for k in range(count)], axis=0)
        out[out > cutoff] = np.inf
        return out

    return measure


# ---- rasters


def raster_rows(masks: DataFrame, size: int) -> DataFrame:
    """``SHAPE`` rows of ``id, label, mask`` (``array<boolean>``, ``size * size`` cells by row); aspect is that of the inked box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = np.array([bool(x) for x in mask or []], bool)
                if len(m) == size * size and m.any():
                    y, x = np.nonzero(m.reshape(size, size))
                    rows.append((i, label, 1, float(np.log((np.ptp(x) + 1) / (np.ptp(y) + 1))), m.astype(np.uint8).tobytes()))
            yield _packed(rows)

    return masks.select("id", "label", "mask").mapInArrow(run, SHAPE)


class Rasters:
    def __init__(self, rows: list[bytes], size: int):
        self.mask = np.array([np.frombuffer(r, np.uint8) for r in rows], bool).reshape(len(rows), size, size)
        self.field = shapes.distance_field(self.mask).reshape(len(rows), -1)
        cells = [np.nonzero(m) for m in self.mask]
        self.aspect = np.array([(np.ptp(x) + 1) / (np.ptp(y) + 1) for y, x in cells])
        self.mask = self.mask.reshape(len(rows), -1).astype(float)


def raster_distances(size: int) -> Callable:
    """Mean distance of each one's ink to the other's, both ways, with a penalty for the aspect, in sizes; two matrix products."""

    def measure(queries: list[bytes], refs: Rasters, count: int) -> np.ndarray:
        q = Rasters(queries, size)
        there = q.mask @ refs.field.T / q.mask.sum(1)[:, None]
        back = q.field @ refs.mask.T / refs.mask.sum(1)
        ratio = q.aspect[:, None] / refs.aspect
        d = ((there + back) / 2 + 2 * np.abs(np.log(ratio))) / size
        return np.where((ratio >= ASPECT_LOW) & (ratio <= ASPECT_HIGH), d, np.inf)

    return measure


# ---- search


def _two_best(queries: DataFrame, refs: DataFrame, width: float, measure: Callable, unpack: Callable) -> DataFrame:
    """``id, label, distance, ref``: the nearest reference of the two nearest labels or more of each query."""
    spark = queries.sparkSession
    band = lambda off=0: (F.floor(F.col("log_aspect") / width) + off).cast("int")
    q = queries.select("*", band().alias("band"))
    r = refs.select("*", F.explode(F.array(*[band(off) for off in (-1, 0, 1)])).alias("band"))
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    grid = r.groupBy("count", "band").agg(F.count(F.lit(1)).alias("refs")).join(q.groupBy("count", "band").agg(F.count(F.lit(1)).alias("queries")), ["count", "band"])
    grid = grid.select("count", "band", parts("refs", BLOCK).alias("blocks"), parts("queries", SLICE).alias("slices"))
    draw = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["count", "band", "block", "slice", "query", "id", "label", "data"]
    refs_ = r.join(grid, ["count", "band"]).select("*", draw("blocks").alias("block"), F.lit(False).alias("query")).select("*", spread("slices").alias("slice")).select(cols)
    queries_ = q.join(grid, ["count", "band"]).select("*", draw("slices").alias("slice"), F.lit(True).alias("query")).select("*", spread("blocks").alias("block")).select(cols)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = refs_.unionByName(queries_).repartition(n, "count", "band", "block", "slice").sortWithinPartitions("count", "band", "block", "slice", "query", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, ids, labels = None, [], None, None, None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            asked, id_, label, data = (batch.column(k).to_pylist() for k in range(4, 8))
            at = 0
            while at < len(keys):
                stop = at
                while stop < len(keys) and stop - at < 512 and keys[stop] == keys[at] and asked[stop] == asked[at]:
                    stop += 1
                if keys[at] != key:
                    key, held, block = keys[at], [], None
                if not asked[at]:
                    held += zip(id_[at:stop], label[at:stop], data[at:stop], strict=True)
                elif held:
                    if block is None:
                        block = unpack([h[2] for h in held], key[0])
                        ids, (labels, of) = np.array([h[0] for h in held]), np.unique([h[1] for h in held], return_inverse=True)
                    d = measure(data[at:stop], block, key[0])
                    d[np.array(id_[at:stop])[:, None] == ids] = np.inf
                    rows = [(i, *found) for i, line in zip(id_[at:stop], d, strict=True) for found in _nearest_two(line, of, labels, ids)]
                    cols = list(zip(*rows, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["id", "label", "distance", "ref"])
                at = stop

    return dealt.mapInArrow(run, "id long, label string, distance double, ref long")


def _nearest_two(line: np.ndarray, of: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> list[tuple]:
    near = np.flatnonzero(np.isfinite(line))
    found: dict[int, tuple] = {}
    for k in near[np.lexsort((ids[near], of[near], line[near]))].tolist():
        if of[k] not in found:
            found[int(of[k])] = (str(labels[of[k]]), float(line[k]), int(ids[k]))
            if len(found) == 2:
                break
    return list(found.values())


def _decided(queries: DataFrame, pairs: DataFrame, most: float, margin: Column, rivals: DataFrame | None) -> DataFrame:
    """``id, label, distance, margin, accepted`` of each query."""
    pairs = pairs.withColumn("distance", F.round("distance", 6))
    best = pairs.groupBy("id", "label").agg(F.min("distance").alias("d")).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "label"))), 1, 2).alias("b"))
    best = best.select("id", F.col("b")[0]["label"].alias("label"), F.col("b")[0]["d"].alias("distance"), F.get("b", F.lit(1))["label"].alias("next"), F.round(F.get("b", F.lit(1))["d"] - F.col("b")[0]["d"], 6).alias("margin"))
    exempt = alike = F.lit(False)
    if rivals is not None:
        best = best.join(rivals.select("label", "next", "relation"), ["label", "next"], "left")
        exempt, alike = F.coalesce(F.col("relation") == "composition", F.lit(False)), F.coalesce(F.col("relation") == "alias", F.lit(False))
    clear = F.col("margin").isNull() | exempt | (F.col("margin") >= margin)
    best = best.select("id", "label", "distance", "margin", ((F.col("distance") <= most) & clear & ~alike).alias("accepted"))
    return queries.select("id").join(best, "id", "left").select("id", "label", "distance", "margin", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def match_outlines(queries: DataFrame, refs: DataFrame, most: float = 0.08, margin: float = 0.004) -> DataFrame:
    """``id, label, distance, margin, accepted``: the nearest label of each outline signature, accepted when near and clear of the next label."""
    pairs = _two_best(queries, refs, -float(np.log(1 - ASPECT_OFF)), outline_distances(most + margin), Outlines)
    return _decided(queries, pairs, most, F.lit(margin), None)


def match_rasters(queries: DataFrame, refs: DataFrame, size: int, most: float = 0.12, margin: float = 0.0016, bars: dict[str, float] | None = None, rivals: DataFrame | None = None) -> DataFrame:
    """The nearest label of each raster.  ``bars`` gives labels a margin of their own; ``rivals`` (``label, next, relation``)
    names labels that need none against each other (``composition``) or that shape can't tell apart (``alias``)."""
    pairs = _two_best(queries, refs, -float(np.log(ASPECT_LOW)), raster_distances(size), lambda rows, _: Rasters(rows, size))
    bar = F.lit(margin)
    for label, value in (bars or {}).items():
        bar = F.when(F.col("label") == label, value).otherwise(bar)
    return _decided(queries, pairs, most, bar, rivals)


def identify_fonts(embedded: DataFrame, known: DataFrame, least: int = 6, penalty: float = 0.03) -> DataFrame:
    """``font, name, distance, codes, rank``: candidates for each embedded font by mean distance over the codes both have.

    Both are ``font, code`` with a signature (``count, data``); of a code that a font has twice the first by ``id`` counts.  Shapes of another
    structure are compared by their largest outlines, with a penalty for each outline more.
    """
    first = lambda df, name: df.groupBy(F.col("font").alias(name), "code").agg(F.min(F.struct("id", "count", "data")).alias(f"{name}_shape"))
    pairs = first(embedded, "mine").join(first(known, "theirs"), "code").select("mine", "theirs", F.col("mine_shape.count").alias("n"), F.col("mine_shape.data").alias("a"), F.col("theirs_shape.count").alias("m"), F.col("theirs_shape.data").alias("b"))

    def distance(n: int, a: bytes, m: int, b: bytes) -> float:
        x, y = Outlines([a], n), Outlines([b], m)
        like = n == m and abs(x.aspect[0] - y.aspect[0]) <= ASPECT_OFF * max(x.aspect[0], y.aspect[0]) and bool((np.abs(x.areas - y.areas) <= AREA_OFF).all())
        if like:
            return float(np.mean([_clouds(x.points[0, k], y.points[:, k])[0] for k in range(n)]))
        return float(_clouds(x.points[0, 0], y.points[:, 0])[0]) + penalty * abs(n - m)

    def run(batches):
        for batch in batches:
            d = [distance(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], ["font", "name", "d"])

    means = pairs.mapInArrow(run, "font string, name string, d double").groupBy("font", "name").agg(F.round(F.avg("d"), 6).alias("distance"), F.count(F.lit(1)).alias("codes")).where(F.col("codes") >= least)
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("font").orderBy("distance", "name")))


# ---- queries: the vectors as drawn shapes


def _outlines(spark, sf) -> DataFrame:
    """Two outlines of sixteen points from each vector."""
    point = lambda k: F.struct(F.get("embedding", F.lit(2 * k)).cast("double").alias("x"), F.get("embedding", F.lit(2 * k + 1)).cast("double").alias("y"))
    outline = lambda lo: F.array(*[point(k) for k in range(lo, lo + 16)])
    return signatures(load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.array(outline(0), outline(16)).alias("outlines")), None)


_SIGNS = """
WITH p AS (SELECT vec_id AS id, label::VARCHAR AS label, k // 16 AS o, k % 16 AS i, embedding[2 * k + 1]::DOUBLE AS x, embedding[2 * k + 2]::DOUBLE AS y FROM (SELECT *, unnest(range(32)) AS k FROM embeddings)),
box AS (SELECT id, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h FROM p GROUP BY id),
n AS (SELECT a.id, a.o, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM p a JOIN p b ON a.id = b.id AND a.o = b.o AND b.i = (a.i + 1) % 16 GROUP BY ALL),
s AS (SELECT id, o, row_number() OVER (PARTITION BY id ORDER BY area DESC, o) AS k, area / sum(area) OVER (PARTITION BY id) AS share FROM n),
t AS (SELECT id, w / h AS aspect, max(share) AS top FROM s JOIN box USING (id) GROUP BY ALL),
u AS (SELECT p.id, label, k, i, (x - x0) / greatest(w, h) AS x, (y - y0) / greatest(w, h) AS y FROM p JOIN box USING (id) JOIN s ON s.id = p.id AND s.o = p.o)"""


@C.add("outline_match", _SIGNS + """,
c AS (SELECT a.id, b.id AS ref FROM t a JOIN t b ON a.id % 100 = 0 AND a.id <> b.id AND abs(a.aspect - b.aspect) <= 0.22 * greatest(a.aspect, b.aspect) AND abs(a.top - b.top) <= 0.08),
d AS (SELECT c.id, c.ref, a.k, a.i AS ai, b.i AS bi, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS v FROM c JOIN u a ON a.id = c.id JOIN u b ON b.id = c.ref AND a.k = b.k),
e AS (SELECT id, ref, k, sum(v) AS v FROM (SELECT id, ref, k, min(v) AS v FROM d GROUP BY id, ref, k, ai UNION ALL SELECT id, ref, k, min(v) FROM d GROUP BY id, ref, k, bi) GROUP BY ALL),
f AS (SELECT e.id, l.label, round(min(v), 6) AS v FROM (SELECT id, ref, avg(v / 32) AS v FROM e GROUP BY ALL) e JOIN (SELECT DISTINCT id, label FROM p) l ON l.id = e.ref WHERE v <= 0.14 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, lead(v) OVER w AS other FROM f WINDOW w AS (PARTITION BY id ORDER BY v, label))
SELECT t.id, r.label, r.v AS distance, round(other - v, 6) AS margin, coalesce(v <= 0.13 AND coalesce(round(other - v, 6) >= 0.01, TRUE), FALSE) AS accepted FROM t LEFT JOIN r ON r.id = t.id AND r.k = 1 WHERE t.id % 100 = 0""")
def outline_match(spark, sf):
    """Every hundredth vector's outlines against those of all others."""
    all_ = _outlines(spark, sf)
    return match_outlines(all_.where("id % 100 = 0"), all_, 0.13, 0.01)


@C.add("raster_match", """
WITH c AS (SELECT vec_id AS id, label::VARCHAR AS label, k // 8 AS y, k % 8 AS x FROM (SELECT *, unnest(range(64)) AS k FROM embeddings) WHERE embedding[k + 1] > 0),
s AS (SELECT id, label, (max(x) - min(x) + 1) / (max(y) - min(y) + 1) AS aspect FROM c GROUP BY ALL),
p AS (SELECT a.id, b.id AS ref, b.label, abs(ln(a.aspect / b.aspect)) AS off FROM s a JOIN s b ON a.id % 100 = 0 AND a.id <> b.id AND a.aspect / b.aspect BETWEEN 0.45 AND 2.2),
d AS (SELECT p.id, p.ref, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy, greatest(abs(a.x - b.x), abs(a.y - b.y)) + (sqrt(2) - 1) * least(abs(a.x - b.x), abs(a.y - b.y)) AS v FROM p JOIN c a ON a.id = p.id JOIN c b ON b.id = p.ref),
m AS (SELECT id, ref, avg(v) AS v FROM (SELECT id, ref, ax, ay, min(v) AS v FROM d GROUP BY ALL) GROUP BY ALL UNION ALL SELECT id, ref, avg(v) FROM (SELECT id, ref, bx, byy, min(v) AS v FROM d GROUP BY ALL) GROUP BY ALL),
f AS (SELECT id, label, round(min(v), 6) AS v FROM (SELECT p.id, p.label, (avg(m.v) + 2 * any_value(off)) / 8 AS v FROM p JOIN m USING (id, ref) GROUP BY p.id, p.ref, p.label) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, lead(v) OVER w AS other FROM f WINDOW w AS (PARTITION BY id ORDER BY v, label))
SELECT s.id, r.label, r.v AS distance, round(other - v, 6) AS margin, coalesce(v <= 0.12 AND coalesce(round(other - v, 6) >= 0.0016, TRUE), FALSE) AS accepted FROM s LEFT JOIN r ON r.id = s.id AND r.k = 1 WHERE s.id % 100 = 0""")
def raster_match(spark, sf):
    """Every hundredth vector, drawn as eight by eight cells, against all others."""
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: v > 0).alias("mask"))
    all_ = raster_rows(e, 8)
    return match_rasters(all_.where("id % 100 = 0"), all_, 8)


@C.add("font_identification", _SIGNS + """,
g AS (SELECT id % 2 AS side, label AS font, id // 2 % 40 AS code, min(id) AS id FROM (SELECT DISTINCT id, label FROM p) GROUP BY ALL),
c AS (SELECT a.font, b.font AS name, a.id, b.id AS ref FROM g a JOIN g b ON a.side = 1 AND b.side = 0 AND a.code = b.code),
like_ AS (SELECT c.*, abs(a.aspect - b.aspect) <= 0.22 * greatest(a.aspect, b.aspect) AND abs(a.top - b.top) <= 0.08 AS same FROM c JOIN t a ON a.id = c.id JOIN t b ON b.id = c.ref),
d AS (SELECT c.font, c.name, c.id, c.ref, a.k, a.i AS ai, b.i AS bi, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS v FROM like_ c JOIN u a ON a.id = c.id JOIN u b ON b.id = c.ref AND a.k = b.k WHERE same OR a.k = 1),
e AS (SELECT font, name, id, ref, k, sum(v) AS v FROM (SELECT font, name, id, ref, k, min(v) AS v FROM d GROUP BY font, name, id, ref, k, ai UNION ALL SELECT font, name, id, ref, k, min(v) FROM d GROUP BY font, name, id, ref, k, bi) GROUP BY ALL),
m AS (SELECT font, name, round(avg(v), 6) AS distance, count(*) AS codes FROM (SELECT font, name, id, ref, avg(v / 32) AS v FROM e GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 6)
SELECT *, row_number() OVER (PARTITION BY font ORDER BY distance, name)::INTEGER AS rank FROM m""")
def font_identification(spark, sf):
    """Vectors of odd ids as embedded fonts (their label), those of even ids as known ones; forty codes."""
    all_ = _outlines(spark, sf).select("*", F.col("label").alias("font"), F.expr("id div 2 % 40").alias("code"))
    return identify_fonts(all_.where("id % 2 = 1"), all_.where("id % 2 = 0"))
