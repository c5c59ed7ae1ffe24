"""Valid and united polygons: one sweep over a set of rings, and what is built on it.

Between two neighbouring vertices or crossings no edges cross, so that edges have one order there; what at least one ring
holds (each by the even-odd rule, so that a ring may cross itself) is a stack of trapezoids, whose sides are put together to rings again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.operators.shape import hull

#: Places to which coordinates are rounded where edges meet, and the distance below which two places are one.
PLACES, NEAR = 9, 1e-5


def _edges(rings: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Edges (x0, y0, x1, y1, ring) from left to right; vertical ones and those without length are left out."""
    out = []
    for i, (x, y) in enumerate(rings):
        e = np.column_stack([x, y, np.roll(x, -1), np.roll(y, -1), np.full(len(x), i)])
        back = e[:, 0] > e[:, 2]
        e[back] = e[back][:, [2, 3, 0, 1, 4]]
        out.append(e[e[:, 0] < e[:, 2]])
    return np.concatenate(out) if out else np.zeros((0, 5))


def _crossings(e: np.ndarray) -> np.ndarray:
    """x of all places where two edges cross."""
    out = [np.zeros(0)]
    for i in range(len(e) - 1):
        f = e[i + 1 :]
        f = f[(f[:, 0] < e[i, 2]) & (f[:, 2] > e[i, 0]) & (np.minimum(f[:, 1], f[:, 3]) <= max(e[i, 1], e[i, 3])) & (np.maximum(f[:, 1], f[:, 3]) >= min(e[i, 1], e[i, 3]))]
        a, b = (e[i, 3] - e[i, 1]) / (e[i, 2] - e[i, 0]), (f[:, 3] - f[:, 1]) / (f[:, 2] - f[:, 0])
        apart = a != b
        x = (f[apart, 1] - e[i, 1] + a * e[i, 0] - b[apart] * f[apart, 0]) / (a - b[apart])
        out.append(x[(x > np.maximum(e[i, 0], f[apart, 0])) & (x < np.minimum(e[i, 2], f[apart, 2]))])
    return np.concatenate(out)


def _at(e: np.ndarray, x: float) -> np.ndarray:
    y = e[:, 1] + (e[:, 3] - e[:, 1]) * (x - e[:, 0]) / (e[:, 2] - e[:, 0])
    return np.where(e[:, 0] == x, e[:, 1], np.where(e[:, 2] == x, e[:, 3], y))


def _slabs(rings: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, float, list[tuple[float, float, float, float]]]]:
    """x0, x1 and the trapezoids (low and high y at x0, low and high y at x1) of each strip, from left to right."""
    e = _edges(rings)
    xs = np.unique(np.round(np.concatenate([e[:, 0], e[:, 2], _crossings(e)]), PLACES))
    e[:, :4] = np.round(e[:, :4], PLACES)
    e = e[e[:, 0] < e[:, 2]]
    for x0, x1 in zip(xs[:-1], xs[1:], strict=True):
        live = e[(e[:, 0] <= x0) & (e[:, 2] >= x1)]
        a, b = _at(live, x0), _at(live, x1)
        odd, inside, out = {}, 0, []
        for i in np.lexsort((a, a + b)):
            ring = live[i, 4]
            before = inside
            odd[ring] = not odd.get(ring, False)
            inside += 1 if odd[ring] else -1
            if before == 0:
                low = (a[i], b[i])
            elif inside == 0 and (a[i] > low[0] or b[i] > low[1]):
                if out and out[-1][1] >= low[0] and out[-1][3] >= low[1]:  # one on the other
                    out[-1] = (out[-1][0], a[i], out[-1][2], b[i])
                else:
                    out.append((low[0], a[i], low[1], b[i]))
        yield float(x0), float(x1), out


def _without(spans: list[tuple[float, float]], other: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What of spans is in none of the others."""
    out = []
    for lo, hi in spans:
        for a, b in other:
            if b <= lo or a >= hi:
                continue
            if a > lo:
                out.append((lo, a))
            lo = max(lo, b)
        if hi > lo:
            out.append((lo, hi))
    return out


def united_rings(rings: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Rings of what the given ones hold together: outer ones counter-clockwise, holes clockwise; corners only."""
    slabs = list(_slabs(rings))
    heights: dict[float, set[float]] = {}
    for x0, x1, parts in slabs:
        heights.setdefault(x0, set()).update(float(v) for p in parts for v in p[:2])
        heights.setdefault(x1, set()).update(float(v) for p in parts for v in p[2:])
    # Where edges meet their heights differ by rounding: those of one place that lie close together become one.
    same: dict[tuple[float, float], float] = {}
    for x, ys in heights.items():
        last = None
        for y in sorted(ys):
            if last is None or y - last > NEAR:
                name = y
            last = y
            same[x, y] = name
    follow: dict[tuple[float, float], list[tuple[float, float]]] = {}
    put = lambda a, b: a != b and follow.setdefault(a, []).append(b)
    ends: dict[float, list] = {}
    for x0, x1, parts in slabs:
        for p in parts:
            a, b, c, d = (same[x, float(v)] for x, v in zip((x0, x0, x1, x1), p, strict=True))
            if a == b and c == d:
                continue
            put((x0, a), (x1, c))
            put((x1, d), (x0, b))
            ends.setdefault(x0, [[], []])[1].append((a, b))
            ends.setdefault(x1, [[], []])[0].append((c, d))
    for x, (left, right) in ends.items():
        left, right = ([s for s in side if s[1] > s[0]] for side in (left, right))
        cuts = sorted({v for s in (*left, *right) for v in s})
        for spans, others, up in ((left, right, True), (right, left, False)):
            for lo, hi in _without(spans, others):
                stops = [lo, *[c for c in cuts if lo < c < hi], hi]
                for a, b in zip(stops[:-1], stops[1:], strict=True):
                    put(*(((x, a), (x, b)) if up else ((x, b), (x, a))))
    out = []
    while follow:
        at = start = min(follow)
        ring, way = [], None
        while True:
            nexts = follow[at]
            # Where rings touch, the sharpest turn to the right leaves the inside of each in one piece.
            pick = nexts[0] if way is None or len(nexts) == 1 else max(nexts, key=lambda n: math.pi if n == ring[-1] and len(nexts) > 1 else (math.atan2(n[1] - at[1], n[0] - at[0]) - way + math.pi) % (2 * math.pi))
            nexts.remove(pick)
            if not nexts:
                del follow[at]
            ring.append(at)
            way = math.atan2(pick[1] - at[1], pick[0] - at[0])
            at = pick
            if at == start:
                break
        p = np.array(ring)
        p = p[np.hypot(*(p - np.roll(p, 1, axis=0)).T) > NEAR]
        a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
        bend = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-6 * np.hypot(*a.T) * np.hypot(*b.T)
        if bend.sum() >= 3:
            out.append(p[bend])
    return out


def ring_area(p: np.ndarray) -> float:
    return float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2


def united(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring, hole, xs, ys, area of polygons(keys, xs, ys): the rings of the union of all polygons of one key, holes with
    negative area; outer rings first, each from its least corner.

    A ring that crosses itself counts by the even-odd rule, so that a key of one polygon is that polygon made valid. Rings
    of fewer than three corners, null ones and such without area go. One key's rings (a cell's planes, a region's parts)
    are swept at once.
    """
    good = polygons.where(F.col("xs").isNotNull() & F.col("ys").isNotNull() & (F.size("xs") >= 3) & (F.size("xs") == F.size("ys")))
    good = good.select(*keys, F.transform("xs", lambda v: v.cast("double")).alias("xs"), F.transform("ys", lambda v: v.cast("double")).alias("ys"))
    each = good.groupBy(*keys).agg(F.collect_list(F.struct("xs", "ys")).alias("__p"))
    schema = ", ".join([*[f"`{k}` {polygons.schema[k].dataType.simpleString()}" for k in keys], "ring int, hole boolean, xs array<double>, ys array<double>, area double"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, told = [], []
            for i, parts in enumerate(batch["__p"].to_pylist()):
                found = united_rings([(np.array(p["xs"]), np.array(p["ys"])) for p in parts])
                found = sorted((ring_area(p) < 0, min(map(tuple, p.tolist())), k) for k, p in enumerate(found)), found
                for n, (hole, _, k) in enumerate(found[0]):
                    p = found[1][k]
                    row.append(i)
                    told.append((n, hole, p[:, 0].tolist(), p[:, 1].tolist(), ring_area(p)))
            cols = list(zip(*told, strict=True)) or [()] * 5
            types = (pa.int32(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            own = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[own[k] for k in keys], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [*keys, "ring", "hole", "xs", "ys", "area"])

    return each.mapInArrow(kernel, schema)


def union_shape(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area, rings, solidity: the union's area, its number of rings, and its area by that of the hull of all its corners."""
    rings = united(polygons, keys)
    g = rings.groupBy(*keys).agg(F.sum("area").alias("area"), F.count("*").alias("rings"), F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("ys")).alias("ys"))
    schema = ", ".join([*[f"`{k}` {polygons.schema[k].dataType.simpleString()}" for k in keys], "area double, rings long, solidity double"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around = [abs(ring_area(hull(np.column_stack([x, y])))) for x, y in zip(batch["xs"].to_pylist(), batch["ys"].to_pylist(), strict=True)]
            solid = batch["area"].to_numpy() / np.array(around) if around else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], batch["area"], batch["rings"], pa.array(solid)], [*keys, "area", "rings", "solidity"])

    return g.mapInArrow(kernel, schema)


def enclosing_radius(p: np.ndarray) -> float:
    """Radius of the least circle around points: the points are taken one by one, and where one lies outside, it is on the circle."""
    p = hull(np.asarray(p, float))

    def around(q: list[np.ndarray]) -> tuple[np.ndarray, float]:
        if len(q) < 2:
            return (q[0], 0.0) if q else (np.zeros(2), -1.0)
        if len(q) == 2:
            c = (q[0] + q[1]) / 2
        else:
            (ax, ay), (bx, by) = q[1] - q[0], q[2] - q[0]
            d = 2 * (ax * by - ay * bx)
            if d == 0:
                far = max(((i, j) for i in range(3) for j in range(i)), key=lambda t: float(np.hypot(*(q[t[0]] - q[t[1]]))))
                return around([q[far[0]], q[far[1]]])
            c = q[0] + np.array([by * (ax * ax + ay * ay) - ay * (bx * bx + by * by), ax * (bx * bx + by * by) - bx * (ax * ax + ay * ay)]) / d
        return c, float(max(np.hypot(*(v - c)) for v in q))

    out = lambda v, c: np.hypot(*(v - c[0])) > c[1] * (1 + 1e-12)
    circle = around([])
    for i, a in enumerate(p):
        if circle[1] < 0 or out(a, circle):
            circle = around([a])
            for j, b in enumerate(p[:i]):
                if out(b, circle):
                    circle = around([a, b])
                    for c in p[:j]:
                        if out(c, circle):
                            circle = around([a, b, c])
    return max(circle[1], 0.0)


def pair_scores_by_radius(points: DataFrame, polygons: DataFrame, factors: list[float], exact_reference: bool = False, key: str = "cell_id") -> DataFrame:
    """key, factor, n, pairs, score of points(key, x, y, z) and polygons(key, xs, ys): pairs of a cell's transcripts within
    factor times its radius, of all its pairs.

    The radius is half the diagonal of the diameter of the least circle around all of the cell's polygons and the range of its transcripts'
    z. All factors come from one pass: pairs are looked for by tiles as wide as the greatest radius, and counted for each factor.
    With exact_reference the score counts each pair twice and each transcript with itself, both twice again, as a tree's count of neighbours does.
    Cells without polygon or with fewer than two transcripts have no row; null coordinates take no part.
    """
    from spotloom.operators.tables import keep

    corners = polygons.where("xs is not null and ys is not null").groupBy(key).agg(F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list("ys")).alias("ys"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [enclosing_radius(np.column_stack([x, y])) for x, y in zip(batch["xs"].to_pylist(), batch["ys"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(told, pa.float64())], [key, "r"])

    radius = corners.mapInArrow(kernel, f"`{key}` {polygons.schema[key].dataType.simpleString()}, r double")
    used = points.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    box = used.groupBy(key).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("z") - F.min("z")).cast("double").alias("dz"))
    size = F.sqrt(4 * F.col("r") * F.col("r") + F.col("dz") * F.col("dz")) / 2
    box = keep(box.where("n > 1").join(radius, key).withColumn("size", size), "circle-boxes")
    p = keep(used.select(key, "x", "y", "z").withColumn("at", F.monotonically_increasing_id()), "circle-points").join(box, key)
    widest = F.col("size") * max(factors)
    side = lambda c, o: F.when(widest > 0, F.floor((F.col(c) - F.col(o)) / widest)).otherwise(0)
    p = p.withColumns({"tx": side("x", "x0"), "ty": side("y", "y0")})
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    q = p.select(key, F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"), F.col("at").alias("other"), "tx", "ty").withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps))
    q = q.withColumns({"tx": F.col("tx") + F.col("sx"), "ty": F.col("ty") + F.col("sy")}).drop("sx", "sy")
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    near = p.join(q, [key, "tx", "ty"]).where(F.col("at") < F.col("other")).withColumn("d2", sq("x", "qx") + sq("y", "qy") + sq("z", "qz"))
    held = near.groupBy(key).agg(*[F.count_if(F.col("d2") <= F.col("size") * F.col("size") * (f * f)).alias(f"u{i}") for i, f in enumerate(factors)])
    each = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("factor"), F.coalesce(f"u{i}", F.lit(0)).alias("u")) for i, f in enumerate(factors)]))
    out = box.select(key, "n").join(held, key, "left").withColumn("e", each).select(key, "e.factor", "n", F.col("e.u").alias("pairs"))
    count = 2 * (2 * F.col("pairs") + F.col("n")) if exact_reference else 2 * F.col("pairs")
    return out.withColumn("score", count / (F.col("n") * (F.col("n") - 1)))
