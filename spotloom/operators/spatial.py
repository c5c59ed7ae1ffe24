"""Range joins by tiles: points in polygons, nearest points, neighbours within a radius."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions import geometry
from spotloom.operators.tables import keep


def _tiles(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


_TILE = "__tile"
_BOX = ("__bx0", "__bx1", "__by0", "__by1")


def _tile(tx: Column, ty: Column) -> Column:
    """A tile as one number, by which rows are sorted without comparing them. Only tiles 2**32 steps apart share one, and no polygon is as wide."""
    return F.shiftleft(tx, 32).bitwiseOR(ty.bitwiseAND(F.lit(0xFFFFFFFF)))


def polygons_by_tile(polygons: DataFrame, tile: float) -> DataFrame:
    """polygons(xs, ys, ...) with a bounding box, once for each tile that the box touches."""
    boxed = polygons.withColumns(dict(zip(_BOX, (F.array_min("xs"), F.array_max("xs"), F.array_min("ys"), F.array_max("ys")), strict=True)))
    x0, x1, y0, y1 = map(F.col, _BOX)
    dealt = boxed.withColumn("__tx", F.explode(_tiles(x0, x1, tile))).withColumn("__ty", F.explode(_tiles(y0, y1, tile)))
    return dealt.withColumn(_TILE, _tile(F.col("__tx"), F.col("__ty"))).drop("__tx", "__ty")


def alike(polygons: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells (keys) whose polygons are the same in all other columns, as shapes(__shape, other columns), the polygons of each
    such set once, and members(keys, __shape). Points meet the shapes, however many cells have one; polygons without a ring go."""
    rest = [c for c in polygons.columns if c not in keys]
    drawn = polygons.where(F.col("xs").isNotNull() & F.col("ys").isNotNull())
    sets = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("__set"))  # a cell's planes and fragments
    # Numbered once and written: both results see the same numbers.
    numbered = keep(sets.select("__set").distinct().withColumn("__shape", F.monotonically_increasing_id()), "shapes")
    shapes = numbered.select("__shape", F.explode("__set").alias("__p")).select("__shape", *[F.col(f"__p.{c}").alias(c) for c in rest])
    return shapes, sets.join(numbered, "__set").select(*keys, "__shape")


def _meeting(points: DataFrame, polygons: DataFrame, on: list[str], tile: float) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides by tile, and the condition that a point lies in a polygon's tile and box."""
    dealt = polygons_by_tile(polygons, tile)
    here = points.withColumn(_TILE, _tile(F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)))
    x, y = here["x"], here["y"]
    met = here[_TILE] == dealt[_TILE]
    for c in on:
        met &= here[c] == dealt[c]
    return here, dealt, met & x.between(dealt["__bx0"], dealt["__bx1"]) & y.between(dealt["__by0"], dealt["__by1"])


def places(xs: pa.Array, ys: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """geometry.place() of each ring and point of a batch; edges with a missing coordinate count for nothing."""
    n, m = (r.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for r in (xs, ys))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    a, b = (r.flatten().to_numpy(zero_copy_only=False).astype(float) for r in (xs, ys))
    b = np.append(b, np.nan)[np.where(at < m[row], (np.cumsum(m) - m)[row] + at, len(b))]
    follow = np.where(at + 1 == n[row], np.arange(len(row)) - at, np.arange(len(row)) + 1)
    c, d = a[follow], b[follow]
    px, py = (v.to_numpy(zero_copy_only=False).astype(float)[row] for v in (x, y))
    with np.errstate(divide="ignore", invalid="ignore"):
        on = ((c - a) * (py - b) == (d - b) * (px - a)) & (px >= np.minimum(a, c)) & (px <= np.maximum(a, c)) & (py >= np.minimum(b, d)) & (py <= np.maximum(b, d))
        crossed = ((b > py) != (d > py)) & (px < (c - a) * (py - b) / (d - b) + a)
    count = lambda which: np.bincount(row[which], minlength=len(n))
    return pa.array(np.where(count(on) > 0, 2, count(crossed) % 2).astype(np.int32))


def _placed(pairs: DataFrame) -> DataFrame:
    """pairs(xs, ys, x, y) with __place, by batches; declared not deterministic so that no filter computes it a second time."""
    at = F.arrow_udf(places, "int").asNondeterministic()
    return pairs.withColumn("__place", at(F.col("xs").cast("array<double>"), F.col("ys").cast("array<double>"), F.col("x").cast("double"), F.col("y").cast("double")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, on: list[str] | None = None, tile: float = 50.0, covers: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of points(x, y, ...) and polygons(xs, ys, ...) that hold them, by an equi-join on tiles and an exact test.

    `on`: columns that must be equal as well (sample, plane). With covers, points on an edge are inside; how may be
    left_semi (each point once, however many polygons hold it). Other columns of both sides must differ in name. Points
    or polygons with null coordinates pair with nothing. Both sides shuffle on the tile; a tile's points and polygons
    are joined by sort and merge, so AQE can split one that is crowded.
    """
    on = on or []
    if how == "inner":
        pairs = points_near_polygons(points, polygons, on, tile)
        return pairs.where(F.col("__place") > 0 if covers else F.col("__place") == 1).drop(_TILE, "xs", "ys", "__place")
    here, dealt, met = _meeting(points, polygons, on, tile)
    inside = geometry.covers if covers else geometry.contains
    return here.join(dealt.hint("merge"), met & inside(dealt["xs"], dealt["ys"], here["x"], here["y"]), how).drop(_TILE)


def points_near_polygons(points: DataFrame, polygons: DataFrame, on: list[str] | None = None, tile: float = 50.0) -> DataFrame:
    """Pairs of points and polygons whose box holds them, with the tile (__tile), the ring and __place (0 outside, 1 inside,
    2 on an edge)."""
    on = on or []
    here, dealt, met = _meeting(points, polygons, on, tile)
    joined = here.join(dealt.hint("merge"), met).drop(*[dealt[c] for c in (_TILE, *_BOX, *on)])
    return _placed(joined)


def _ring(df: DataFrame, radius: float) -> DataFrame:
    """Rows once for each of the nine tiles around their own."""
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return (
        df.withColumn("sx", F.explode(steps))
        .withColumn("sy", F.explode(steps))
        .withColumns({"tx": F.floor(F.col("x") / radius) + F.col("sx"), "ty": F.floor(F.col("y") / radius) + F.col("sy")})
        .drop("sx", "sy")
    )


def _pairs(left: DataFrame, right: DataFrame, radius: float, on: list[str]) -> DataFrame:
    """pairs_within() with the left row's tile (tx, ty): grouping by it and the left row's own columns needs no further shuffle."""
    a = left.withColumns({"tx": F.floor(F.col("x") / radius), "ty": F.floor(F.col("y") / radius)})
    b = _ring(right.withColumnsRenamed({"rx": "x", "ry": "y"}), radius).withColumnsRenamed({"x": "rx", "y": "ry"})
    d2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    # Never broadcast: the nine copies of a row are not in the estimate of a table's size.
    return a.join(b.hint("merge"), [*on, "tx", "ty"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def pairs_within(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of left(x, y, ...) and right(rx, ry, ...) at most radius apart, with d2 (squared distance)."""
    return _pairs(left, right, radius, on or []).drop("tx", "ty")


def _first_radius(left: DataFrame, right: DataFrame, widest: float, on: list[str], wanted: int, levels: int = 3) -> float:
    """A radius, `widest` at most, within which a left row meets about `wanted` right rows, by counts of tiles, each a quarter as
    wide as those of the level before. It bounds the work, not the result."""
    finest = widest / 4**levels
    tile = lambda df, x, y, n: df.groupBy(*on, F.floor(F.col(x) / finest).alias("tx"), F.floor(F.col(y) / finest).alias("ty")).agg(F.count("*").alias(n))
    zero = F.lit(0).cast("long")
    each = tile(left, "x", "y", "l").withColumn("r", zero).unionByName(tile(right, "rx", "ry", "r").withColumn("l", zero))
    up = each.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = up.withColumns({c: F.floor(F.col(c) / F.pow(F.lit(4.0), F.lit(levels) - F.col("level"))) for c in ("tx", "ty")})
    met = up.groupBy(*on, "level", "tx", "ty").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    # One row for each level: right rows in the tile of a left row, on the average.
    mean = {r["level"]: r["met"] or 0.0 for r in met.groupBy("level").agg((F.sum(F.col("l") * F.col("r").cast("double")) / F.sum("l")).alias("met")).collect()}
    for level in sorted(mean):
        if mean[level] <= 16 * wanted or level == levels:
            return min(widest, widest / 4**level * math.sqrt(wanted / (math.pi * mean[level]))) if mean[level] else widest
    return widest


def _places(left: DataFrame) -> DataFrame:
    return left.select("x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull()).distinct()


def _nearest_places(places: DataFrame, right: DataFrame, start: float, limit: float, m: Column) -> DataFrame:
    """x, y, m: the least `m` (it begins with d2) among right rows within limit, of places(x, y) that have any, by rings that double.

    Only places that have found none within a radius look farther, so that the work is in proportion to the places.
    """
    rest, parts = keep(places, "places"), []
    right = keep(right, "targets")
    radius = _first_radius(rest, right, start, [], 4)
    while True:
        found = keep(_pairs(rest, right, radius, []).groupBy("tx", "ty", "x", "y").agg(F.min(m).alias("m")).drop("tx", "ty"), "nearest")
        parts.append(found)
        if radius >= limit:
            return reduce(DataFrame.unionByName, parts)
        rest = keep(rest.join(found.hint("merge"), ["x", "y"], "left_anti"), "places")
        if not rest.limit(1).count():
            return reduce(DataFrame.unionByName, parts)
        radius = min(2 * radius, limit)


def nearest_within(left: DataFrame, right: DataFrame, radius: float, value: str, order: list[str], otherwise: Column) -> DataFrame:
    """For each left(x, y, ...) row the `value` of the nearest right row within radius, ties by `order`; else `otherwise`.

    Each place is looked at once, and of the right rows of one place the first by `order`.
    """
    more = [c for c in order if c not in ("rx", "ry")]
    first = right.groupBy("rx", "ry").agg(F.min(F.struct(*more, value)).alias("v"))
    first = first.select("rx", "ry", *[F.col(f"v.{c}").alias(c) for c in (*more, value)])
    best = _nearest_places(_places(left), first, radius, radius, F.struct("d2", *order, value))
    return left.join(best.hint("merge"), ["x", "y"], "left").withColumn(value, F.coalesce(F.col(f"m.{value}"), otherwise)).drop("m")


def nearest_by_place(cells: DataFrame, k: int, radius: float, on: list[str] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """on, x, y, near: the up to k + 1 nearest cells(cell_id, x, y) of each place of cells within radius, those of the place
    itself included, as (d2, dst, also) in order, ties by dst; `also` may name their place, rx and ry.

    Cells of one place have the same neighbours but for themselves, and no more than k + 1 of them are anybody's. So the
    k + 1 first of each place are looked for once, within a radius that the density gives; only places with fewer look
    farther, by rings that double up to `radius`.
    """
    from pyspark.sql import Window

    on = on or []
    place = [*on, "x", "y"]
    placed = cells.select("cell_id", *place).dropna(subset=["cell_id", *place])
    first = placed.withColumn("n", F.row_number().over(Window.partitionBy(*place).orderBy("cell_id"))).where(F.col("n") <= k + 1)
    first = keep(first, "cells-by-place")
    right = first.select(*on, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("cell_id").alias("dst"))
    rest, parts = first.where("n = 1").select(*place), []
    at = _first_radius(rest, right, radius, on, 2 * (k + 1))
    while True:
        here = Window.partitionBy(*on, "tx", "ty", "x", "y")
        near = _pairs(rest, right, at, on).withColumn("n", F.row_number().over(here.orderBy("d2", "dst"))).where(F.col("n") <= k + 1)
        lists = near.groupBy(*on, "tx", "ty", "x", "y").agg(F.sort_array(F.collect_list(F.struct("d2", "dst", *also))).alias("near"))
        lists = keep(lists.drop("tx", "ty"), "nearest-cells")
        if at >= radius:
            parts.append(lists)
            break
        done = lists.where(F.size("near") > k)
        parts.append(done)
        rest = keep(rest.join(done.select(*place).hint("merge"), place, "left_anti"), "places")
        if not rest.limit(1).count():
            break
        at = min(2 * at, radius)
    return reduce(DataFrame.unionByName, parts)


def k_nearest(cells: DataFrame, k: int, radius: float, on: list[str] | None = None) -> DataFrame:
    """src, dst, d2, rank: up to k nearest other cells(cell_id, x, y) within radius, ties by dst; a cell_id has one row."""
    on = on or []
    place = [*on, "x", "y"]
    found = nearest_by_place(cells, k, radius, on)
    each = cells.select(F.col("cell_id").alias("src"), *place).dropna(subset=place).join(found.hint("merge"), place)
    others = F.slice(F.filter("near", lambda e: e["dst"] != F.col("src")), 1, k)
    out = each.select("src", *on, F.posexplode(others).alias("i", "e"))
    return out.select("src", F.col("e.dst").alias("dst"), F.col("e.d2").alias("d2"), *on, (F.col("i") + 1).alias("rank"))


def nearest(left: DataFrame, right: DataFrame, value: str, start: float, limit: float) -> DataFrame:
    """left(x, y, ...) with the `value` of the nearest right row (rx, ry, value; ties by value) and its distance, by rings that
    double from `start` or, where right rows are dense, from less, up to `limit`, beyond which both are null.

    Each place is looked at once, and of the right rows of one place the one with the least value.
    """
    first = right.groupBy("rx", "ry").agg(F.min(value).alias(value))
    best = _nearest_places(_places(left), first, start, limit, F.struct("d2", value))
    return left.join(best.hint("merge"), ["x", "y"], "left").select(*left.columns, F.col(f"m.{value}").alias(value), F.sqrt("m.d2").alias("distance"))


def pair_scores(points: DataFrame, factor: float, key: str = "cell_id") -> DataFrame:
    """key, n, u, score: pairs of a cell's transcripts within factor times half its box diagonal, of all its pairs.

    Pairs are looked for by tiles as wide as that radius, so a crowded cell is split; rows without key take no part.
    """
    points = points.where(F.col(key).isNotNull())
    box = points.groupBy(key).agg(
        F.count("*").alias("n"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        ((F.pow(F.max("x") - F.min("x"), F.lit(2)) + F.pow(F.max("y") - F.min("y"), F.lit(2))) * (factor * factor / 4)).alias("r2"),
    )
    box = keep(box.where("n > 1"), "pair-boxes")
    # Numbered once and written: both sides of the join see the same numbers.
    p = keep(points.select(key, "x", "y").withColumn("at", F.monotonically_increasing_id()), "pair-points").join(box, key)
    side = lambda c, o: F.when(F.col("r2") > 0, F.floor((F.col(c) - F.col(o)) / F.sqrt("r2"))).otherwise(0)
    p = p.withColumns({"tx": side("x", "x0"), "ty": side("y", "y0")})
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    q = p.select(key, F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("at").alias("other"), "tx", "ty").withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps))
    q = q.withColumns({"tx": F.col("tx") + F.col("sx"), "ty": F.col("ty") + F.col("sy")}).drop("sx", "sy")
    d2 = F.pow(F.col("x") - F.col("qx"), F.lit(2)) + F.pow(F.col("y") - F.col("qy"), F.lit(2))
    near = p.join(q, [key, "tx", "ty"]).where((F.col("at") < F.col("other")) & (d2 <= F.col("r2"))).groupBy(key).agg(F.count("*").alias("u"))
    out = box.select(key, "n").join(near, key, "left").withColumn("u", F.coalesce("u", F.lit(0)))
    return out.withColumn("score", F.round(2 * F.col("u") / (F.col("n") * (F.col("n") - 1)), 6))
