"""Cell morphology in two and three dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions import geometry


def flat_shape(polygons: DataFrame, scale: float = 10.5) -> DataFrame:
    """polygons with area, perimeter, volume (area * scale), size, p_over_a, sphericity (4 pi A / P^2), diameter."""
    out = polygons.withColumns({"area": geometry.area(F.col("xs"), F.col("ys")), "perimeter": geometry.perimeter(F.col("xs"), F.col("ys"))})
    a, p = F.col("area"), F.col("perimeter")
    return out.withColumns(
        {"volume": a * scale, "size": F.sqrt(a), "p_over_a": F.when(a > 0, p / a), "sphericity": F.when(p > 0, 4 * math.pi * a / (p * p)), "diameter": F.sqrt(4 * a / math.pi)}
    )


def deep_shape(polygons: DataFrame, dz: float = 1.5) -> DataFrame:
    """method, cell_id, planes, volume, surface, sphericity of cells over their planes.

    Volume: trapezoids between planes, and half a plane at each end that is the method's first or last plane. Surface:
    mean perimeter times height, and the two end areas. A cell with one plane is flat: area times dz.
    """
    s = flat_shape(polygons, dz).select("method", "cell_id", "z", "area", "perimeter")
    ends = Window.partitionBy("method", "cell_id")
    order = ends.orderBy("z")
    limits = s.groupBy("method").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    s = s.join(F.broadcast(limits), "method")  # one row for each method
    step = (F.col("area") + F.lead("area").over(order)) / 2 * (F.lead("z").over(order) - F.col("z")) * dz
    first, last = F.row_number().over(order) == 1, F.lead("z").over(order).isNull()
    cap = F.when(first & (F.col("z") == F.col("z_min")), F.col("area") * dz / 2).otherwise(0.0) + F.when(last & (F.col("z") == F.col("z_max")), F.col("area") * dz / 2).otherwise(0.0)
    s = s.withColumns({"part": F.coalesce(step, F.lit(0.0)) + cap, "end": F.when(first, F.col("area")).otherwise(0.0) + F.when(last, F.col("area")).otherwise(0.0)})
    g = s.groupBy("method", "cell_id").agg(
        F.count("*").alias("planes"), F.sum("part").alias("deep"), F.sum("end").alias("ends"), F.avg("perimeter").alias("p"), F.max("area").alias("area"), (F.max("z") - F.min("z")).alias("span")
    )
    volume = F.when(F.col("planes") == 1, F.col("area") * dz).otherwise(F.col("deep"))
    surface = F.when(F.col("planes") == 1, 2 * F.col("area") + F.col("p") * dz).otherwise(F.col("p") * F.col("span") * dz + F.col("ends"))
    g = g.withColumns({"volume": volume, "surface": surface})
    return g.select("method", "cell_id", "planes", "volume", "surface", (math.pi ** (1 / 3) * F.pow(6 * F.col("volume"), F.lit(2 / 3)) / F.col("surface")).alias("sphericity"))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull in counter-clockwise order (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(q: np.ndarray) -> list:
        out: list = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2 if len(p) > 2 else 0.0


def hull_shape(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, solidity (area by hull area), elongation (of the standardised hull points), box_elongation (least rectangle).

    Equal outlines are measured once, dealt by outline so that the hulls do not wait for the files of the input.
    """

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for xs, ys in zip(f["__xs"], f["__ys"], strict=True):
                p = np.column_stack([xs, ys]).astype(float)
                h = hull(p)
                a = _area(h)
                sd = h.std(axis=0)
                r = abs(float(np.corrcoef(h.T)[0, 1])) if len(h) > 2 and (sd > 0).all() else 1.0
                best = (math.inf, 0.0)
                for d in np.roll(h, -1, axis=0) - h:
                    n = float(np.hypot(*d))
                    if n:
                        turned = h @ np.array([[d[0], -d[1]], [d[1], d[0]]]) / n
                        w, t = np.ptp(turned, axis=0)
                        best = min(best, (float(w * t), 1 - min(w, t) / max(w, t) if max(w, t) else 0.0))
                rows.append((_area(p) / a if a else None, 1 - math.sqrt((1 - r) / (1 + r)), best[1]))
            yield pd.concat([f[["__xs", "__ys"]].reset_index(drop=True), pd.DataFrame(rows, columns=["solidity", "elongation", "box_elongation"])], axis=1)

    ring = [polygons.schema[c].dataType.simpleString() for c in ("xs", "ys")]
    outlines = polygons.select(F.col("xs").alias("__xs"), F.col("ys").alias("__ys")).distinct()
    measured = outlines.mapInPandas(kernel, f"__xs {ring[0]}, __ys {ring[1]}, solidity double, elongation double, box_elongation double")
    same = F.col("xs").eqNullSafe(F.col("__xs")) & F.col("ys").eqNullSafe(F.col("__ys"))
    return polygons.select(*keys, "xs", "ys").join(measured, same).select(*keys, "solidity", "elongation", "box_elongation")


def one_cell_each(pairs: DataFrame, key: list[str], area: str = "area") -> DataFrame:
    """Overlaps removed: each transcript keeps the cell of least area, then of least id."""
    w = Window.partitionBy(*key).orderBy(area, "cell_id")
    return pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def repaired(polygons: DataFrame) -> DataFrame:
    """Polygons whose rings have three corners or more and an area; null rings go."""
    return polygons.where(F.col("xs").isNotNull() & F.col("ys").isNotNull() & (F.size("xs") >= 3) & (F.size("xs") == F.size("ys")) & (geometry.area(F.col("xs"), F.col("ys")) > 0))


def morphology(boundaries: DataFrame, dz: float = 1.5, planes: int = 7) -> DataFrame:
    """Tall table over all boundary sets: method, cell_id, dimensionality, planes, volume, sphericity, surface (3D only).

    A method whose polygons have a plane is 3D; in the others a cell has `planes` planes of its one outline.
    """
    flat = flat_shape(boundaries.where("z is null"), dz * planes).withColumns({"dimensionality": F.lit("2D"), "planes": F.lit(1).cast("long"), "surface": F.lit(None).cast("double")})
    deep = deep_shape(boundaries.where("z is not null"), dz).withColumn("dimensionality", F.lit("3D"))
    columns = ["method", "cell_id", "dimensionality", "planes", "volume", "sphericity", "surface"]
    return flat.select(*columns).unionByName(deep.select(*columns))


def with_volume(cells: DataFrame, boundaries: DataFrame, dz: float = 1.5, planes: int = 7) -> DataFrame:
    """cells(method, cell_id, ...) that have a boundary, with the volume, sphericity and solidity of their kind of method; older
    columns of these names, and area, are replaced."""
    shapes = morphology(boundaries, dz, planes).drop("surface", "planes")
    flat = boundaries.withColumn("area", geometry.area(F.col("xs"), F.col("ys"))).groupBy("method", "cell_id").agg(F.max("area").alias("area"))
    known = cells.drop("area", "volume", "sphericity", "dimensionality")
    return known.join(shapes.join(flat, ["method", "cell_id"]), ["method", "cell_id"])


def plane_sums(polygons: DataFrame, dz: float = 1.5) -> DataFrame:
    """method, cell_id, planes, area (sum), volume (sum * dz), perimeter (mean), circularity (mean over planes that have a
    perimeter), elongation (1 - shortest by longest side of the x, y, z box)."""
    s = flat_shape(polygons).withColumns({"bx0": F.array_min("xs"), "bx1": F.array_max("xs"), "by0": F.array_min("ys"), "by1": F.array_max("ys")})
    g = s.groupBy("method", "cell_id").agg(
        F.count("*").alias("planes"),
        F.sum("area").alias("area"),
        (F.sum("area") * dz).alias("volume"),
        F.avg("perimeter").alias("perimeter"),
        F.avg("sphericity").alias("circularity"),
        *[(F.max(b) - F.min(a)).cast("double").alias(d) for d, a, b in (("dx", "bx0", "bx1"), ("dy", "by0", "by1"), ("dz", "z", "z"))],
    )
    long = F.greatest("dx", "dy", "dz")
    return g.withColumn("elongation", F.when(long > 0, 1 - F.least("dx", "dy", "dz") / long)).drop("dx", "dy", "dz")


def dissolved_cells(boundaries: DataFrame) -> DataFrame:
    """method, cell_id, parts: all outlines of a cell, over its planes and fragments, as one multi-part boundary; a point is
    in it when any part holds it."""
    return boundaries.groupBy("method", "cell_id").agg(F.sort_array(F.collect_set(F.struct("xs", "ys"))).alias("parts"))


def parts(dissolved: DataFrame) -> DataFrame:
    """One row for each part of dissolved_cells(): method, cell_id, xs, ys."""
    return dissolved.select("method", "cell_id", F.explode("parts").alias("p")).select("method", "cell_id", "p.xs", "p.ys")
