"""Transcripts to cells and regions, and how many of them get there."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.functions import geometry
from spotloom.operators.spatial import alike, points_in_polygons, points_near_polygons
from spotloom.operators.tables import keep


def _methods(boundaries: DataFrame) -> Column:
    """The methods under comparison, a few dozen names, as an array."""
    names = sorted(r["method"] for r in boundaries.select("method").distinct().collect())
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def _sides(boundaries: DataFrame) -> list[tuple[DataFrame, list[str]]]:
    """Polygons of flat methods, and those of methods whose polygons all have a plane, with the columns that a transcript
    must share. A method with both kinds of polygons is among the flat ones."""
    each = boundaries.groupBy("method").agg(F.bool_and(F.col("z").isNotNull()).alias("layered")).where("layered").collect()  # a few dozen
    layered = [r["method"] for r in each]
    sides = [(boundaries.where(F.col("method").isNull() | ~F.col("method").isin(layered)), [])]
    return sides + ([(boundaries.where(F.col("method").isin(layered)), ["z"])] if layered else [])


def _near(transcripts: DataFrame, polygons: DataFrame, on: list[str], tile: float) -> DataFrame:
    if on:
        return points_near_polygons(transcripts, polygons, on, tile)
    pairs = points_near_polygons(transcripts, polygons.withColumnRenamed("z", "__z"), [], tile)
    return pairs.where(F.col("__z").isNull() | (F.col("__z") == F.col("z")))


def _held(transcripts: DataFrame, boundaries: DataFrame, by: list[str], tile: float) -> DataFrame:
    """by, method, once for each transcript(x, y, z, __id, *by) that the method's polygons, taken together, hold.

    A transcript on the outer edge of a method's polygons is not in them; one on an edge is where the polygons that touch
    it meet all around it. Transcripts are dealt by tile (and plane) and not multiplied by methods: only pairs with polygons whose box
    holds them are, and those are counted where they are made.
    """
    parts = []
    for polygons, on in _sides(boundaries):
        # Equal polygons of a method once: they hold the same transcripts, and two of them do not surround one on their edge.
        pairs = _near(transcripts, polygons.select("method", "z", "xs", "ys").distinct(), on, tile)
        around = F.when(F.col("__place") == 2, geometry.angle_at(F.col("xs"), F.col("ys"), F.col("x"), F.col("y"))).otherwise(0.0)
        keys = ["__tile", *on, *[c for c in by if c not in on], "__id", "method"]
        met = pairs.where("__place > 0").groupBy(*keys).agg(F.max((F.col("__place") == 1).cast("int")).alias("inside"), F.sum(around).alias("around"))
        parts.append(met.where((F.col("inside") == 1) | (F.col("around") > 2 * math.pi - 1e-9)).select("__id", *by, "method"))
    return reduce(DataFrame.unionByName, parts)


def assigned_transcripts(transcripts: DataFrame, boundaries: DataFrame, tile: float = 50.0) -> DataFrame:
    """transcripts with methods: the methods whose polygons, taken together, hold the transcript.

    Polygons with a null z hold transcripts of every plane, others those of their own. A transcript on the outer edge of
    a method's polygons is not in them, one on an edge that two of them share is.
    """
    numbered = keep(transcripts.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    held = _held(numbered.select("__id", "x", "y", "z"), boundaries, [], tile).groupBy("__id").agg(F.sort_array(F.collect_set("method")).alias("methods"))
    return numbered.join(held, "__id", "left").drop("__id").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))


def pct_assigned(transcripts: DataFrame, boundaries: DataFrame, by: list[str], tile: float = 50.0) -> DataFrame:
    """method, *by, n, assigned, pct: all transcripts, those assigned and their share, 0 where none is."""
    # Those of one place and group once. Written once: they are counted, and meet flat and layered methods.
    places = transcripts.groupBy(*dict.fromkeys([*by, "x", "y", "z"])).agg(F.count("*").alias("__n"))
    points = keep(places.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    total = points.groupBy(*by).agg(F.sum("__n").alias("n"))
    hit = _held(points, boundaries, [*by, "__n"], tile).groupBy("method", *by).agg(F.sum("__n").alias("assigned"))
    every = total.withColumn("method", F.explode(_methods(boundaries)))
    same = every["method"] == hit["method"]
    for c in by:
        same &= every[c].eqNullSafe(hit[c])
    out = every.join(hit, same, "left").select(every["method"], *[every[c] for c in by], "n", F.coalesce("assigned", F.lit(0)).alias("assigned"))
    return out.withColumn("pct", F.round(100.0 * F.col("assigned") / F.col("n"), 6))


def cell_by_gene(transcripts: DataFrame, boundaries: DataFrame, min_transcripts: int = 10, tile: float = 50.0) -> DataFrame:
    """method, cell_id, gene, count of transcripts in each cell; cells with fewer than min_transcripts are left out."""
    points, parts = transcripts.select("gene", "x", "y", "z"), []
    for polygons, on in _sides(boundaries):
        shapes, members = alike(polygons.select("method", "cell_id", "z", "xs", "ys"), ["method", "cell_id"])
        counts = keep(_near(points, shapes, on, tile).where("__place = 1").groupBy("__shape", "gene").agg(F.count("*").alias("count")), "cell-by-gene")
        enough = counts.groupBy("__shape").agg(F.sum("count").alias("n")).where(F.col("n") >= min_transcripts).select("__shape")
        parts.append(members.join(counts.join(enough, "__shape", "left_semi"), "__shape").select("method", "cell_id", "gene", "count"))
    return reduce(DataFrame.unionByName, parts)


def points_to_regions(points: DataFrame, regions: DataFrame, key: str, tile: float = 200.0, include_boundary: bool = True) -> DataFrame:
    """points with the label of the first region of their sample that holds them (by label, then idx), null if none."""
    found = points_in_polygons(points.select(key, "sample", "x", "y"), regions.select("sample", "label", "idx", "xs", "ys"), ["sample"], tile, covers=include_boundary)
    first = found.groupBy(key).agg(F.min(F.struct("label", "idx")).getField("label").alias("region"))
    return points.join(first, key, "left")


def outliers(cells: DataFrame, lassos: DataFrame, key: str = "cell_id") -> DataFrame:
    """cells with is_outlier: inside any lasso polygon of their sample."""
    hit = points_in_polygons(cells.select(key, "sample", "x", "y"), lassos.select("sample", "xs", "ys").distinct(), ["sample"], 200.0, how="left_semi").select(key).distinct()
    return cells.join(hit.withColumn("is_outlier", F.lit(True)), key, "left").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False)))
