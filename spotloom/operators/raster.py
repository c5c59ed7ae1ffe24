"""Grids: density images, factor rasters, channel means in polygons, components, lattices and tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators.spatial import alike, points_in_polygons
from spotloom.operators.tables import keep


def density(points: DataFrame, size: float, by: list[str]) -> DataFrame:
    """by, row, col, n: points in square pixels."""
    return points.groupBy(*by, F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col")).agg(F.count("*").alias("n"))


def smooth(image: DataFrame, sigma: float, by: list[str], radius: int | None = None) -> DataFrame:
    """Gaussian smoothing of a sparse image by two passes of a separable kernel; pixels outside are zero."""
    r = radius or math.ceil(3 * sigma)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    kernel = F.array(*[F.struct(F.lit(k - r).alias("k"), F.lit(x / sum(w)).alias("w")) for k, x in enumerate(w)])
    out = image.withColumn("n", F.col("n").cast("double"))
    for axis, other in (("row", "col"), ("col", "row")):
        spread = out.withColumn("s", F.explode(kernel)).withColumn(axis, F.col(axis) + F.col("s.k"))
        out = spread.groupBy(*by, axis, other).agg(F.sum(F.col("n") * F.col("s.w")).alias("n"))
    return out


def channel_means(pixels: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, channel, n, mean, min, max, sum, variance of the pixels(x, y, channel, value) in each polygon.

    Variance is that of the pixels inside (sample); pixels outside the polygon have no part in it.
    """
    shapes, members = alike(polygons.select(*keys, "xs", "ys"), keys)
    g = points_in_polygons(pixels, shapes).groupBy("__shape", "channel")
    r = lambda c: F.round(c, 9)
    each = g.agg(
        F.count("*").alias("n"), r(F.avg("value")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), r(F.var_samp("value")).alias("variance")
    )
    return members.join(each, "__shape").drop("__shape")


def majority_raster(pixels: DataFrame, size: float) -> DataFrame:
    """row, col, label: the most frequent factor (least among equals) plus 1."""
    c = pixels.groupBy(F.floor(F.col("py") / size).alias("row"), F.floor(F.col("px") / size).alias("col"), "k1").agg(F.count("*").alias("n"))
    w = Window.partitionBy("row", "col").orderBy(F.desc("n"), "k1")
    return c.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("row", "col", (F.col("k1") + 1).alias("label"))


def _hexagons(points: DataFrame, width: float, min_count: int, by: list[str]) -> DataFrame:
    """by, q, r, gene, n: transcripts in pointed hexagons of the given width, of hexagons with enough of them."""
    a = width / math.sqrt(3)
    fq, fr = (F.col("x") * math.sqrt(3) / 3 - F.col("y") / 3) / a, F.col("y") * 2 / 3 / a
    p = points.withColumns({"fq": fq, "fr": fr}).withColumns({"q": F.round("fq"), "r": F.round("fr"), "s": F.round(-F.col("fq") - F.col("fr"))})
    dq, dr, ds = F.abs(F.col("q") - F.col("fq")), F.abs(F.col("r") - F.col("fr")), F.abs(F.col("s") + F.col("fq") + F.col("fr"))
    q = F.when((dq > dr) & (dq > ds), -F.col("r") - F.col("s")).otherwise(F.col("q"))
    r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -F.col("q") - F.col("s")).otherwise(F.col("r"))
    # Written once: the bins are counted, and met by those that have enough.
    binned = keep(p.select(*by, "gene", q.cast("long").alias("q"), r.cast("long").alias("r")).groupBy(*by, "q", "r", "gene").agg(F.count("*").alias("n")), "hexagons")
    full = binned.groupBy(*by, "q", "r").agg(F.sum("n").alias("t")).where(F.col("t") >= min_count)
    return binned.join(full, [*by, "q", "r"], "left_semi")


def hex_bins(points: DataFrame, width: float, min_count: int) -> DataFrame:
    """q, r, gene, n: transcripts in pointed hexagons of the given width, of hexagons with enough of them."""
    return _hexagons(points, width, min_count, [])


def hex_moves(points: DataFrame, width: float, min_count: int, moves: int = 2) -> DataFrame:
    """i, j, q, r, gene, n of hex_bins() on `moves` by `moves` lattices, each moved on by width / moves along x (i) and y (j)."""
    steps = F.array(*map(F.lit, range(moves)))
    # The points are read once, for all lattices.
    moved = points.select("x", "y", "gene").withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    moved = moved.withColumns({"x": F.col("x") - F.col("i") * F.lit(float(width)) / F.lit(moves), "y": F.col("y") - F.col("j") * F.lit(float(width)) / F.lit(moves)})
    return _hexagons(moved, width, min_count, ["i", "j"]).select("i", "j", "q", "r", "gene", "n")


def mini_batches(points: DataFrame, axis: str = "x", size: float = 500, buffer: float = 30) -> DataFrame:
    """points with batch (strip along the axis) and inner: a point within `buffer` of a border is in the next strip too, where it is not inner."""
    span = F.sequence(F.floor((F.col(axis) - buffer) / size), F.floor((F.col(axis) + buffer) / size))
    return points.withColumn("batch", F.explode(span)).withColumn("inner", F.col("batch") == F.floor(F.col(axis) / size))


def squares(points: DataFrame, width: float, overlap: float = 0) -> DataFrame:
    """Points with the square tiles (tx, ty) that they fall in; neighbouring tiles share a margin of `overlap`."""
    span = lambda c: F.sequence(F.floor((F.col(c) - overlap) / width), F.floor((F.col(c) + overlap) / width))
    return points.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))


def spot_lattice(points: DataFrame, pitch: float = 100, diameter: float = 55) -> DataFrame:
    """spot, i, j, x, y: centres of a hexagonal lattice over the points' bounding box, every second row moved by half."""
    r, step = diameter / 2, pitch * math.sqrt(3) / 2
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("y1") - F.col("y0") + 2 * r) / step).cast("int"))))
    grid = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("x1") - F.col("x0") + 2 * r) / pitch).cast("int"))))
    x = F.col("x0") - r + F.col("j") * pitch + F.when(F.col("i") % 2 == 1, pitch / 2).otherwise(0.0)
    return grid.select(F.concat_ws("_", F.lit("visium"), "i", "j").alias("spot"), "i", "j", F.round(x, 6).alias("x"), F.round(F.col("y0") - r + F.col("i") * step, 6).alias("y"))


def factor_image(pixels: DataFrame, factor: int, size: float, top: int = 3) -> DataFrame:
    """row, col, value: summed probability of a factor among the first `top` of each pixel(px, py, k, p: arrays), scaled so that
    the greatest is 65499, and clipped."""
    each = pixels.select("px", "py", F.explode(F.slice(F.arrays_zip("k", "p"), 1, top)).alias("e")).where(F.col("e.k") == factor)
    v = each.groupBy(F.floor(F.col("py") / size).alias("row"), F.floor(F.col("px") / size).alias("col")).agg(F.round(F.sum("e.p"), 9).alias("s"))
    most = v.agg(F.max("s").alias("m")).head()["m"] or 1.0
    return v.select("row", "col", F.least(F.lit(65499), F.floor(F.round(F.col("s") / most * 65499, 6))).cast("long").alias("value"))


def factor_counts(pixels: DataFrame) -> DataFrame:
    """k1, n, pct, weighted of each factor."""
    whole = Window.partitionBy()  # one row for each factor
    c = pixels.groupBy("k1").agg(F.count("*").alias("n"), F.round(F.sum("p1"), 6).alias("weighted"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 6))


def grid_spacing(points: DataFrame, column: str) -> float:
    """Median gap of a coordinate's distinct values.

    Values are ordered within buckets of a thousand units; a bucket's first follows the last of the bucket before.
    """
    each = points.where(F.col(column).isNotNull()).select(F.col(column).alias("c")).distinct().withColumn("bucket", F.floor(F.col("c") / 1000))
    ends = each.groupBy("bucket").agg(F.max("c").alias("last"))
    before = ends.select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("before"))  # one row for each bucket
    inside = F.lag("c").over(Window.partitionBy("bucket").orderBy("c"))
    gaps = each.withColumn("lag", inside).join(before, "bucket").select((F.col("c") - F.coalesce("lag", "before")).alias("g"))
    return gaps.agg(F.median("g").alias("m")).head()["m"]


def label_grid(points: DataFrame, label: str = "label") -> DataFrame:
    """row, col, label of points(x, y, label) on a lattice: row 0 at the greatest y, col 0 at the least x, steps of the median
    gap of each axis. A ValueError where two points share a pixel; null coordinates take no part."""
    used = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    dx, dy = (grid_spacing(used, c) or 1 for c in ("x", "y"))
    box = used.agg(F.min("x").alias("x0"), F.max("y").alias("y1"))  # one row
    at = lambda v, d: F.rint(v / d).cast("long")
    out = used.crossJoin(F.broadcast(box)).select(at(F.col("y1") - F.col("y"), dy).alias("row"), at(F.col("x") - F.col("x0"), dx).alias("col"), F.col(label).alias("label"))
    twice = out.groupBy("row", "col").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two points share the pixel of row {twice[0]['row']} and column {twice[0]['col']}")
    return out


def segment_table(parts: DataFrame, size: float, types: dict[int, str]) -> DataFrame:
    """component, factor (label - 1), cell_type (null where a factor has none), pixels, area of components of a factor raster."""
    pairs = [F.lit(v) for kv in types.items() for v in kv]
    kind = F.try_element_at(F.create_map(*pairs), (F.col("label") - 1).cast("int")) if pairs else F.lit(None).cast("string")
    g = parts.groupBy("component", "label").agg(F.count("*").alias("pixels"))
    return g.select("component", (F.col("label") - 1).alias("factor"), kind.alias("cell_type"), "pixels", (F.col("pixels") * size * size).alias("area"))


def label_edges(grid: DataFrame) -> DataFrame:
    """label, sides: pixel sides of each label whose neighbour has another label or none (the outline's length)."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    side = grid.withColumn("s", F.explode(steps)).select("label", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    other = grid.select("row", "col", F.col("label").alias("next"))
    return side.join(other, ["row", "col"], "left").where("next is null or next <> label").groupBy("label").agg(F.count("*").alias("sides"))


def factor_intensities(pixels: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, channel, mean (by the greatest mean of all), variance (by that mean squared), over pixels in polygons."""
    s = keep(channel_means(pixels, polygons, keys), "channel-means")
    top = s.agg(F.max("mean").alias("top"))
    scaled = s.crossJoin(F.broadcast(top))  # one row
    return scaled.select(*keys, "channel", F.round(F.col("mean") / F.col("top"), 6).alias("mean"), F.round(F.col("variance") / (F.col("top") * F.col("top")), 6).alias("variance"))


def mean_of_cells(means: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """by, channel, mean of the cells' means(cell_id, channel, mean), which are rounded to 9 digits: summed as the decimals that they
    are, so that a mean halfway between two results does not fall to either side with the order of rows."""
    each = means.join(cells.select("cell_id", *by), "cell_id").groupBy(*by, "channel")
    exact = F.sum(F.col("mean").cast("decimal(28,9)")) / F.count("mean")
    return each.agg(F.round(exact, 6).cast("double").alias("mean"))


def plane_intensities(pixels: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, channel, mean: means of the pixels(x, y, z, channel, value) in each plane's polygon(z, ...), then over planes."""
    shapes, members = alike(polygons.select(*keys, F.col("z").alias("pz"), "xs", "ys"), keys)
    held = points_in_polygons(pixels.withColumnRenamed("z", "pz"), shapes, ["pz"])
    planes = held.groupBy("__shape", "channel", "pz").agg(F.avg("value").alias("m"))
    each = planes.groupBy("__shape", "channel").agg(F.count("*").alias("planes"), F.round(F.avg("m"), 6).alias("mean"))
    return members.join(each, "__shape").drop("__shape")


def intensity_ranges(cells: DataFrame, values: list[str], by: str = "method", q: float = 0.99) -> DataFrame:
    """by, channel, n, median, rank: values up to their q-quantile in each channel and group, groups in order of the median."""
    long = cells.unpivot([by], values, "channel", "value").where(F.col("value").isNotNull())
    cut = long.groupBy(by, "channel").agg(F.percentile("value", F.lit(q)).alias("cut"))
    kept = long.join(cut, [by, "channel"]).where(F.col("value") <= F.col("cut"))
    g = kept.groupBy(by, "channel").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("median"), by)))  # one row for each group
