"""Coordinate frames: micrometres and image pixels, shifts of polygons, decoded pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_frames(cells: DataFrame, scale: tuple[float, float], origin: tuple[float, float], pixel_prefixes: list[str], also_um: list[str]) -> DataFrame:
    """cells(method, x, y) with um_x, um_y, px_x, px_y.

    Pixels are x * scale + origin. Coordinates are micrometres, but pixels for methods with one of the prefixes, unless
    they are named in also_um. A null method counts as micrometres.
    """
    method = F.coalesce("method", F.lit(""))
    starts = F.lit(False)
    for p in pixel_prefixes:
        starts |= method.startswith(p)
    in_pixels = starts & ~method.isin(*also_um)
    out = {}
    for c, s, o in zip("xy", scale, origin, strict=True):
        out[f"um_{c}"] = F.when(in_pixels, F.col(c) / s - o / s).otherwise(F.col(c).cast("double"))
        out[f"px_{c}"] = F.when(in_pixels, F.col(c).cast("double")).otherwise(F.col(c) * s + o)
    return cells.withColumns(out)


def decoded_um(pixels: DataFrame, scale: float, origin: tuple[float, float], x: str = "X", y: str = "Y") -> DataFrame:
    """pixels with x, y in micrometres: stored value / scale + origin, sorted within partitions."""
    out = pixels.withColumns({"x": F.col(x) / scale + origin[0], "y": F.col(y) / scale + origin[1]})
    return out.sortWithinPartitions("x", "y")


def shifted(polygons: DataFrame, dx: float | Column, dy: float | Column) -> DataFrame:
    """Rings moved by dx, dy (numbers, or columns such as an offset by a scale)."""
    dx, dy = (d if isinstance(d, Column) else F.lit(float(d)) for d in (dx, dy))
    moved = polygons.withColumns({"__dx": dx, "__dy": dy})
    return moved.withColumns({"xs": F.transform("xs", lambda v: v + F.col("__dx")), "ys": F.transform("ys", lambda v: v + F.col("__dy"))}).drop("__dx", "__dy")


def to_map_frame(polygons: DataFrame, scale: tuple[float, float], origin: tuple[float, float], margin: float = 13.0) -> DataFrame:
    """Rings in the frame of a map: moved by origin / scale - margin."""
    return shifted(polygons, origin[0] / scale[0] - margin, origin[1] / scale[1] - margin)
