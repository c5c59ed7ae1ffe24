"""Polygon rings as two arrays of coordinates: area, perimeter, containment, affine maps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(xs: Column, ys: Column, f) -> Column:
    """Sum of f(x0, y0, x1, y1) over the edges of a ring; the last vertex leads to the first."""
    n = F.size(xs)
    at = F.sequence(F.lit(0), n - 1)
    return F.aggregate(at, F.lit(0.0), lambda s, i: s + f(F.get(xs, i), F.get(ys, i), F.get(xs, (i + 1) % n), F.get(ys, (i + 1) % n)))


def area(xs: Column, ys: Column) -> Column:
    return F.abs(_edges(xs, ys, lambda a, b, c, d: a * d - c * b)) / 2


def perimeter(xs: Column, ys: Column) -> Column:
    return _edges(xs, ys, lambda a, b, c, d: F.sqrt((c - a) * (c - a) + (d - b) * (d - b)))


def place(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """0 for a point outside a ring, 1 inside, 2 on an edge or vertex: crossings and touches counted in one pass over the edges."""
    touch = 1e6

    def met(a: Column, b: Column, c: Column, d: Column) -> Column:
        flat = (c - a) * (y - b) == (d - b) * (x - a)
        on = flat & x.between(F.least(a, c), F.greatest(a, c)) & y.between(F.least(b, d), F.greatest(b, d))
        return F.when(on, touch).when(((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b) + a), 1.0).otherwise(0.0)

    n = _edges(xs, ys, met)
    return F.when(n >= touch, 2).when(n % 2 == 1, 1).otherwise(0)


def contains(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Whether a point lies within a ring; points on its edges and vertices do not."""
    return place(xs, ys, x, y) == 1


def on_edge(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on the ring itself."""
    return place(xs, ys, x, y) == 2


def covers(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    return place(xs, ys, x, y) > 0


def signed_area(xs: Column, ys: Column) -> Column:
    """Area of a ring, negative where it runs clockwise."""
    return _edges(xs, ys, lambda a, b, c, d: a * d - c * b) / 2


def angle_at(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """The angle of a ring's inside at a point on its edge: half a turn, or that of the vertex; 0 off the edge."""
    n = F.size(xs)
    turn = F.when(signed_area(xs, ys) < 0, -1.0).otherwise(1.0)

    def part(i: Column) -> Column:
        a, b, c, d = F.get(xs, i), F.get(ys, i), F.get(xs, (i + 1) % n), F.get(ys, (i + 1) % n)
        e, f = F.get(xs, (i + n - 1) % n), F.get(ys, (i + n - 1) % n)
        cross, dot = (c - a) * (f - b) - (d - b) * (e - a), (c - a) * (e - a) + (d - b) * (f - b)
        corner = (a == x) & (b == y)
        inner = ((c - a) * (y - b) == (d - b) * (x - a)) & ((x - a) * (x - c) + (y - b) * (y - d) < 0)
        return F.when(corner, F.pmod(turn * F.atan2(cross, dot), F.lit(2 * math.pi))).when(inner, F.lit(math.pi)).otherwise(0.0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + part(i))


def affine(xs: Column, ys: Column, m: list[list[float]]) -> tuple[Column, Column]:
    """Rings mapped by a 3x3 affine matrix."""
    (a, b, c), (d, e, f) = m[0], m[1]
    return F.zip_with(xs, ys, lambda x, y: x * a + y * b + c), F.zip_with(xs, ys, lambda x, y: x * d + y * e + f)


def inverse(m: list[list[float]]) -> list[list[float]]:
    """Inverse of a 3x3 affine matrix."""
    (a, b, c), (d, e, f) = m[0], m[1]
    k = a * e - b * d
    return [[e / k, -b / k, (b * f - c * e) / k], [-d / k, a / k, (c * d - a * f) / k], [0.0, 0.0, 1.0]]
