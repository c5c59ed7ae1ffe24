"""Unions and repair of rings by hand and by points, least circles and pair scores against all pairs."""

import numpy as np
import pytest

from spotloom.operators import overlay

SQUARE = lambda x, y, s: (np.array([x, x + s, x + s, x], float), np.array([y, y, y + s, y + s], float))


def _areas(rings):
    return sorted(round(overlay.ring_area(p), 6) for p in overlay.united_rings(rings))


def test_known_unions():
    assert _areas([SQUARE(0, 0, 2)]) == [4]
    assert _areas([SQUARE(0, 0, 2), SQUARE(2, 0, 2)]) == [8] and len(overlay.united_rings([SQUARE(0, 0, 2), SQUARE(2, 0, 2)])[0]) == 4  # a shared side
    assert _areas([SQUARE(0, 0, 2), SQUARE(2, 2, 2)]) in ([4, 4], [8])  # a shared corner
    assert _areas([SQUARE(0, 0, 4), SQUARE(1, 1, 2)]) == [16]  # nested
    assert _areas([SQUARE(0, 0, 2), SQUARE(0, 0, 2)]) == [4]
    assert _areas([SQUARE(0, 0, 2), SQUARE(1, 1, 2)]) == [7]
    frame = [(np.array([0, 6, 6, 0.0]), np.array([0, 0, 1, 1.0])), (np.array([0, 6, 6, 0.0]), np.array([5, 5, 6, 6.0])), (np.array([0, 1, 1, 0.0]), np.array([0, 0, 6, 6.0])), (np.array([5, 6, 6, 5.0]), np.array([0, 0, 6, 6.0]))]
    assert _areas(frame) == [-16, 36]
    assert sum(_areas([(np.array([0.0, 2, 0, 2]), np.array([0.0, 2, 2, 0]))])) == 2  # a bow tie is two triangles
    assert _areas([(np.array([0.0, 1, 2]), np.array([0.0, 0, 0]))]) == []
    assert _areas([SQUARE(0, 0, 1), SQUARE(5, 5, 1)]) == [1, 1]


def _odd(p, x, y):
    a, b = p, np.roll(p, -1, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((a[:, 1] > y) != (b[:, 1] > y)) & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])
    return cross.sum() % 2 == 1


@pytest.mark.parametrize("seed", range(12))
def test_union_holds_the_same_points(seed):
    rng = np.random.default_rng(seed)
    rings = []
    for _ in range(int(rng.integers(1, 6))):
        n = int(rng.integers(3, 12))
        angle = np.sort(rng.random(n)) * 2 * np.pi if seed % 2 else rng.random(n) * 2 * np.pi  # some cross themselves
        r = rng.uniform(1, 4, n)
        p = rng.uniform(-3, 3, 2) + np.column_stack([r * np.cos(angle), r * np.sin(angle)])
        if seed % 3 == 0:
            p = p.round()  # shared vertices and sides
        rings.append((p[:, 0], p[:, 1]))
    out = overlay.united_rings(rings)
    for x, y in rng.uniform(-7, 7, (400, 2)) + 1e-4:
        assert any(_odd(np.column_stack(q), x, y) for q in rings) == bool(sum(_odd(p, x, y) for p in out) % 2), (x, y)
    area = sum((x1 - x0) * (hi - lo + hi2 - lo2) / 2 for x0, x1, parts in overlay._slabs(rings) for lo, hi, lo2, hi2 in parts)
    assert abs(sum(map(overlay.ring_area, out)) - area) < 1e-3


def test_united_tables(spark):
    rows = [("a", 1, *[v.tolist() for v in SQUARE(0, 0, 2)]), ("a", 2, *[v.tolist() for v in SQUARE(1, 1, 2)]), ("b", 1, [0.0, 2.0, 0.0, 2.0], [0.0, 2.0, 2.0, 0.0]), ("b", 2, None, None), ("c", 1, [1.0, 2.0], [1.0, 1.0]), (None, 1, *[v.tolist() for v in SQUARE(0, 0, 1)])]
    table = spark.createDataFrame(rows, "cell string, z int, xs array<double>, ys array<double>")
    got = {}
    for r in overlay.united(table, ["cell"]).collect():
        got.setdefault(r["cell"], []).append(r["area"])
    assert {k: round(sum(v), 6) for k, v in got.items()} == {"a": 7, "b": 2, None: 1}
    assert overlay.united(table.limit(0), ["cell"]).count() == 0
    solid = {r["cell"]: (r["area"], r["rings"], round(r["solidity"], 6)) for r in overlay.union_shape(table, ["cell"]).collect()}
    assert solid["a"] == (7.0, 1, 0.875) and solid[None] == (1.0, 1, 1.0)


def test_least_circle():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 30):
        p = rng.normal(0, 1, (n, 2))
        best = 0.0 if n == 1 else np.inf
        for i in range(n):
            for j in range(i):
                for k in range(j + 1):
                    c = (p[i] + p[j]) / 2
                    if k < j:
                        m = 2 * np.array([p[j] - p[i], p[k] - p[i]])
                        c = np.linalg.solve(m, [p[j] @ p[j] - p[i] @ p[i], p[k] @ p[k] - p[i] @ p[i]])
                    r = np.hypot(*(p - c).T).max()
                    best = min(best, r)
        assert abs(overlay.enclosing_radius(p) - best) < 1e-9
    assert overlay.enclosing_radius([[0, 0], [1, 0], [2, 0]]) == 1


def test_pair_scores(spark):
    rng = np.random.default_rng(3)
    pts = [(int(c), float(x), float(y), int(z)) for c, x, y, z in zip(rng.integers(0, 6, 300), rng.uniform(0, 9, 300), rng.uniform(0, 9, 300), rng.integers(0, 5, 300))] + [(7, 1.0, 1.0, 0), (8, 1.0, 1.0, 1), (8, 1.0, 1.0, 1), (None, 1.0, 1.0, 1), (1, None, 2.0, 1)]
    rings = [(c, *[v.tolist() for v in SQUARE(0, 0, 3 + c)]) for c in range(6)] + [(7, *[v.tolist() for v in SQUARE(0, 0, 3)]), (8, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0])]
    points = spark.createDataFrame(pts, "cell_id long, x double, y double, z int")
    polygons = spark.createDataFrame(rings, "cell_id long, xs array<double>, ys array<double>")
    for exact in (False, True):
        got = {(r["cell_id"], r["factor"]): (r["n"], r["pairs"], r["score"]) for r in overlay.pair_scores_by_radius(points, polygons, [0.25, 0.5, 1.0], exact).collect()}
        for c in [*range(6), 8]:
            p = np.array([(x, y, z) for k, x, y, z in pts if k == c and x is not None])
            size = np.sqrt((2 * (0 if c == 8 else (3 + c) / np.sqrt(2))) ** 2 + np.ptp(p[:, 2]) ** 2) / 2
            d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
            for f in (0.25, 0.5, 1.0):
                u = int((np.triu(d <= size * f, 1)).sum())
                n = len(p)
                assert got[c, f][:2] == (n, u) and abs(got[c, f][2] - ((2 * (2 * u + n)) if exact else 2 * u) / (n * (n - 1))) < 1e-12
        assert {c for c, _ in got} == {*range(6), 8}
