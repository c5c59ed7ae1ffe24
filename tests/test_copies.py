"""Many cells at one place, and many cells with one outline: right results without all their pairs."""

import pytest
from pyspark.sql import functions as F

from spotloom.operators import assign, dea, raster, spatial


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_cells_at_one_place(spark):
    rows = [(i, "s", (i % 7) * 3, (i % 5) * 4) for i in range(140)] + [(500, "s", 900, 900), (501, "t", 0, 0), (502, "s", None, 0)]
    cells = spark.createDataFrame(rows, "cell_id long, sample string, x long, y long")
    got = {}
    for r in spatial.k_nearest(cells, 6, 10.0, ["sample"]).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["d2"], r["dst"]))
    for i, s, x, y in rows:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, t, a, b in rows if None not in (x, a) and j != i and s == t)
        want = [(k + 1, *e) for k, e in enumerate([e for e in near if e[0] <= 100][:6])]
        assert sorted(got.get(i, [])) == want


def test_tile_joins_do_not_broadcast(spark):
    few = spark.createDataFrame([(1, 2, 3)], "cell_id long, x long, y long")
    assert "Broadcast" not in _plan(spatial.pairs_within(few, few.selectExpr("cell_id AS dst", "x AS rx", "y AS ry"), 5.0))
    # 40,000 rows at two places: 800 million pairs, had each row to meet each.
    cells = spark.range(40_000).selectExpr("id AS cell_id", "id % 2 AS x", "0L AS y")
    assert spatial.k_nearest(cells, 3, 5.0).agg(F.count("*"), F.sum("d2")).head() == (120_000, 0)


def test_nearest_of_dense_places(spark):
    left = spark.createDataFrame([(i, i * 5, i * 3) for i in range(40)] + [(99, None, 1)], "k long, x long, y long")
    # 3,000 right rows at each of a hundred places: twelve million pairs within reach before.
    right = spark.range(300_000).selectExpr("(id % 10) * 20 AS rx", "(id DIV 10 % 10) * 20 AS ry", "id AS seed")
    seeds = [(a * 20, b * 20, a + 10 * b) for a in range(10) for b in range(10)]
    got = {r["k"]: r for r in spatial.nearest(left, right, "seed", 400.0, 3000.0).collect()}
    for i in range(40):
        d, seed = min(((5 * i - a) ** 2 + (3 * i - b) ** 2, s) for a, b, s in seeds)
        assert got[i]["seed"] == seed and got[i]["distance"] == pytest.approx(d**0.5)
    assert len(got) == 41 and got[99]["seed"] is None
    within = {r["k"]: r["seed"] for r in spatial.nearest_within(left, right, 4.0, "seed", ["rx", "ry"], F.lit(-1)).collect()}
    for i in range(40):
        d, _, _, seed = min(((5 * i - a) ** 2 + (3 * i - b) ** 2, a, b, s) for a, b, s in seeds)
        assert within[i] == (seed if d <= 16 else -1)


def _squares(spark):
    ring = lambda a: ([a, a + 10.0, a + 10.0, a], [a, a, a + 10.0, a + 10.0])
    rows = [("F", i, None, *ring(float(20 * (i % 2)))) for i in range(60)] + [("L", i, z, *ring(0.0)) for i in range(60) for z in (0, 1)]
    return spark.createDataFrame(rows, "method string, cell_id long, z int, xs array<double>, ys array<double>")


def test_equal_outlines_meet_points_once(spark):
    shapes, members = spatial.alike(_squares(spark), ["method", "cell_id"])
    assert shapes.count() == 4 and members.count() == 120 and members.select("__shape").distinct().count() == 3
    t = spark.createDataFrame([("a", 5.0, 5.0, 0), ("a", 6.0, 5.0, 1), ("b", 25.0, 25.0, 1), ("b", 10.0, 5.0, 2)], "gene string, x double, y double, z int")
    got = {(r["method"], r["cell_id"], r["gene"]): r["count"] for r in assign.cell_by_gene(t, _squares(spark), 1).collect()}
    want = {("F", i, "a" if i % 2 == 0 else "b"): 2 - i % 2 for i in range(60)} | {("L", i, "a"): 2 for i in range(60)}
    assert got == want
    pixels = t.select("x", "y", F.lit(0).alias("channel"), F.col("x").alias("value"))
    means = {r["cell_id"]: (r["n"], r["mean"]) for r in raster.channel_means(pixels, _squares(spark).where("method = 'F'"), ["cell_id"]).collect()}
    assert means == {i: (1, 25.0) if i % 2 else (2, 5.5) for i in range(60)}


def test_equal_outlines_do_not_surround_their_edge(spark):
    t = spark.createDataFrame([("a", 10.0, 5.0, 0)], "gene string, x double, y double, z int")
    assert {r["method"]: r["assigned"] for r in assign.pct_assigned(t, _squares(spark), ["gene"]).collect()} == {"F": 0, "L": 0}


def test_rank_sums_of_millions_of_cells(spark):
    n = 2_700_000
    cells = spark.range(2 * n).selectExpr("id AS cell_id", "CASE WHEN id % 2 = 0 THEN 'KO' ELSE 'WT' END AS condition", "'x' AS cell_type")
    expr = spark.createDataFrame([(0, "g", 3)], "cell_id long, gene string, count long")
    got = {r["subset"]: r["u_z"] for r in dea.rank_sum_by(expr, cells, "KO", "WT").collect()}
    # One cell of the first group has the highest rank, all others tie below it.
    want = ((n - 1) * 2 * n / 2 + 2 * n - n * (2 * n + 1) / 2) / (n * n * (2 * n + 1) / 12) ** 0.5
    assert got == {"x": round(want, 6), "all": round(want, 6)}
