"""Steps whose cost a row decides at size, and results that do not hang on the order of rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from spotloom.functions import geometry
from spotloom.operators import assign, embed, labels, qc, raster, shape, spatial
from spotloom.sources import readers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_in_rings_by_batches(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = rng.randint(1, 7)
        ring = [(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(n)]
        xs, ys = [a for a, _ in ring], [b for _, b in ring]
        if i % 20 == 0:
            xs[rng.randrange(n)] = None
        if i % 20 == 1:
            ys = ys[:-1]
        if i % 20 == 2:
            ys = [*ys, 3.0]
        rows.append((i, xs, ys, rng.randint(0, 12) / 2, rng.randint(0, 12) / 2))
    rings = spark.createDataFrame(rows, "i long, xs array<double>, ys array<double>, x double, y double").coalesce(1)
    met = spatial._placed(rings).withColumn("want", geometry.place(F.col("xs"), F.col("ys"), F.col("x"), F.col("y")))
    got = met.select("__place", "want").collect()
    assert [r["__place"] for r in got] == [r["want"] for r in got] and {r["want"] for r in got} == {0, 1, 2}


def test_rings_are_not_walked_edge_by_edge_in_the_join(spark):
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 4.0, 1.0), (3, 9.0, 9.0)], "k long, x double, y double")
    ring = spark.createDataFrame([(7, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0])], "p long, xs array<double>, ys array<double>")
    inside, covered = (spatial.points_in_polygons(points, ring, covers=c) for c in (False, True))
    assert "aggregate(" not in _plan(inside) and _plan(inside).count("places(") == _plan(covered).count("places(")
    assert inside.columns == ["k", "x", "y", "p"]
    assert sorted(r["k"] for r in inside.collect()) == [1] and sorted(r["k"] for r in covered.collect()) == [1, 2]


def test_a_tile_is_one_number_to_sort_by(spark):
    points = spark.createDataFrame([(-3.0, -3.0), (3.0, -3.0), (-3.0, 3.0), (3.0, 3.0), (None, 3.0)], "x double, y double")
    ring = spark.createDataFrame([(x, [10.0 * x, 10.0 * x, 0.0, 0.0], [0.0, 10.0 * y, 10.0 * y, 0.0], y) for x in (-1, 1) for y in (-1, 1)], "p int, xs array<double>, ys array<double>, q int")
    inside = spatial.points_in_polygons(points, ring, tile=2.0)
    plan = _plan(inside)
    sorts = [line for line in plan.splitlines() if " Sort [" in line]
    assert len(sorts) == 2 and all(line.count(" ASC ") == 1 for line in sorts)
    assert sorted(inside.collect()) == sorted((x * 3.0, y * 3.0, x, y) for x in (-1, 1) for y in (-1, 1))


def test_transcripts_of_one_place_meet_outlines_once(spark, monkeypatch):
    t = spark.createDataFrame([("a", 5.0, 5.0, 0)] * 50 + [("b", 5.0, 5.0, 0), ("a", 20.0, 5.0, 0), (None, 5.0, 5.0, 0), ("b", None, 5.0, 0)] * 3, "gene string, x double, y double, z int")
    ring = spark.createDataFrame([("F", None, [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0])], "method string, z int, xs array<double>, ys array<double>")
    met, near = [], assign._near
    monkeypatch.setattr(assign, "_near", lambda *a: met.append(near(*a)) or met[-1])
    got = {(r["gene"], r["n"], r["assigned"], r["pct"]) for r in assign.pct_assigned(t, ring, ["gene"]).collect()}
    assert got == {("a", 53, 50, round(5000 / 53, 6)), ("b", 6, 3, 50.0), (None, 3, 3, 100.0)}
    assert met[0].count() == 3


def test_means_halfway_between_two_results(spark):
    # Their mean is 0.7049625; summed as doubles, in any order, it is 0.7049624999999999.
    values = [0.5369, 0.91965, 0.8521, 0.5112]
    means = spark.createDataFrame([(i, 0, m) for i, m in enumerate(values)] + [(9, 0, None)], "cell_id long, channel int, mean double")
    cells = spark.createDataFrame([(i, "s") for i in range(10)], "cell_id long, sample string")
    assert [tuple(r) for r in raster.mean_of_cells(means, cells, ["sample"]).collect()] == [("s", 0, 0.704963)]


def test_moved_hexagons_read_their_points_once(spark):
    points = spark.createDataFrame([(x * 7 % 50, x * 11 % 40, f"g{x % 3}") for x in range(400)], "x long, y long, gene string")
    got = raster.hex_moves(points, 9.0, 3, 3)
    assert _plan(got).count("ExistingRDD") == 0  # they stand in a table by now
    want = set()
    for i in range(3):
        for j in range(3):
            moved = points.withColumns({"x": F.col("x") - i * 9.0 / 3, "y": F.col("y") - j * 9.0 / 3})
            want |= {(i, j, *r) for r in raster.hex_bins(moved, 9.0, 3).select("q", "r", "gene", "n").collect()}
    assert {tuple(r) for r in got.collect()} == want


def test_one_block_of_pixels_is_no_single_task(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pixels = spark.range(4000).selectExpr("id % 90 * 1.0 AS x", "id % 70 * 1.0 AS y")
        out = labels.quantised(pixels, 0, 0).withColumn("part", F.spark_partition_id())
        assert out.groupBy("part").count().agg(F.max("count")).head()[0] < 2000
        assert out.select("BLOCK").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_equal_outlines_have_one_hull(spark):
    rows = [(i, [0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 1.0, 1.0]) for i in range(50)] + [(90, [0.0, 4.0, 4.0, 2.0, 0.0], [0.0, 0.0, 4.0, 2.0, 4.0])]
    got = shape.hull_shape(spark.createDataFrame(rows, "cell_id long, xs array<double>, ys array<double>").coalesce(1), ["cell_id"])
    plan = _plan(got)
    assert "Aggregate" in plan[plan.index("MapInPandas") :]
    assert {r["cell_id"]: r["solidity"] for r in got.collect()} == {i: 1.0 for i in range(50)} | {90: 0.75}


def test_gene_filter_computes_its_table_once(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", i % 2) for i in range(30)] + [(0, "x", 5)] * 9, "cell_id long, gene string, count long")
    expr = rows.groupBy("cell_id", "gene").agg(F.sum("count").alias("count"))
    got = qc.keep_genes(expr, 5)
    assert _plan(got).count("ExistingRDD") == 0
    assert {r["gene"] for r in got.collect()} == {"g0", "g1", "g2"} and got.count() == 30


def test_one_value_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(6000).selectExpr("'a' AS sample", "concat('g', id % 2) AS gene", "id * 7919 % 6000 AS x")
        readers.write_results(df, f"{tmp_path}/out", ["sample"], ["gene"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted(tmp_path.glob("out/sample=a/*.parquet"))
    parts = [[r["gene"] for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(files) > 2 and sum(map(len, parts)) == 6000 and all(p == sorted(p) for p in parts)


def test_differences_of_a_sample_take_bounded_memory():
    assert embed._rows_at_once(10_000 * 64) * 10_000 * 64 <= 1 << 21 and embed._rows_at_once(1 << 30) == 1 and embed._rows_at_once(0) > 1


def test_nearest_vectors_by_products_are_exact():
    rng = np.random.default_rng(3)
    y = np.vstack([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 60, axis=0), 1e6 + 1e-3 * rng.normal(size=(40, 8))])
    for more in ([], [[np.nan] * 8, [np.inf] * 8, [1e200] * 8, [1e200] * 8]):
        x = np.vstack([y, more]) if more else y
        keys = np.arange(len(x))[::-1] * 3
        src, dst, d2 = embed._k_nearest(x, keys, x, keys, 5)
        got = {}
        for a, b, d in zip(src.tolist(), dst.tolist(), d2.tolist(), strict=True):
            got.setdefault(a, []).append((d, b))
        with np.errstate(all="ignore"):
            for v, k in zip(x, keys.tolist(), strict=True):
                far = ((v - x) ** 2).sum(axis=1)
                want = sorted((d, b) for d, b in zip(far.tolist(), keys.tolist(), strict=True) if b != k and np.isfinite(d))[:5]
                assert got.get(k, []) == want
    assert len(embed._k_nearest(y[:0], keys[:0], y, keys[: len(y)], 5)[0]) == 0 == len(embed._k_nearest(y, keys[: len(y)], y[:0], keys[:0], 5)[0])
