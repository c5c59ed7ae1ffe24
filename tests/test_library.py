"""Geometry by hand, readers by round trip, invariants of the operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.functions import geometry
from spotloom.operators import annotate, assign, dea, embed, factors, graph, labels, metrics, normalize, qc, raster, shape, spatial, tiles
from spotloom.sources import readers


@pytest.fixture(scope="module")
def square(spark):
    return spark.createDataFrame([("A", 1, None, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0])], "method string, cell_id long, z int, xs array<double>, ys array<double>")


def test_square(spark, square):
    r = square.select(geometry.area(F.col("xs"), F.col("ys")), geometry.perimeter(F.col("xs"), F.col("ys"))).head()
    assert tuple(r) == (16.0, 16.0)
    points = spark.createDataFrame([(1.0, 1.0), (4.0, 2.0), (5.0, 1.0), (0.0, 0.0), (None, 1.0)], "x double, y double")
    assert spatial.points_in_polygons(points, square, tile=3.0).where("x = 1").count() == 1
    assert {(r["x"], r["y"]) for r in spatial.points_in_polygons(points, square, tile=3.0, covers=True).collect()} == {(1.0, 1.0), (4.0, 2.0), (0.0, 0.0)}
    m = [[2.0, 1.0, 5.0], [0.0, 3.0, -1.0], [0.0, 0.0, 1.0]]
    assert np.allclose(np.array(m) @ np.array(geometry.inverse(m)), np.eye(3))


def test_prism(spark):
    ring = ([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0])
    p = spark.createDataFrame([("B", 1, z, *ring) for z in (0, 1)] + [("B", 2, 1, *ring)], "method string, cell_id long, z int, xs array<double>, ys array<double>")
    got = {r["cell_id"]: r for r in shape.deep_shape(p, dz=1.0).collect()}
    assert got[1]["volume"] == 4 + 2 + 2 and got[1]["surface"] == 8 * 1 + 8
    assert got[2]["volume"] == 4 and got[2]["planes"] == 1
    hull = shape.hull_shape(p.limit(1), ["cell_id"]).head()
    assert abs(hull["solidity"] - 1) < 1e-12 and abs(hull["box_elongation"]) < 1e-12
    el = shape.hull(np.array([[0, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2]], float))
    assert len(el) == 5


def test_readers(spark, tmp_path):
    feature = lambda cell, layer, kind, c: {"type": "Feature", "properties": {"cell": cell, "layer": layer}, "geometry": {"type": kind, "coordinates": c}}
    ring = [[0, 0], [1, 0], [1, 1]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("c1", 0, "Polygon", [ring]), feature("c2", 1, "MultiPolygon", [[ring], [ring]])]}))
    got = readers.geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert len(got) == 3 and got[0]["xs"] == [0, 1, 1]
    (tmp_path / "l.csv").write_text("# a\n# b\nSelection,X,Y\ns1,0,0\ns1,1,0\ns1,1,1\ns2,0,0\n")
    (r,) = readers.lassos(spark, str(tmp_path / "l.csv"), "x").collect()
    assert (r["selection"], r["xs"]) == ("s1", [0, 1, 1])
    (tmp_path / "m.csv").write_text("1 0 5\n0 1 6\n0 0 1\n")
    assert readers.affine_matrix(spark, str(tmp_path / "m.csv"))[0] == [1, 0, 5]
    (tmp_path / "p.tsv").write_text("##K=21;TOPK=3\n##SCALE=100\n##OFFSET_X=1;OFFSET_Y=2\n5\t6\t1\t2\t3\t0.5\t0.3\t0.2\n")
    assert readers.pixel_header(spark, str(tmp_path / "p.tsv"))["SCALE"] == "100"
    assert readers.pixel_decode(spark, str(tmp_path / "p.tsv")).head()["k"] == [1, 2, 3]


def test_flags_and_names(spark):
    cells = spark.createDataFrame([(1, "a", 5.0), (2, "a", 50.0), (3, "a", 500.0), (4, None, 60.0)], "cell_id long, sample string, volume_final double")
    expr = spark.createDataFrame([(1, "g", 30), (2, "g", 40), (3, "g", 3), (9, "g", 1)], "cell_id long, gene string, count long")
    got = {r["cell_id"]: r for r in qc.quality_flags(qc.cell_totals(cells, expr), 25, 1).collect()}
    assert got[1]["volume_outlier"] and got[3]["volume_outlier"] and not got[2]["volume_outlier"] and got[4]["n_counts"] == 0 and got[4]["is_low_quality"]
    with pytest.raises(ValueError):
        qc.require_integer_counts(spark.createDataFrame([(1.5,)], "count double"))
    with pytest.raises(ValueError):
        qc.attach_strict(cells, expr.withColumnRenamed("count", "k"), "cell_id")
    told = ["0001 Oligo NN", "NN", None, "334 Immune Cell NN", "215 SNc Foxa1 Dopa-Gaba", "006 L2/3 IT CTX Glut", "12 GABA", "38Peri"]
    names = spark.createDataFrame([(x,) for x in told], "n string").select(labels.normal_label(F.col("n"), {"Oligo": "Oligos"}).alias("n")).collect()
    assert [r["n"] for r in names] == ["Oligos", "NN", None, "Immune Cell", "Neurons-Dopa-Gaba", "Neurons-Glut", "GABA", "Peri"]


def test_normalised_mean(spark):
    rng = np.random.default_rng(0)
    cells = spark.createDataFrame([(i, float(50 + i)) for i in range(60)], "cell_id long, volume_final double")
    expr = spark.createDataFrame([(i, f"g{k}", int(c)) for i in range(60) for k, c in enumerate(rng.integers(1, 20, 5))], "cell_id long, gene string, count long")
    n = normalize.volume_normalised(expr, cells)
    assert math.isclose(n.groupBy("cell_id").agg(F.sum("scaled").alias("s")).agg(F.avg("s")).head()[0], 250, rel_tol=1e-9)
    z = normalize.z_scores(expr, 60).groupBy("gene").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in z)


def test_tests_against_numpy(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([(i, f"s{i % 6}", "KO" if i % 2 else "WT") for i in range(80)], "cell_id long, sample string, condition string")
    x = rng.poisson(1.0, 80)
    expr = spark.createDataFrame([(i, "g", int(c)) for i, c in enumerate(x) if c], "cell_id long, gene string, count long")
    a, b = x[1::2], x[::2]
    rank = lambda v: (np.sum(x < v) + (np.sum(x == v) + 1) / 2)
    z = (sum(rank(v) for v in a) - len(a) * 81 / 2) / math.sqrt(len(a) * len(b) * 81 / 12)
    r = dea.rank_sum_test(expr, cells, "KO", "WT").head()
    assert abs(r["u_z"] - z) < 1e-5 and abs(r["p"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-5
    assert abs(dea._gamma_upper(1, 2.0) - math.exp(-2)) < 1e-12 and abs(dea._gamma_upper(0.5, 0.8) - math.erfc(math.sqrt(0.8))) < 1e-12
    assert abs(dea._hypergeometric_tail(1, 2, 3, 6) - 0.8) < 1e-12
    pb = spark.createDataFrame([("all", f"s{i}", f"g{k}", int(c)) for i in range(6) for k, c in enumerate(rng.poisson([100, 100 * (1 + 3 * (i % 2)), 300]))], "subset string, sample string, gene string, count long")
    samples = spark.createDataFrame([(f"s{i}", "KO" if i % 2 else "WT") for i in range(6)], "sample string, condition string")
    nb = {r["gene"]: r for r in dea.negative_binomial(pb, samples, "KO", "WT").collect()}
    assert nb["g1"]["p"] < 1e-6 and nb["g1"]["logfc"] > 0.8
    assert dea.negative_binomial(pb.limit(0), samples, "KO", "WT").count() == 0


def test_grid_and_pca(spark):
    grid = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 1, 2), (2, 2, 1), (3, 3, 1)], "row long, col long, label int")
    four, eight = graph.grid_components(grid), graph.grid_components(grid, eight=True)
    assert four.select("component").distinct().count() == 4 and eight.select("component").distinct().count() == 3
    assert graph.segments(four, 2.0).agg(F.sum("area")).head()[0] == 20.0
    assert graph.relabel_islands(four, 2).where("row = 1").head()["label"] == 1
    rng = np.random.default_rng(1)
    x = rng.poisson(3, (30, 4))
    expr = spark.createDataFrame([(i, f"g{k}", int(x[i, k])) for i in range(30) for k in range(4) if x[i, k]], "cell_id long, gene string, count long")
    scores, shares = embed.pca(expr, 30, 2)
    got = np.array([r["pc"] for r in scores.orderBy("cell_id").collect()])
    zs = (x - x.mean(0)) / x.std(0, ddof=1)
    w, v = np.linalg.eigh(np.cov(zs.T))
    assert np.allclose(np.abs(got), np.abs(zs @ v[:, ::-1][:, :2])[: len(got)], atol=1e-6) and abs(shares[0] - w[-1] / w.sum()) < 1e-9


def test_small_tables(spark):
    empty = spark.createDataFrame([], "cell_id long, sample string, x double, y double, cell_type string, cluster long")
    assert spatial.k_nearest(empty, 3, 5.0, ["sample"]).count() == 0
    assert annotate.assign_clusters(empty, "cluster", "cell_type").count() == 0
    assert factors.distribution(empty, "sample", "cell_type").count() == 0
    assert raster.density(empty, 5.0, ["sample"]).count() == 0
    assert qc.histogram(empty, "x", 10).count() == 0
    square = spark.createDataFrame([], "sample string, xs array<double>, ys array<double>")
    assert assign.outliers(empty, square).count() == 0
    t = metrics.combine([spark.createDataFrame([("a", 1)], "method string, p int"), spark.createDataFrame([("b", 2)], "method string, q int")])
    assert {tuple(r) for r in t.collect()} == {("a", 1, None), ("b", None, 2)}


def test_edges_between_polygons(spark):
    """A point on an outer edge is in no cell; one that polygons of a method enclose together is in their union."""
    ring = lambda x, y, s: ([x, x + s, x + s, x], [y, y, y + s, y + s])
    flat = [("A", c, None, *ring(x, y, 2.0)) for c, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (2.0, 2.0), (10.0, 0.0)])]
    flat += [("B", 1, 0, *ring(0.0, 0.0, 2.0)), ("B", 2, 0, [2.0, 4.0, 2.0], [0.0, 0.0, 2.0])]
    polygons = spark.createDataFrame(flat, "method string, cell_id long, z int, xs array<double>, ys array<double>")
    rows = [(2.0, 1.0), (2.0, 2.0), (0.0, 1.0), (1.0, 1.0), (4.0, 4.0), (10.0, 1.0), (2.0, 0.0), (None, 1.0), (3.0, 0.5)]
    points = spark.createDataFrame([(x, y, 0) for x, y in rows] + [(2.0, 1.0, 1)], "x double, y double, z int")
    got = {(r["x"], r["y"], r["z"]): sorted(r["methods"]) for r in assign.assigned_transcripts(points, polygons, 3.0).collect()}
    assert got == {
        (2.0, 1.0, 0): ["A", "B"], (2.0, 1.0, 1): ["A"], (2.0, 2.0, 0): ["A"], (0.0, 1.0, 0): [], (1.0, 1.0, 0): ["A", "B"], (4.0, 4.0, 0): [],
        (10.0, 1.0, 0): [], (2.0, 0.0, 0): [], (None, 1.0, 0): [], (3.0, 0.5, 0): ["A", "B"],
    }
    counts = assign.cell_by_gene(points.withColumn("gene", F.lit("g")), polygons, 1).collect()
    assert {(r["method"], r["cell_id"], r["count"]) for r in counts} == {("A", 0, 1), ("A", 1, 1), ("B", 1, 1), ("B", 2, 1)}
    assert assign.pct_assigned(points.limit(0).withColumn("gene", F.lit("g")), polygons, ["gene"]).count() == 0


def test_pairs(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (1, 4.0, 0.0), (2, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (None, 1.0, 1.0), (None, 1.0, 1.0)], "cell_id long, x double, y double")
    assert {tuple(r) for r in spatial.pair_scores(p, 1.0).collect()} == {(1, 3, 1, 0.333333), (2, 2, 1, 1.0)}
    two = metrics.coexpression(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "cell_id long, gene string, count int"), spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "t")], "gene string, gene_set string"))
    assert {tuple(r) for r in two.collect()} == {("a", "b", 0, 2, 0.0), ("a", "c", 0, 1, 0.0)}


def test_segments_split_by_seeds(spark):
    rng = np.random.default_rng(6)
    label = rng.integers(0, 2, (12, 12))
    grid = spark.createDataFrame([(int(r), int(c), int(label[r, c])) for r in range(12) for c in range(12)], "row long, col long, label int")
    parts = graph.grid_components(grid).withColumn("component", F.col("component.row") * 100 + F.col("component.col"))
    seeds = [(int(r), int(c), int(k)) for k, (r, c) in enumerate(rng.integers(0, 12, (9, 2)))]
    got = {(r["row"], r["col"]): r["seed"] for r in tiles.split_by_seeds(parts, spark.createDataFrame(seeds, "row long, col long, seed long")).collect()}
    best = {}
    for r, c, k in seeds:
        best[r, c] = min(k, best.get((r, c), k))
    fresh = dict(best)
    while fresh:
        told = {}
        for (r, c), k in fresh.items():
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if q not in best and 0 <= q[0] < 12 and 0 <= q[1] < 12 and label[q] == label[r, c]:
                    told[q] = min(k, told.get(q, k))
        best |= told
        fresh = told
    assert got == {(r, c): best.get((r, c)) for r in range(12) for c in range(12)}


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_vectors(spark, block):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 4))
    x[5] = x[9]
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)] + [(99, None)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embed.k_nearest_vectors(v, 3, block=block).collect())
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == sorted((i, int(j), r + 1) for i in range(40) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3]))
    assert embed.k_nearest_vectors(v.limit(0), 3).count() == 0


def test_missing_boundaries_and_repair(spark):
    cells = spark.createDataFrame([(i, 20 if i else 1) for i in range(10)], "cell_id long, n_counts int")
    assert qc.with_boundaries(cells, cells.where("cell_id > 0")).count() == 9
    with pytest.raises(ValueError):
        qc.with_boundaries(cells, cells.where("cell_id > 3"))
    rings = spark.createDataFrame([([0.0, 1.0, 1.0], [0.0, 0.0, 1.0]), ([0.0, 1.0], [0.0, 0.0]), ([0.0, 1.0, 2.0], [0.0, 0.0, 0.0]), (None, None)], "xs array<double>, ys array<double>")
    assert shape.repaired(rings).count() == 1
