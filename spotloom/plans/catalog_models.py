"""Registered queries of graphs, outlines and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.functions import geometry
from spotloom.operators import assign, community, dea, knn, labels, metrics, models, overlay, raster, tiles
from spotloom.plans.catalog import _PB, _also
from spotloom.plans.catalog_more import _GRID, _grid, _scratch
from spotloom.plans.registry import Views, query
from spotloom.sources import readers

# --- neighbours and clusters -------------------------------------------------------------------------------------------


@query(
    """SELECT src, dst, rank, distance FROM (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10"""
)
def indexed_neighbours(v: Views):
    """By an index beyond 1,024 vectors, where they are no longer sure to be the nearest; below that exact, as the SQL is."""
    return knn.indexed_neighbours(v.embeddings, 10).withColumn("distance", F.round("distance", 6))


@query()
def graph_clusters(v: Views):
    """Communities of the graph of fifteen neighbours in component space."""
    near = knn.indexed_neighbours(v.embeddings, 15)
    nodes = v.embeddings.where("embedding is not null").select(F.col("vec_id").alias("node"))
    found, _ = community.communities(nodes, community.neighbour_graph(near), 1.0)
    return found.select(F.col("node").alias("vec_id"), "community")


# --- label grids -------------------------------------------------------------------------------------------------------

_REACHED = f"""{_GRID}, reach(r0, c0, row, col, label) AS (SELECT row, col, row, col, label FROM grid UNION SELECT r0, c0, g.row, g.col, g.label FROM reach h JOIN grid g ON g.label = h.label AND abs(g.row - h.row) + abs(g.col - h.col) = 1),
    parts AS (SELECT row, col, label, min(r0 * 100000 + c0) AS component FROM reach GROUP BY 1, 2, 3)"""


@query(
    f"""SELECT * FROM (WITH RECURSIVE {_REACHED}, pairs AS (SELECT a.component, count(*) AS n FROM parts a JOIN parts b ON a.component = b.component AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)) GROUP BY 1),
    blocks AS (SELECT a.component, count(*) AS n FROM parts a JOIN parts b ON b.component = a.component AND b.row = a.row AND b.col = a.col + 1 JOIN parts c ON c.component = a.component AND c.row = a.row + 1 AND c.col = a.col
        JOIN parts d ON d.component = a.component AND d.row = a.row + 1 AND d.col = a.col + 1 GROUP BY 1)
    SELECT p.component, any_value(p.label) AS label, count(*)::DOUBLE AS area, 2 - (count(*) - coalesce(any_value(e.n), 0) + coalesce(any_value(b.n), 0)) AS rings FROM parts p LEFT JOIN pairs e ON e.component = p.component LEFT JOIN blocks b ON b.component = p.component GROUP BY 1)""",
    ("pixels",),
)
def outline_rings(v: Views):
    """Area within the rings of each component, and their number: one and its holes."""
    parts = tiles.components(_grid(v))
    rings = tiles.outlines(parts)
    label = parts.groupBy("component").agg(F.first("label").alias("label"))
    c = F.col("component")
    name = tiles.pixel_row(c) * 100000 + tiles.pixel_col(c)
    out = rings.groupBy("component").agg(F.sum("area").alias("area"), F.count("*").alias("rings")).join(label, "component")
    return out.select(name.alias("component"), "label", "area", "rings")


@query(
    f"""SELECT * FROM (WITH RECURSIVE {_GRID}, box AS (SELECT r AS row, c AS col FROM (SELECT unnest(range(min(row), max(row) + 1)) AS r FROM grid), (SELECT unnest(range(min(col), max(col) + 1)) AS c FROM grid)),
    empty AS (SELECT b.row, b.col, l.label FROM box b, (SELECT DISTINCT label FROM grid) l ANTI JOIN grid k ON k.row = b.row AND k.col = b.col AND k.label = l.label),
    spread(r0, c0, row, col, label) AS (SELECT row, col, row, col, label FROM empty UNION SELECT r0, c0, g.row, g.col, g.label FROM spread h JOIN empty g ON g.label = h.label AND abs(g.row - h.row) + abs(g.col - h.col) = 1),
    gaps AS (SELECT row, col, label, min(r0 * 100000 + c0) AS hole FROM spread GROUP BY 1, 2, 3),
    holes AS (SELECT label, hole, count(*) AS n FROM gaps GROUP BY 1, 2 HAVING count(*) <= 6 AND min(row) > (SELECT min(row) FROM box) AND max(row) < (SELECT max(row) FROM box) AND min(col) > (SELECT min(col) FROM box) AND max(col) < (SELECT max(col) FROM box)),
    inside AS (SELECT g.row, g.col, g.label, g.hole, h.n FROM gaps g JOIN holes h ON h.label = g.label AND h.hole = g.hole),
    rim AS (SELECT DISTINCT i.label AS of, i.hole, o.row, o.col, o.label FROM inside i JOIN grid o ON abs(o.row - i.row) <= 1 AND abs(o.col - i.col) <= 1 ANTI JOIN inside x ON x.label = i.label AND x.hole = i.hole AND x.row = o.row AND x.col = o.col),
    won AS (SELECT of, hole FROM (SELECT of, hole, arg_min(label, (-n, label)) AS most FROM (SELECT of, hole, label, count(*) AS n FROM rim GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE most = of),
    best AS (SELECT i.row, i.col, arg_min(i.label, (-i.n, i.label)) AS label FROM inside i JOIN won w ON w.of = i.label AND w.hole = i.hole GROUP BY 1, 2)
    SELECT b.row, b.col, coalesce(n.label, g.label) AS label FROM box b LEFT JOIN grid g ON g.row = b.row AND g.col = b.col LEFT JOIN best n ON n.row = b.row AND n.col = b.col WHERE coalesce(n.label, g.label) IS NOT NULL)""",
    ("pixels",),
)
def filled_holes(v: Views):
    return tiles.relabel_holes(_grid(v), 6)


_GROWN = f"""{_REACHED}, seeds AS (SELECT floor(y / 100)::BIGINT AS row, floor(x / 100)::BIGINT AS col, min(cell_id) AS seed FROM cells GROUP BY 1, 2),
    walk(seed, row, col, component, steps) AS (SELECT s.seed, p.row, p.col, p.component, 0 FROM seeds s JOIN parts p ON p.row = s.row AND p.col = s.col
        UNION SELECT w.seed, p.row, p.col, p.component, w.steps + 1 FROM walk w JOIN parts p ON p.component = w.component AND abs(p.row - w.row) + abs(p.col - w.col) = 1 WHERE w.steps < 40),
    grown AS (SELECT p.row, p.col, p.label, p.component, n.seed FROM parts p LEFT JOIN (SELECT row, col, arg_min(seed, (steps, seed)) AS seed FROM walk GROUP BY 1, 2) n ON n.row = p.row AND n.col = p.col)"""


@query(
    f"""SELECT * FROM (WITH RECURSIVE {_GROWN} SELECT min(row * 2147483648 + col + 1073741824)::BIGINT AS cell, seed, any_value(label) AS label, (seed IS NOT NULL)::INT AS n_nuclei, count(*) AS pixels, count(*) * 10000.0::DOUBLE AS area FROM grown GROUP BY component, seed)""",
    ("pixels", "cells"),
)
def cells_of_nuclei(v: Views):
    """Segments of the label grid split by the cells' centres, with those that hold none."""
    return tiles.split_cells(_grid(v), v.cells.select(F.col("cell_id").alias("seed"), "x", "y"), 100.0)


# --- models per gene ---------------------------------------------------------------------------------------------------


def _bulk(v: Views):
    return dea.pseudobulk(v.expr, v.cells)


@query(
    _also(
        """SELECT b.subset, b.gene FROM (SELECT p.subset, p.gene, count(*) FILTER (p.count / l.lib >= 2 / r.m) AS k, sum(p.count) AS t, any_value(r.need) AS need FROM pb p JOIN libs l ON l.subset = p.subset AND l.sample = p.sample JOIN rule r ON r.subset = p.subset GROUP BY 1, 2) b
        WHERE k >= need - 1e-14 AND t >= 15""",
        _PB + """, libs AS (SELECT p.subset, p.sample, any_value(c.condition) AS condition, any_value(p.lib) AS lib FROM (SELECT subset, sample, sum(count) AS lib FROM pb GROUP BY 1, 2) p JOIN (SELECT sample, min(condition) AS condition FROM cells GROUP BY 1) c ON c.sample = p.sample GROUP BY 1, 2),
        rule AS (SELECT a.subset, a.m, CASE WHEN b.n > 10 THEN 10 + (b.n - 10) * 0.7 ELSE b.n END AS need FROM (SELECT subset, median(lib) AS m FROM libs GROUP BY 1) a JOIN (SELECT subset, min(n) AS n FROM (SELECT subset, condition, count(*) AS n FROM libs GROUP BY 1, 2) GROUP BY 1) b ON b.subset = a.subset)""",
    ),
    ("expr", "cells"),
)
def expressed_genes(v: Views):
    """Genes with enough counts per million in as many samples as the smallest condition has, of every subset and all."""
    known = v.cells.groupBy("sample").agg(F.min("condition").alias("condition"))
    return models.expressed(_bulk(v), known)


_FACTORS = """, sizes AS (SELECT s.subset, s.sample, sum(v)::DOUBLE AS size FROM (SELECT cell_type AS subset, sample, volume_final AS v FROM cells UNION ALL SELECT 'all', sample, volume_final FROM cells) s SEMI JOIN pb ON pb.subset = s.subset AND pb.sample = s.sample GROUP BY 1, 2),
    p AS (SELECT pb.subset, pb.sample, pb.gene, pb.count, s.size FROM pb JOIN sizes s ON s.subset = pb.subset AND s.sample = pb.sample WHERE s.size > 0),
    ng AS (SELECT subset, count(DISTINCT gene) AS genes FROM p GROUP BY 1),
    quart AS (SELECT subset, sample, sum(count / size * greatest(0, 1 - abs(r - mid))) AS q FROM (SELECT p.*, row_number() OVER (PARTITION BY p.subset, p.sample ORDER BY count DESC, gene) - 1 AS r, (genes - 1) * 0.25 AS mid FROM p JOIN ng ON ng.subset = p.subset) GROUP BY 1, 2),
    ref AS (SELECT subset, arg_min(sample, (round(abs(q - m), 12), sample)) AS ref FROM (SELECT *, avg(q) OVER (PARTITION BY subset) AS m FROM quart) GROUP BY 1),
    e AS (SELECT a.subset, a.sample, a.gene, round(log2((a.count / a.size) / (b.count / b.size)), 9) AS m, round((log2(a.count / a.size) + log2(b.count / b.size)) / 2, 9) AS l,
        CASE WHEN 1 / a.count - 1 / a.size + 1 / b.count - 1 / b.size > 0 THEN 1 / a.count - 1 / a.size + 1 / b.count - 1 / b.size ELSE 1 / a.count + 1 / b.count END AS v FROM p a JOIN ref r ON r.subset = a.subset JOIN p b ON b.subset = a.subset AND b.sample = r.ref AND b.gene = a.gene),
    k AS (SELECT *, count(*) OVER (PARTITION BY subset, sample) AS n, rank() OVER (PARTITION BY subset, sample ORDER BY m) + (count(*) OVER (PARTITION BY subset, sample, m) - 1) / 2 AS rm, rank() OVER (PARTITION BY subset, sample ORDER BY l) + (count(*) OVER (PARTITION BY subset, sample, l) - 1) / 2 AS ra FROM e),
    raw AS (SELECT subset, sample, sum(m / v) / sum(1 / v) AS g FROM k WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) GROUP BY 1, 2)"""


@query(
    _also(
        "SELECT subset, sample, round(size, 4) AS size, round(pow(2, g - avg(g) OVER (PARTITION BY subset)), 6) AS factor FROM (SELECT s.subset, s.sample, s.size, coalesce(r.g, 0) AS g FROM sizes s LEFT JOIN raw r ON r.subset = s.subset AND r.sample = s.sample WHERE s.size > 0)",
        _PB + _FACTORS,
    ),
    ("expr", "cells"),
)
def library_factors(v: Views):
    """Trimmed mean factors by volume, two-sided and weighted, of every subset and all."""
    pb = _bulk(v)
    return models.trimmed_mean_factors(pb, models.sample_sizes(pb, v.cells)).withColumns({"size": F.round("size", 4), "factor": F.round("factor", 6)})


@query()
def likelihood_ratio_tests(v: Views):
    """Negative-binomial models with dispersions of each gene, all conditions against WT, every subset and all."""
    return models.sample_tests(_bulk(v), v.cells, "WT", "LRT")


@query()
def quasi_likelihood_tests(v: Views):
    return models.sample_tests(_bulk(v), v.cells, "WT", "QL", batch="slide")


@query()
def precision_weighted_tests(v: Views):
    return models.sample_tests(_bulk(v), v.cells, "WT", "WLS")


@query()
def markers_by_models(v: Views):
    """Each condition against the mean of the others: genes far from chance and in the upper half of abundance."""
    return models.strong(models.sample_tests(_bulk(v), v.cells, None, "QL"))


@query()
def hurdle_with_covariate(v: Views):
    """Detection and expression ~ condition + slide."""
    return models.hurdle_model(v.expr, v.cells, "KO", "WT", batch="slide", cap=20_000)


_SPLIT = """b AS (SELECT cell_id, sample, cell_type AS subset, condition = 'KO' AS t FROM cells WHERE condition IN ('KO', 'WT') UNION ALL SELECT cell_id, sample, 'all', condition = 'KO' FROM cells WHERE condition IN ('KO', 'WT')),
    z AS (SELECT subset, count(*) FILTER (t) AS n1, count(*) FILTER (NOT t) AS n2 FROM b GROUP BY 1 HAVING count(*) FILTER (t) >= 1 AND count(*) FILTER (NOT t) >= 1),
    vals AS (SELECT b.subset, e.gene, e.count AS v, count(*) FILTER (t) AS a, count(*) AS n FROM expr e JOIN b ON b.cell_id = e.cell_id WHERE e.count > 0 GROUP BY 1, 2, 3),
    every AS (SELECT * FROM vals UNION ALL SELECT v.subset, v.gene, 0, any_value(z.n1) - sum(v.a), any_value(z.n1 + z.n2) - sum(v.n) FROM vals v JOIN z ON z.subset = v.subset GROUP BY 1, 2),
    rk AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY subset, gene ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM every)"""


@query(
    _also(
        """SELECT k.subset, k.gene, round((sum(a * r) - any_value(n1 * (n1 + n2 + 1) / 2)) / sqrt(any_value(n1 * n2 * (n1 + n2 + 1) / 12)), 6) AS u_z, round(log2((exp(sum(a * v) / any_value(n1)) - 1 + 1e-9) / (exp(sum((n - a) * v) / any_value(n2)) - 1 + 1e-9)), 6) AS log2fc
        FROM rk k JOIN z ON z.subset = k.subset GROUP BY 1, 2""",
        _SPLIT,
    ),
    ("expr", "cells"),
)
def rank_sum_by_type(v: Views):
    return dea.rank_sum_by(v.expr, v.cells, "KO", "WT").select("subset", "gene", "u_z", "log2fc")


@query(
    """SELECT b.subset, b.sample, b.rep, e.gene, sum(e.count)::BIGINT AS count, any_value(b.n_cells) AS n_cells FROM expr e JOIN (SELECT *, count(*) OVER (PARTITION BY subset, sample) AS n_cells, ntile(3) OVER (PARTITION BY subset, sample ORDER BY md5('0:' || cell_id)) AS rep FROM
    (SELECT cell_id, sample, cell_type AS subset FROM cells UNION ALL SELECT cell_id, sample, 'all' FROM cells)) b ON b.cell_id = e.cell_id WHERE b.n_cells >= 15 GROUP BY 1, 2, 3, 4""",
    ("expr", "cells"),
)
def pseudobulk_replicates(v: Views):
    return dea.pseudobulk(v.expr, v.cells, replicates=3).select("subset", "sample", F.col("rep").cast("int").alias("rep"), "gene", "count", "n_cells")


_CHOOSE = "lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1)"


@query(
    f"""SELECT term, pop_n, study_n, round(p, 9) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC, term DESC ROWS UNBOUNDED PRECEDING)), 9) AS fdr FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, term) AS raw FROM (SELECT term, pop_n, study_n, least(1, list_sum(list_transform(
    range(study_n, least(s, pop_n) + 1), lambda i: CASE WHEN s - i <= t - pop_n THEN exp({_CHOOSE.format(a="pop_n", b="i")} + {_CHOOSE.format(a="(t - pop_n)", b="(s - i)")} - ({_CHOOSE.format(a="t", b="s")})) ELSE 0 END))) AS p
    FROM (SELECT g.gene_set AS term, count(*) AS pop_n, count(*) FILTER (rank < 7) AS study_n FROM genes g GROUP BY 1), (SELECT count(*) FILTER (rank < 7) AS s, count(*) AS t FROM genes))) ORDER BY p, term LIMIT 30""",
    ("genes",),
)
def enriched_terms(v: Views):
    sets = v.genes.select(F.col("gene_set").alias("term"), "gene")
    e = dea.enrichment_test(v.genes.where("rank < 7").select("gene"), v.genes.select("gene"), sets, min_pop=1, min_study=1)
    return dea.top_terms(e).select("term", "pop_n", "study_n", *[F.round(c, 9).alias(c) for c in ("p", "fdr")])


# --- polygons ----------------------------------------------------------------------------------------------------------

_OCTAGON = "((2 * r) * (2 * r) - 2 * (r - r // 2) * (r - r // 2))"


@query(f"SELECT method, cell_id, round(max({_OCTAGON}), 4)::DOUBLE AS area, 1::BIGINT AS rings, 1.0::DOUBLE AS solidity FROM planes GROUP BY 1, 2", ("planes",))
def united_boundaries(v: Views):
    """All planes of a cell as one polygon: its area, its rings and its area by that of the hull."""
    out = overlay.union_shape(v.boundaries, ["method", "cell_id"])
    return out.select("method", "cell_id", F.round("area", 4).alias("area"), "rings", F.round("solidity", 6).alias("solidity"))


@query("SELECT sample, label IN ('CTX', 'STR', 'fiber_tracts', 'Meninges') AS wide, round(sum((x1 - x0) * (y1 - y0)), 4)::DOUBLE AS area FROM regions GROUP BY 1, 2", ("regions",))
def united_regions(v: Views):
    """Regions of one kind as polygons without the sides that they share."""
    ring = lambda a, b, c, d: F.array(a, b, c, d)
    r = v.regions.select("sample", F.col("label").isin("CTX", "STR", "fiber_tracts", "Meninges").alias("wide"), ring("x0", "x1", "x1", "x0").alias("xs"), ring("y0", "y0", "y1", "y1").alias("ys"))
    return overlay.united(r, ["sample", "wide"]).groupBy("sample", "wide").agg(F.round(F.sum("area"), 4).alias("area"))


@query("SELECT method, cell_id, z, 2.0 * r * (r // 2) AS area, 2::BIGINT AS rings FROM planes WHERE r // 2 > 0", ("planes",))
def crossed_rings(v: Views):
    """Rings that cross themselves made valid: each bow tie of two sides of an octagon becomes two triangles."""
    c = {k: F.col(k).cast("double") for k in ("cx", "cy", "r")}
    h = F.floor(F.col("r") / 2).cast("double")
    xs = F.array(c["cx"] - c["r"], c["cx"] + c["r"], c["cx"] + c["r"], c["cx"] - c["r"])
    ys = F.array(c["cy"] - h, c["cy"] + h, c["cy"] - h, c["cy"] + h)
    ties = v.planes.where("floor(r / 2) > 0").select("method", "cell_id", "z", xs.alias("xs"), ys.alias("ys"))
    out = overlay.united(ties, ["method", "cell_id", "z"]).groupBy("method", "cell_id", "z")
    return out.agg(F.round(F.sum("area"), 4).alias("area"), F.count("*").alias("rings"))


_RADIUS = "sqrt(4.0 * (o.r * o.r + (o.r // 2) * (o.r // 2)) + b.dz * b.dz) / 2"


@query(
    f"""SELECT b.cell_id, f.factor::DOUBLE AS factor, b.n, coalesce(sum((p.d2 <= ({_RADIUS}) * ({_RADIUS}) * f.factor * f.factor)::INT), 0)::BIGINT AS pairs, round(2.0 * coalesce(sum((p.d2 <= ({_RADIUS}) * ({_RADIUS}) * f.factor * f.factor)::INT), 0) / (b.n * (b.n - 1)), 6) AS score
    FROM (SELECT cell_id, count(*) AS n, max(z) - min(z) AS dz FROM transcripts GROUP BY 1 HAVING count(*) > 1) b JOIN octagons o ON o.cell_id = b.cell_id CROSS JOIN (SELECT unnest([0.25, 1.0, 20.0]) AS factor) f LEFT JOIN
    (SELECT a.cell_id, (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z) AS d2 FROM (SELECT *, row_number() OVER () AS i FROM transcripts) a JOIN (SELECT *, row_number() OVER () AS i FROM transcripts) c ON a.cell_id = c.cell_id AND a.i < c.i) p
    ON p.cell_id = b.cell_id GROUP BY b.cell_id, f.factor, b.n""",
    ("transcripts", "octagons"),
)
def pair_scores_by_radius(v: Views):
    """Pairs within shares of the radius of the least circle around a cell and its range of planes, all factors from one pass."""
    out = overlay.pair_scores_by_radius(v.transcripts, v.boundaries.where("method = 'A2D'"), [0.25, 1.0, 20.0])
    return out.withColumn("score", F.round("score", 6))


# --- files -------------------------------------------------------------------------------------------------------------


@query(f"SELECT cell_id::VARCHAR AS cell, z AS layer, round({_OCTAGON}, 4)::DOUBLE AS area, r FROM planes WHERE method = 'B3D' AND cell_id % 3 > 0", ("planes",))
def geojson_polygons(v: Views):
    """Polygons written as feature collections, read back, and joined to the cells that are known."""
    path = _scratch(v, "geojson")
    corner = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.array(p["xs"], p["ys"]))
    ring = F.concat(corner, F.slice(corner, 1, 1))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("cell_id").cast("string").alias("cell"), F.col("z").alias("layer")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    some = v.boundaries.where("method = 'B3D'").withColumn("part", F.floor(F.col("cell_id") / 100))
    files = some.groupBy("part").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    files.write.partitionBy("part").text(path)
    cells = v.octagons.where("cell_id % 3 > 0").select(F.col("cell_id").cast("string").alias("cell"), "r").join(v.planes.where("method = 'B3D'").select(F.col("cell_id").cast("string").alias("cell"), "z", F.col("r").alias("pr")), "cell")
    found = readers.polygons_of_cells(readers.geojson(v.spark, path).drop("part"), cells.drop("r").withColumnRenamed("pr", "r")).where("layer = z")
    return found.select("cell", "layer", F.round(geometry.area(F.col("xs"), F.col("ys")), 4).alias("area"), "r")


@query(
    """SELECT c.cell_id, EXISTS (SELECT 1 FROM octagons p WHERE p.cell_id % 7 = 0 AND abs(c.x - p.cx) < p.r AND abs(c.y - p.cy) < p.r AND 2 * (abs(c.x - p.cx) + abs(c.y - p.cy)) < 3 * p.r) AS is_outlier FROM cells c WHERE sample = 's0'""",
    ("cells", "octagons"),
)
def lasso_cells(v: Views):
    """Lassos written in a frame of their own, read back, mapped by a matrix from a file, and the cells in them."""
    drawn, matrix = _scratch(v, "lassos"), _scratch(v, "matrix")
    some = v.boundaries.where("method = 'A2D' and cell_id % 7 = 0").select(F.concat(F.lit("s"), "cell_id").alias("Selection"), F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"))
    rows = some.select("Selection", "i", ((F.col("p.xs") - 10) / 2).alias("X"), ((F.col("p.ys") - 10) / 2).alias("Y"))
    rows.repartition("Selection").sortWithinPartitions("Selection", "i").drop("i").write.option("header", True).csv(drawn)
    v.spark.createDataFrame([("2 0 10",), ("0 2 10",), ("0 0 1",)], "value string").coalesce(1).write.text(matrix)
    lassos = readers.mapped_lassos(readers.lassos(v.spark, drawn, "s0"), readers.affine_matrix(v.spark, matrix))
    return assign.outliers(v.cells.where("sample = 's0'"), lassos).select("cell_id", "is_outlier")


@query("SELECT 'rank' AS method, condition || 'vsWT' AS test, 'all' AS first, 1 + count(DISTINCT cell_type) AS subsets FROM cells WHERE condition <> 'WT' GROUP BY 1, 2", ("cells",))
def tests_layout(v: Views):
    """Tests of each subset written by method and test, and which subset comes first in each file."""
    path = _scratch(v, "tests")
    de = [dea.rank_sum_by(v.expr, v.cells, c, "WT").withColumns({"method": F.lit("rank"), "test": F.lit(f"{c}vsWT")}) for c in ("KO", "AGED")]
    readers.write_tests(de[0].unionByName(de[1]), path)
    back = v.spark.read.parquet(path).withColumn("at", F.monotonically_increasing_id())
    return back.groupBy("method", "test").agg(F.min_by("subset", "at").alias("first"), F.count_distinct("subset").alias("subsets"))


@query(f"SELECT * FROM (WITH {_GRID} SELECT (SELECT max(row) FROM grid) - row AS row, col - (SELECT min(col) FROM grid) AS col, label FROM grid)", ("pixels",))
def label_grid(v: Views):
    g = _grid(v)
    return raster.label_grid(g.select((F.col("col") * 100 + 50.0).alias("x"), (F.col("row") * 100 + 50.0).alias("y"), "label"))


@query(
    f"""SELECT * FROM (WITH RECURSIVE {_REACHED} SELECT component, label - 1 AS factor, CASE label - 1 WHEN 0 THEN 'Neurons' WHEN 1 THEN 'ECs' END AS cell_type, count(*) AS pixels, count(*) * 10000.0::DOUBLE AS area FROM parts GROUP BY 1, 2)""",
    ("pixels",),
)
def segment_table(v: Views):
    parts = tiles.components(_grid(v))
    c = F.col("component")
    return raster.segment_table(parts.withColumn("component", tiles.pixel_row(c) * 100000 + tiles.pixel_col(c)), 100.0, {0: "Neurons", 1: "ECs"})


@query(
    """SELECT cell_type, n_a, n_b, round(ma - mb, 6) AS delta, round((ma - mb) / mb, 6) AS relative, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)), 6) AS t FROM (SELECT cell_type, count(*) FILTER (condition = 'KO') AS n_a, count(*) FILTER (condition = 'WT') AS n_b,
    avg(volume_final) FILTER (condition = 'KO') AS ma, avg(volume_final) FILTER (condition = 'WT') AS mb, var_samp(volume_final) FILTER (condition = 'KO') AS va, var_samp(volume_final) FILTER (condition = 'WT') AS vb FROM cells GROUP BY 1)""",
    ("cells",),
)
def volume_differences(v: Views):
    """Volumes of two conditions' cells by type; p, a tail probability, is tested beside."""
    d = dea.two_sample_tests(v.cells, "volume_final", "condition", "KO", "WT", ["cell_type"]).drop("p")
    return d.withColumns({c: F.round(c, 6) for c in ("delta", "relative", "t")})


# --- patterns, hexagons, conditions ------------------------------------------------------------------------------------

_PATTERNS = "(SELECT unnest(['g1', 'g[23]5', 'Blank-', 'none']) AS pattern)"


@query(
    f"""SELECT pattern, cell_type, genes, tp, pos - tp AS fp, n_in * genes - tp AS fn, (total - n_in) * genes - pos + tp AS tn, round(tp / (n_in * genes), 3) AS sensitivity, round(((total - n_in) * genes - pos + tp) / ((total - n_in) * genes), 3) AS specificity,
    round((pos - tp) / ((total - n_in) * genes), 3) AS fpr, round(tp / nullif(pos, 0), 3) AS ppv, round(((total - n_in) * genes - pos + tp) / nullif(total * genes - pos, 0), 3) AS npv FROM
    (SELECT k.pattern, t.cell_type, k.genes, t.n_in, coalesce(h.tp, 0) AS tp, sum(coalesce(h.tp, 0)) OVER (PARTITION BY k.pattern)::BIGINT AS pos, sum(t.n_in) OVER (PARTITION BY k.pattern)::BIGINT AS total FROM
    (SELECT pattern, count(DISTINCT gene) AS genes FROM {_PATTERNS}, expr WHERE regexp_matches(gene, '^(?:' || pattern || ')') GROUP BY 1) k CROSS JOIN (SELECT cell_type, count(*) AS n_in FROM cells GROUP BY 1) t
    LEFT JOIN (SELECT p.pattern, c.cell_type, count(*) AS tp FROM expr e JOIN {_PATTERNS} p ON regexp_matches(e.gene, '^(?:' || p.pattern || ')') JOIN cells c ON c.cell_id = e.cell_id WHERE e.count > 20 GROUP BY 1, 2) h ON h.pattern = k.pattern AND h.cell_type = t.cell_type)""",
    ("expr", "cells"),
)
def pattern_specificity(v: Views):
    """Scores of patterns of gene names as tests for each type."""
    return metrics.pattern_scores(v.expr, v.cells, ["g1", "g[23]5", "Blank-", "none"], 20)


@query(
    """SELECT b.batch, count(*) AS n, count(*) FILTER (b.batch = floor(x / 500)::BIGINT) AS inner_points FROM (SELECT x, unnest(range(floor((x - 30) / 500)::BIGINT, floor((x + 30) / 500)::BIGINT + 1)) AS batch FROM transcripts) b GROUP BY 1""",
    ("transcripts",),
)
def strip_batches(v: Views):
    """Transcripts by strips along x with a margin on both sides."""
    b = raster.mini_batches(v.transcripts, "x", 500, 30)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.count_if("inner").alias("inner_points"))


@query(
    """WITH p AS (SELECT i, j, gene, x - i * 30.0 AS x, y - j * 30.0 AS y FROM transcripts, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j)),
    f AS (SELECT i, j, gene, (x * sqrt(3) / 3 - y / 3) / (60 / sqrt(3)) AS fq, y * 2 / 3 / (60 / sqrt(3)) AS fr FROM p),
    g AS (SELECT i, j, gene, round(fq) AS q, round(fr) AS r, round(-fq - fr) AS s, abs(round(fq) - fq) AS dq, abs(round(fr) - fr) AS dr, abs(round(-fq - fr) + fq + fr) AS ds FROM f),
    h AS (SELECT i, j, gene, (CASE WHEN dq > dr AND dq > ds THEN -r - s ELSE q END)::BIGINT AS q, (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -q - s ELSE r END)::BIGINT AS r FROM g),
    k AS (SELECT i, j, q, r FROM h GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
    SELECT h.i::INT AS i, h.j::INT AS j, h.q, h.r, h.gene, count(*) AS n FROM h JOIN k ON k.i = h.i AND k.j = h.j AND k.q = h.q AND k.r = h.r GROUP BY 1, 2, 3, 4, 5""".join(("SELECT * FROM (", ")")),
    ("transcripts",),
)
def hexagon_moves(v: Views):
    """Hexagons on four lattices, each moved on by half a width."""
    return raster.hex_moves(v.transcripts, 60.0, 5)


@query("SELECT cell_id, condition || '_' || slide AS name FROM cells", ("cells",))
def condition_names(v: Views):
    return v.cells.select("cell_id", labels.condition_name(F.col("condition"), F.col("slide")).alias("name"))
