"""Further registered queries: labels, shapes, factors, sources and sinks, embeddings, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from spotloom.operators import dea, embed, factors, graph, hoods, integrate, labels, metrics, qc, raster, shape, spatial
from spotloom.operators.tables import shared_dir
from spotloom.plans.catalog import _KNN, _PB, _TOTALS, _also
from spotloom.plans.registry import Views, query
from spotloom.sources import readers
from spotloom.streaming import ingest


def _scratch(v: Views, name: str) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("SELECT gene, count(*) AS n, sum(x)::DOUBLE AS x FROM transcripts GROUP BY 1", ("transcripts",))
def csv_transcripts(v: Views):
    path = _scratch(v, "csv")
    v.transcripts.select("gene", F.col("x").alias("global_x"), F.col("y").alias("global_y"), F.col("z").alias("global_z"), "sample").write.option("header", True).csv(path)
    return readers.transcripts_csv(v.spark, path).groupBy("gene").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@query("SELECT sample, gene, count(*) AS count FROM transcripts GROUP BY 1, 2", ("transcripts",))
def long_from_wide(v: Views):
    wide = v.transcripts.groupBy("sample").pivot("gene").agg(F.count(F.lit(1)).alias("n")).na.fill(0)
    return readers.wide_to_long(wide, "sample")


@query("SELECT sample, count(*) AS n FROM transcripts GROUP BY 1", ("transcripts",))
def partitioned_counts(v: Views):
    path = _scratch(v, "results")
    readers.write_results(v.transcripts.select("sample", "gene", "x", "y", "z"), path, ["sample"], ["gene"])
    return v.spark.read.parquet(path).groupBy(F.col("sample").cast("string").alias("sample")).agg(F.count("*").alias("n"))


@query("SELECT \"X\", \"Y\", gene, count(*) AS n FROM (SELECT x::DOUBLE AS \"X\", y::DOUBLE AS \"Y\", gene FROM transcripts) GROUP BY 1, 2, 3", ("transcripts",))
def exported_molecules(v: Views):
    path = _scratch(v, "molecules")
    readers.export_molecules(v.transcripts, path)
    back = v.spark.read.option("header", True).schema("X double, Y double, gene string, Count int").csv(path)
    return back.groupBy("X", "Y", "gene").agg(F.count("*").alias("n"))


@query("SELECT gene_set AS cell_type, gene, rank FROM genes WHERE gene_set <> '5-LOW'", ("genes",))
def long_markers(v: Views):
    wide = v.genes.groupBy("rank").pivot("gene_set").agg(F.first("gene")).drop("5-LOW")
    return readers.wide_to_long(wide, "rank", "cell_type", "gene").where("gene is not null").select("cell_type", "gene", "rank")


# --- labels -----------------------------------------------------------------------------------------------------------


@query(
    """SELECT cell_id, CASE cell_id % 8 WHEN 0 THEN 'Oligodendrocytes' WHEN 1 THEN 'Neurons-Glut' WHEN 2 THEN 'Neurons-Gaba' WHEN 3 THEN 'VLMCs' WHEN 4 THEN 'Other' WHEN 5 THEN 'Neurons-Dopa' WHEN 6 THEN 'Immune Cell' ELSE 'Astrocytes' END AS label FROM cells""",
    ("cells",),
)
def normal_labels(v: Views):
    names = ["327 Oligo NN", "006 L2/3 IT CTX Glut", "053 Sst Gaba", "330 VLMC NN", "9 Other", "215 SNc-VTA-RAmb Foxa1 Dopa-Gaba", "334 Immune Cell NN", "319 Astro-TE NN"]
    raw = F.element_at(F.array(*map(F.lit, names)), (F.col("cell_id") % 8 + 1).cast("int"))
    known = {"Oligo": "Oligodendrocytes", "VLMC": "VLMCs", "Neurons-Dopa-Gaba": "Neurons-Dopa", "Astro-TE": "Astrocytes"}
    return v.cells.select("cell_id", labels.normal_label(raw, known).alias("label"))


@query("SELECT DISTINCT method, replace(replace(method, 'A2D', 'Flat 2D'), 'B3D', 'Deep 3D') AS shown, starts_with(method, 'B') AS deep FROM planes", ("planes",))
def method_names(v: Views):
    m = v.planes.select("method").distinct()
    return m.select("method", labels.display_name(F.col("method"), [("A2D", "Flat 2D"), ("B3D", "Deep 3D")]).alias("shown"), labels.has_prefix(F.col("method"), ["B"]).alias("deep"))


@query("SELECT k1, CASE WHEN k1 % 3 = 0 THEN 'T' || k1 % 4 ELSE 'f' || k1 END AS label FROM (SELECT DISTINCT k1 FROM pixels)", ("pixels",))
def factor_names(v: Views):
    k = v.pixels.select("k1").distinct()
    second = k.where("k1 % 3 = 0").select(F.concat(F.lit("f"), "k1").alias("mid"), F.array(F.concat(F.lit("T"), (F.col("k1") % 4).cast("string")), F.lit("x")).alias("labels"))
    return labels.two_hop(k, "k1", k.select("k1", F.concat(F.lit("f"), "k1").alias("mid")), second)


@query("SELECT cell_id, CASE WHEN z > 0 THEN slide || '_s' || cluster || '_r' || z END AS name FROM cells", ("cells",))
def sample_names(v: Views):
    return v.cells.select("cell_id", labels.sample_name(F.col("slide"), F.col("cluster").cast("string"), F.when(F.col("z") > 0, F.col("z").cast("string"))).alias("name"))


@query("SELECT DISTINCT sample FROM cells WHERE (condition = 'KO' AND sample <> 's1') OR sample = 's0'", ("cells",))
def cohort(v: Views):
    meta = v.cells.select("sample", F.col("condition").alias("cohort")).distinct()
    return labels.cohort_samples(meta, "KO", meta.where("sample = 's1'").select("sample"), meta.where("sample = 's0'"))


@query("SELECT cell_type, count(*) AS n FROM cells WHERE cell_type IN ('1-URGENT', '5-LOW') GROUP BY 1", ("cells",))
def region_subset(v: Views):
    return labels.subset_regions(v.cells, "cell_type", "ends", {"ends": ["1-URGENT", "5-LOW"]}).groupBy("cell_type").agg(F.count("*").alias("n"))


@query("SELECT gene, count(*) AS n FROM transcripts WHERE x BETWEEN 200 AND 700 AND y BETWEEN 300 AND 900 GROUP BY 1", ("transcripts",))
def cropped(v: Views):
    return labels.crop(v.transcripts, 200, 300, 700, 900).groupBy("gene").agg(F.count("*").alias("n"))


@query("SELECT (x // 2000 * 2000)::INT AS \"BLOCK\", (x * 100)::INT AS \"X\", (y * 100)::INT AS \"Y\", count(*) AS n FROM transcripts GROUP BY 1, 2, 3", ("transcripts",))
def quantised_pixels(v: Views):
    return labels.quantised(v.transcripts.select("x", "y"), 0, 0).groupBy("BLOCK", "X", "Y").agg(F.count("*").alias("n"))


@query("SELECT method, cell_id, z, round(cx * 2.0 + 10, 6) AS x0 FROM planes", ("planes",))
def mapped_polygons(v: Views):
    from spotloom.functions import geometry

    m = [[0.5, 0.0, -5.0], [0.0, 0.5, 3.0], [0.0, 0.0, 1.0]]
    xs, _ = geometry.affine(F.col("xs"), F.col("ys"), geometry.inverse(m))
    return v.boundaries.select("method", "cell_id", "z", F.round(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / 8, 6).alias("x0"))


# --- shapes -----------------------------------------------------------------------------------------------------------

_AREA = "(4.0 * r * r - 2 * (r - r // 2) * (r - r // 2))"
_PERI = "(8.0 * (r // 2) + 4 * sqrt(2.0) * (r - r // 2))"


@query(
    f"""SELECT cell_id, round({_AREA} * 10.5, 6) AS volume, round(sqrt({_AREA}), 6) AS size, round(4 * pi() * {_AREA} / ({_PERI} * {_PERI}), 6) AS sphericity, round(sqrt(4 * {_AREA} / pi()), 6) AS diameter FROM planes WHERE method = 'A2D'""",
    ("planes",),
)
def flat_shapes(v: Views):
    s = shape.flat_shape(v.boundaries.where("method = 'A2D'"))
    return s.select("cell_id", *[F.round(c, 6).alias(c) for c in ("volume", "size", "sphericity", "diameter")])


@query(
    f"""SELECT cell_id, planes, round(CASE WHEN planes = 1 THEN area * 1.5 ELSE deep END, 6) AS volume, round(CASE WHEN planes = 1 THEN 2 * area + p * 1.5 ELSE p * span * 1.5 + ends END, 6) AS surface FROM
    (SELECT cell_id, count(*) AS planes, max(a) AS area, avg(p) AS p, max(z) - min(z) AS span, sum(coalesce((a + na) / 2 * (nz - z) * 1.5, 0) + CASE WHEN r1 AND z = z0 THEN a * 0.75 ELSE 0 END + CASE WHEN nz IS NULL AND z = z1 THEN a * 0.75 ELSE 0 END) AS deep,
    sum(CASE WHEN r1 THEN a ELSE 0 END + CASE WHEN nz IS NULL THEN a ELSE 0 END) AS ends FROM (SELECT cell_id, z, {_AREA} AS a, {_PERI} AS p, lead({_AREA}) OVER w AS na, lead(z) OVER w AS nz, row_number() OVER w = 1 AS r1,
    min(z) OVER () AS z0, max(z) OVER () AS z1 FROM planes WHERE method = 'B3D' WINDOW w AS (PARTITION BY cell_id ORDER BY z)) GROUP BY 1)""",
    ("planes",),
)
def deep_shapes(v: Views):
    s = shape.deep_shape(v.boundaries.where("method = 'B3D'"))
    return s.select("cell_id", "planes", F.round("volume", 6).alias("volume"), F.round("surface", 6).alias("surface"))


@query("SELECT method, cell_id, z, 1.0::DOUBLE AS solidity FROM planes", ("planes",))
def hull_shapes(v: Views):
    return shape.hull_shape(v.boundaries, ["method", "cell_id", "z"]).select("method", "cell_id", "z", F.round("solidity", 9).alias("solidity"))


@query(
    """SELECT method, x, y, z, gene, min(struct_pack(r := r, c := cell_id)).c AS cell_id FROM (SELECT DISTINCT p.method, t.x, t.y, t.z, t.gene, p.cell_id, p.r FROM transcripts t JOIN planes p ON (p.z IS NULL OR p.z = t.z) AND abs(t.x - p.cx) < p.r AND abs(t.y - p.cy) < p.r AND 2 * (abs(t.x - p.cx) + abs(t.y - p.cy)) < 3 * p.r) GROUP BY 1, 2, 3, 4, 5""",
    ("transcripts", "planes"),
)
def without_overlap(v: Views):
    from spotloom.functions import geometry

    points = v.transcripts.select("x", "y", "z", "gene").distinct()
    # Of equal polygons only the one of the least cell_id keeps a transcript.
    rings = v.boundaries.groupBy("method", F.col("z").alias("plane"), "xs", "ys").agg(F.min("cell_id").alias("cell_id"))
    sized = rings.withColumn("area", geometry.area(F.col("xs"), F.col("ys")))
    pairs = spatial.points_in_polygons(points, sized).where("plane is null or plane = z")
    return shape.one_cell_each(pairs, ["method", "x", "y", "z", "gene"]).select("method", "x", "y", "z", "gene", "cell_id")


# --- factors ----------------------------------------------------------------------------------------------------------


@query("SELECT gene, cell_type, n, round(n / sum(n) OVER (PARTITION BY cell_type), 6) AS of_factor, round(n / sum(n) OVER (PARTITION BY gene), 6) AS of_gene FROM (SELECT t.gene, c.cell_type, count(*) AS n FROM transcripts t JOIN cells c ON c.cell_id = t.cell_id GROUP BY 1, 2)", ("transcripts", "cells"))
def factor_gene_shares(v: Views):
    return factors.gene_shares(_typed(v), "cell_type")


def _typed(v: Views):
    return v.transcripts.select("gene", "cell_id").join(v.cells.select("cell_id", "cell_type"), "cell_id")


@query("SELECT * FROM (SELECT gene, cell_type, round(log2(n / f / ((g - n) / (t - f))), 6) AS ratio FROM (SELECT *, sum(n) OVER (PARTITION BY cell_type) AS f, sum(n) OVER (PARTITION BY gene) AS g, sum(n) OVER () AS t FROM (SELECT t.gene, c.cell_type, count(*) AS n FROM transcripts t JOIN cells c ON c.cell_id = t.cell_id GROUP BY 1, 2)) WHERE g > n) WHERE ratio > 0", ("transcripts", "cells"))
def factor_log_ratio(v: Views):
    return factors.log_ratio(factors.gene_shares(_typed(v), "cell_type"), "cell_type")


@query("SELECT a.gene_set AS name_a, 'r' || b.rank AS name_b, count(*) AS n FROM genes a JOIN genes b ON a.gene = b.gene GROUP BY 1, 2", ("genes",))
def set_overlap(v: Views):
    return factors.marker_overlap(v.genes.select(F.col("gene_set").alias("name"), "gene"), v.genes.select(F.concat(F.lit("r"), "rank").alias("name"), "gene"))


@query(
    """SELECT cell_type, factor, round(2 * tp / (2 * tp + e - tp + total - e), 6) AS f1 FROM (SELECT cell_type, factor, tp, sum(tp) OVER (PARTITION BY factor) AS e, total FROM (SELECT c.cell_type, c.cluster AS factor, sum(c.volume_final) AS tp FROM cells c GROUP BY 1, 2) a
    JOIN (SELECT cluster, sum(volume_final) * 1.5 AS total FROM cells GROUP BY 1) t ON t.cluster = a.factor)""",
    ("cells",),
)
def factor_f1(v: Views):
    a = v.cells.select("cell_type", F.col("cluster").alias("factor"), F.col("volume_final").alias("area"))
    return factors.coverage_f1(a, a.groupBy("factor").agg((F.sum("area") * 1.5).alias("total")))


@query(
    "SELECT factor, round(2 * sum((h AND o)::INT) / (2 * sum((h AND o)::INT) + sum((h AND NOT o)::INT) + sum((NOT h AND o)::INT)), 6) AS f1 FROM (SELECT cluster % 5 AS factor, volume_final >= 1500 AS h, (cluster % 5 = substr(cell_type, 1, 1)::INT - 1) AS o FROM cells) GROUP BY ROLLUP (factor)",
    ("cells",),
)
def threshold_f1(v: Views):
    val = v.cells.select((F.col("cluster") % 5).alias("factor"), "cell_type", F.col("volume_final").alias("value"))
    allowed = v.cells.select((F.substring("cell_type", 1, 1).cast("long") - 1).alias("factor"), "cell_type").distinct()
    return factors.threshold_f1(val, allowed, 1500)


@query("SELECT condition, cell_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY condition), 6) AS pct FROM cells GROUP BY 1, 2", ("cells",))
def type_distribution(v: Views):
    return factors.distribution(v.cells, "condition", "cell_type")


@query("SELECT condition, round(sum(m), 6) AS volume_final FROM (SELECT condition, sample, cell_type, min(volume_final) AS m FROM cells GROUP BY 1, 2, 3) GROUP BY 1", ("cells",))
def summed_once(v: Views):
    return factors.summed_once(v.cells, ["condition", "sample", "cell_type"], ["condition"], "volume_final")


@query(f"SELECT condition, sample, sum(n_counts)::BIGINT AS n, count(*) AS cells FROM ({_TOTALS}) GROUP BY ROLLUP (condition, sample)", ("cells", "expr"))
def totals_rollup(v: Views):
    return qc.cell_totals(v.cells, v.expr).rollup("condition", "sample").agg(F.sum("n_counts").alias("n"), F.count("*").alias("cells"))


@query(
    f"""SELECT condition, count(*) FILTER (n_counts > 0)::BIGINT AS cells, trunc(avg(n_counts))::INT AS mean_counts, trunc(avg(n_genes))::INT AS mean_genes, round(avg(n_counts / (volume_final * 7)), 4) AS density FROM ({_TOTALS}) GROUP BY 1""",
    ("cells", "expr"),
)
def combined_metrics(v: Views):
    t = qc.cell_totals(v.cells, v.expr).groupBy("condition")
    n = t.agg(F.count(F.when(F.col("n_counts") > 0, 1)).alias("cells"))
    means = t.agg(F.avg("n_counts").cast("int").alias("mean_counts"), F.avg("n_genes").cast("int").alias("mean_genes"))
    return metrics.combine([n, means, t.agg(F.round(F.avg(F.col("n_counts") / (F.col("volume_final") * 7)), 4).alias("density"))], "condition")


@query(
    f"""SELECT condition, cells, volume, rank_cells, rank_volume, rank_cells + rank_volume AS rank_sum, row_number() OVER (ORDER BY rank_cells + rank_volume, condition) AS final_rank FROM
    (SELECT *, row_number() OVER (ORDER BY cells DESC, condition) AS rank_cells, row_number() OVER (ORDER BY volume DESC, condition) AS rank_volume FROM (SELECT condition, count(*) AS cells, round(sum(volume_final), 2) AS volume FROM ({_TOTALS}) GROUP BY 1))""",
    ("cells", "expr"),
)
def ranked_methods(v: Views):
    m = v.cells.groupBy(F.col("condition").alias("method")).agg(F.count("*").alias("cells"), F.round(F.sum("volume_final"), 2).alias("volume"))
    return dea.rank_methods(m, ["cells", "volume"]).withColumnRenamed("method", "condition")


@query(
    """SELECT gene, round(least(1, min(raw) OVER (ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)), 9) AS fdr FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, gene) AS raw FROM
    (SELECT gene, (length(gene) * 31 + ascii(right(gene, 1)) * 17 + ascii(left(gene, 1))) % 97 / 97.0 AS p FROM genes))""",
    ("genes",),
)
def adjusted_p(v: Views):
    p = (F.length("gene") * 31 + F.ascii(F.substring("gene", -1, 1)) * 17 + F.ascii(F.substring("gene", 1, 1))) % 97 / 97.0
    return dea.benjamini_hochberg(v.genes.select("gene", p.alias("p"), F.lit(1).alias("one")), "p", ["one"], ["gene"]).select("gene", F.round("fdr", 9).alias("fdr"))


@query(
    _also(
        """SELECT subset, gene, sum(count)::BIGINT AS total FROM (SELECT p.*, (count * 1e6 / lib >= 2 * 1e6 / m)::INT AS ok, k FROM pb p JOIN (SELECT subset, sample, sum(count) AS lib FROM pb GROUP BY 1, 2) l ON l.subset = p.subset AND l.sample = p.sample
        JOIN (SELECT subset, median(lib) AS m, count(*) AS k FROM (SELECT subset, sample, sum(count) AS lib FROM pb GROUP BY 1, 2) GROUP BY 1) s ON s.subset = p.subset) GROUP BY 1, 2 HAVING sum(count) >= 15 AND sum(ok) * 3 >= any_value(k)""",
        _PB,
    ),
    ("expr", "cells"),
)
def detected_genes(v: Views):
    return dea.detected_genes(dea.pseudobulk(v.expr, v.cells))


@query("SELECT c.cell_type AS subset, 'KO' AS test_group, 'WT' AS ref, count(DISTINCT sample) FILTER (condition = 'KO') AS n_test, count(DISTINCT sample) FILTER (condition = 'WT') AS n_ref FROM cells c GROUP BY 1", ("cells",))
def group_sample_counts(v: Views):
    de = v.cells.select(F.col("cell_type").alias("subset")).distinct().withColumns({"test_group": F.lit("KO"), "ref": F.lit("WT")})
    return dea.group_sample_counts(de, v.cells)


@query("SELECT gene FROM (SELECT gene FROM expr INTERSECT SELECT gene FROM genes WHERE rank < 9 EXCEPT SELECT gene FROM genes WHERE rank = 2)", ("expr", "genes"))
def gene_set_algebra(v: Views):
    return v.expr.select("gene").intersect(v.genes.where("rank < 9").select("gene")).exceptAll(v.genes.where("rank = 2").select("gene"))


# --- embeddings, streams ----------------------------------------------------------------------------------------------


@query()
def pca_scores(v: Views):
    scores, _ = embed.pca(v.expr, v.cells.count(), 5, cells=v.cells)
    return scores.select("cell_id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"))


@query(
    """SELECT count(*) AS cells, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (SELECT k, min(CASE WHEN l = l2 THEN d END) AS a, min(CASE WHEN l <> l2 THEN d END) AS b FROM
    (SELECT x.vec_id AS k, x.label AS l, y.label AS l2, avg(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS d FROM s x JOIN s y ON x.vec_id <> y.vec_id GROUP BY 1, 2, 3) GROUP BY 1, l)""".join(
        ("SELECT * FROM (WITH s AS (SELECT * FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 10000) ", ")")
    )
)
def silhouette(v: Views):
    return embed.silhouette(v.embeddings, 10_000)


@query()
def integrated_vectors(v: Views):
    e = v.embeddings.withColumn("batch", F.col("vec_id") % 4)
    out, _ = integrate.integrate(e, "batch", 5)
    return out.select("vec_id", "batch", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("SELECT event_type AS gene, count(*) AS n FROM events GROUP BY 1")
def streamed_counts(v: Views):
    source, out, state = (_scratch(v, f"stream-{x}") for x in ("in", "out", "state"))
    e = v.events.select(F.col("event_type").alias("gene"), F.col("value").alias("x"))
    e.repartition(6).write.parquet(source)
    ingest.run_to_end(ingest.gene_counts(ingest.stream(v.spark, source, e.schema, 2)), out, state)
    return v.spark.read.parquet(out)


@query("SELECT min(value) AS x_min, max(value) AS x_max, count(value) AS n FROM events")
def streamed_bounds(v: Views):
    source, out, state = (_scratch(v, f"stream-{x}") for x in ("in", "out", "state"))
    e = v.events.select(F.col("event_type").alias("gene"), F.col("value").alias("x"))
    e.repartition(6).write.parquet(source)
    ingest.run_to_end(ingest.bounds(ingest.stream(v.spark, source, e.schema, 2)), out, state)
    return v.spark.read.parquet(out)


@query("SELECT p.px, p.py, p.k1, count(*) AS n FROM pixels p GROUP BY 1, 2, 3", ("pixels",))
def decoded_pixels(v: Views):
    path = _scratch(v, "decode")
    rows = v.pixels.select(F.concat_ws("\t", "px", "py", "k1", "k2", "k3", "p1", F.lit(0.0), F.lit(0.0)).alias("value"))
    rows.write.text(path)
    return readers.pixel_decode(v.spark, path).select(F.col("X").alias("px"), F.col("Y").alias("py"), F.get("k", F.lit(0)).alias("k1")).groupBy("px", "py", "k1").agg(F.count("*").alias("n"))


@query(
    "SELECT 'x' AS axis, median(g) AS gap FROM (SELECT x - lag(x) OVER (ORDER BY x) AS g FROM (SELECT DISTINCT x FROM transcripts)) UNION ALL SELECT 'y', median(g) FROM (SELECT y - lag(y) OVER (ORDER BY y) AS g FROM (SELECT DISTINCT y FROM transcripts))",
    ("transcripts",),
)
def grid_gaps(v: Views):
    return v.spark.createDataFrame([(c, float(raster.grid_spacing(v.transcripts, c))) for c in ("x", "y")], "axis string, gap double")


# --- components, nearest, models --------------------------------------------------------------------------------------

_GRID = "grid AS (SELECT row, col, k1 % 3 AS label FROM (SELECT py // 100 AS row, px // 100 AS col, k1, row_number() OVER (PARTITION BY py // 100, px // 100 ORDER BY count(*) DESC, k1) AS r FROM pixels GROUP BY 1, 2, 3) WHERE r = 1)"


def _grid(v: Views):
    return raster.majority_raster(v.pixels, 100).withColumn("label", (F.col("label") - 1) % 3)


@query(
    f"""SELECT * FROM (WITH RECURSIVE {_GRID}, reach(r0, c0, row, col, label) AS (SELECT row, col, row, col, label FROM grid UNION SELECT r0, c0, g.row, g.col, g.label FROM reach h JOIN grid g ON g.label = h.label AND abs(g.row - h.row) + abs(g.col - h.col) = 1)
    SELECT row, col, label, min(r0 * 100000 + c0) AS component FROM reach GROUP BY 1, 2, 3)""",
    ("pixels",),
)
def grid_segments(v: Views):
    g = graph.grid_components(_grid(v))
    return g.select("row", "col", "label", (F.col("component.row") * 100000 + F.col("component.col")).alias("component"))


@query(
    f"""SELECT * FROM (WITH RECURSIVE {_GRID}, reach(r0, c0, row, col, label) AS (SELECT row, col, row, col, label FROM grid UNION SELECT r0, c0, g.row, g.col, g.label FROM reach h JOIN grid g ON g.label = h.label AND abs(g.row - h.row) + abs(g.col - h.col) = 1),
    parts AS (SELECT row, col, label, min(r0 * 100000 + c0) AS component FROM reach GROUP BY 1, 2, 3), small AS (SELECT component FROM parts GROUP BY 1 HAVING count(*) < 3),
    votes AS (SELECT p.component, o.label AS next, count(*) AS n FROM parts p JOIN small s ON s.component = p.component JOIN parts o ON abs(o.row - p.row) <= 1 AND abs(o.col - p.col) <= 1 AND o.component <> p.component GROUP BY 1, 2),
    best AS (SELECT component, arg_min(next, (-n, next)) AS next FROM votes GROUP BY 1)
    SELECT p.row, p.col, coalesce(b.next, p.label) AS label FROM parts p LEFT JOIN best b ON b.component = p.component)""",
    ("pixels",),
)
def without_islands(v: Views):
    return graph.relabel_islands(graph.grid_components(_grid(v)), 3)


_WIDE = "label IN ('CTX', 'STR', 'fiber_tracts', 'Meninges')"
_PARTS = f"SELECT sample, {_WIDE} AS label, row_number() OVER (PARTITION BY sample ORDER BY x0, y0) AS idx, x0, y0, x1, y1 FROM regions"


@query(
    f"""SELECT * FROM (WITH RECURSIVE parts AS ({_PARTS}), reach(sample, label, a, b) AS (SELECT sample, label, idx, idx FROM parts UNION SELECT h.sample, h.label, h.a, q.idx FROM reach h JOIN parts p ON p.sample = h.sample AND p.idx = h.b
    JOIN parts q ON q.sample = p.sample AND q.label = p.label AND q.x0 <= p.x1 + 2 AND p.x0 <= q.x1 + 2 AND q.y0 <= p.y1 + 2 AND p.y0 <= q.y1 + 2),
    groups AS (SELECT sample, label, a AS idx, min(b) AS "group" FROM reach GROUP BY 1, 2, 3)
    SELECT sample, CASE WHEN label THEN 'wide' ELSE 'other' END AS label, idx::INT AS idx, "group"::INT AS "group" FROM (SELECT *, count(*) OVER (PARTITION BY sample, label, "group") AS n FROM groups) WHERE n > 1)""",
    ("regions",),
)
def dissolved_regions(v: Views):
    from spotloom.plans.catalog import _rings

    parts = _rings(v).withColumn("idx", F.row_number().over(Window.partitionBy("sample").orderBy("xs", "ys")))
    parts = parts.withColumn("label", F.when(F.expr(_WIDE), "wide").otherwise("other"))
    return graph.dissolved(parts, 1.0, 700.0 * 700 * 1.5).select("sample", "label", "idx", "group")


@query(
    "SELECT t.gene, t.x, t.y, round(sqrt(min((px - t.x) * (px - t.x) + (py - t.y) * (py - t.y))), 6) AS distance FROM (SELECT DISTINCT gene, x, y FROM transcripts WHERE gene = 'g10') t, (SELECT DISTINCT px, py FROM pixels WHERE k1 = 2) p GROUP BY 1, 2, 3",
    ("transcripts", "pixels"),
)
def distance_to_factor(v: Views):
    t = v.transcripts.where("gene = 'g10'").select("gene", "x", "y").distinct()
    p = v.pixels.where("k1 = 2").select(F.col("px").alias("rx"), F.col("py").alias("ry"), F.col("px").alias("at")).distinct()
    return spatial.nearest(t, p, "at", 100.0, 3000.0).select("gene", "x", "y", F.round("distance", 6).alias("distance"))


@query(
    "SELECT t.x, t.y, min((cx - t.x) * (cx - t.x) + (cy - t.y) * (cy - t.y)) AS d, arg_min(o.cell_id, ((cx - t.x) * (cx - t.x) + (cy - t.y) * (cy - t.y), o.cell_id)) AS seed FROM (SELECT DISTINCT x, y FROM transcripts) t, octagons o GROUP BY 1, 2",
    ("transcripts", "octagons"),
)
def nearest_seed(v: Views):
    t = v.transcripts.select("x", "y").distinct()
    seeds = v.octagons.select(F.col("cx").alias("rx"), F.col("cy").alias("ry"), F.col("cell_id").alias("seed"))
    out = spatial.nearest(t, seeds, "seed", 400.0, 3000.0)
    return out.select("x", "y", F.round(F.col("distance") * F.col("distance")).cast("long").alias("d"), "seed")


@query(f"SELECT k.src AS cell_id, e.gene, round(sum(e.count) / any_value(n.n), 6) AS mean FROM ({_KNN}) k JOIN expr e ON e.cell_id = k.dst JOIN (SELECT src, count(*) AS n FROM ({_KNN}) GROUP BY 1) n ON n.src = k.src GROUP BY 1, 2", ("cells", "expr"))
def neighbour_means(v: Views):
    return hoods.neighbour_means(v.cells.select("cell_id", "sample", "x", "y"), v.expr, 10, 60.0, ["sample"])


@query(
    """SELECT cell_id, n, u::BIGINT AS u, round(2 * u / (n * (n - 1)), 6) AS score FROM (SELECT a.cell_id, any_value(b.n) AS n, sum(((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) <= b.r2)::INT) AS u FROM
    (SELECT *, row_number() OVER () AS i FROM transcripts) a JOIN (SELECT *, row_number() OVER () AS i FROM transcripts) c ON a.cell_id = c.cell_id AND a.i < c.i
    JOIN (SELECT cell_id, count(*) AS n, ((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) * 0.25 AS r2 FROM transcripts GROUP BY 1) b ON b.cell_id = a.cell_id GROUP BY 1)""",
    ("transcripts",),
)
def pair_scores(v: Views):
    return spatial.pair_scores(v.transcripts, 1.0)


@query(
    _also(
        "SELECT sample, round(pow(2, avg(m)), 6) AS factor FROM (SELECT * FROM (SELECT *, quantile_cont(m, 0.3) OVER (PARTITION BY sample) AS lo, quantile_cont(m, 0.7) OVER (PARTITION BY sample) AS hi FROM ms)) WHERE m BETWEEN lo AND hi GROUP BY 1",
        _PB + ", fs AS (SELECT sample, gene, count / sum(count) OVER (PARTITION BY sample) AS f FROM pb WHERE subset = 'all'), ms AS (SELECT a.sample, a.gene, round(log2(a.f / b.f), 9) AS m FROM fs a JOIN fs b ON b.gene = a.gene AND b.sample = 's0' WHERE a.f > 0 AND b.f > 0)",
    ),
    ("expr", "cells"),
)
def trimmed_factors(v: Views):
    return dea.trimmed_factors(dea.pseudobulk(v.expr, v.cells).where("subset = 'all'"), "s0")


@query(
    _also(
        """SELECT gene, round(m1 - m0, 6) AS logfc, round((m1 - m0) / sqrt((4 * avg(s2) OVER () + d * s2) / (4 + d) * (1.0 / n1 + 1.0 / n0)), 6) AS t FROM (SELECT *, n1 + n0 - 2 AS d, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS s2 FROM
        (SELECT gene, count(y) FILTER (condition = 'KO') AS n1, count(y) FILTER (condition = 'WT') AS n0, avg(y) FILTER (condition = 'KO') AS m1, avg(y) FILTER (condition = 'WT') AS m0, var_samp(y) FILTER (condition = 'KO') AS v1, var_samp(y) FILTER (condition = 'WT') AS v0
        FROM ys GROUP BY 1) WHERE n1 > 1 AND n0 > 1)""",
        _PB + """, one AS (SELECT * FROM pb WHERE subset = 'all'), libs AS (SELECT o.sample, any_value(c.condition) AS condition, sum(o.count) / count(DISTINCT c.condition) AS lib FROM one o JOIN (SELECT DISTINCT sample, condition FROM cells WHERE condition IN ('KO', 'WT')) c ON c.sample = o.sample GROUP BY 1),
        ys AS (SELECT g.gene, l.condition, log2((coalesce(o.count, 0) + 0.5) / (l.lib + 1) * 1e6) AS y FROM (SELECT DISTINCT gene FROM one) g CROSS JOIN libs l LEFT JOIN one o ON o.gene = g.gene AND o.sample = l.sample)""",
    ),
    ("expr", "cells"),
)
def moderated_t(v: Views):
    return dea.moderated_t(dea.pseudobulk(v.expr, v.cells).where("subset = 'all'"), v.cells, "KO", "WT")


@query()
def negative_binomial(v: Views):
    return dea.negative_binomial(dea.pseudobulk(v.expr, v.cells).where("subset = 'all'"), v.cells, "KO", "WT")


@query()
def one_against_others(v: Views):
    return dea.negative_binomial(dea.pseudobulk(v.expr, v.cells).where("subset = 'all'"), v.cells, "KO", "WT", others=True)


@query()
def pseudobulk_components(v: Views):
    pb = dea.pseudobulk(v.expr, v.cells).where("subset = 'all'").select(F.col("sample").alias("cell_id"), "gene", "count")
    return embed.pca(pb, pb.select("cell_id").distinct().count(), 2)[0]
