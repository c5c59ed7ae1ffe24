"""Registered queries over the test views, each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.functions import geometry
from spotloom.operators import annotate, assign, dea, hoods, metrics, normalize, qc, raster, spatial
from spotloom.plans.registry import Views, query
from spotloom.sources.fixtures import TYPES

# --- transcripts in cells ----------------------------------------------------------------------------------------------

_IN = "abs(t.x - p.cx) < p.r AND abs(t.y - p.cy) < p.r AND 2 * (abs(t.x - p.cx) + abs(t.y - p.cy)) < 3 * p.r"
_HIT = f"EXISTS (SELECT 1 FROM planes p WHERE p.method = m.method AND (p.z IS NULL OR p.z = t.z) AND {_IN})"
_METHODS = "(SELECT DISTINCT method FROM planes) m"


@query(
    f"""SELECT m.method, t.sample, count(*) AS n, sum(({_HIT})::INT)::BIGINT AS assigned, round(100.0 * sum(({_HIT})::INT) / count(*), 6) AS pct
    FROM transcripts t, {_METHODS} GROUP BY 1, 2""",
    ("transcripts", "planes"),
)
def pct_assigned_by_method(v: Views):
    return assign.pct_assigned(v.transcripts, v.boundaries, ["sample"])


@query(
    f"""SELECT m.method, t.gene, count(*) AS n, sum(({_HIT})::INT)::BIGINT AS assigned, round(100.0 * sum(({_HIT})::INT) / count(*), 6) AS pct
    FROM transcripts t, {_METHODS} GROUP BY 1, 2""",
    ("transcripts", "planes"),
)
def pct_assigned_by_gene(v: Views):
    return assign.pct_assigned(v.transcripts, v.boundaries, ["gene"])


@query(
    f"""SELECT * FROM (SELECT method, gene, pct, row_number() OVER (PARTITION BY method ORDER BY pct DESC, gene) AS top,
    row_number() OVER (PARTITION BY method ORDER BY pct, gene) AS bottom FROM
    (SELECT m.method, t.gene, round(100.0 * sum(({_HIT})::INT) / count(*), 6) AS pct FROM transcripts t, {_METHODS} GROUP BY 1, 2))
    WHERE top <= 5 OR bottom <= 5""",
    ("transcripts", "planes"),
)
def extreme_genes_by_method(v: Views):
    from pyspark.sql import Window

    g = assign.pct_assigned(v.transcripts, v.boundaries, ["gene"]).select("method", "gene", "pct")
    w = Window.partitionBy("method")
    ranked = g.withColumns({"top": F.row_number().over(w.orderBy(F.desc("pct"), "gene")), "bottom": F.row_number().over(w.orderBy("pct", "gene"))})
    return ranked.where("top <= 5 or bottom <= 5")


@query(
    f"""SELECT method, cell_id, gene, n AS count FROM (SELECT *, sum(n) OVER (PARTITION BY method, cell_id) AS s FROM
    (SELECT p.method, p.cell_id, t.gene, count(*) AS n FROM transcripts t JOIN planes p ON (p.z IS NULL OR p.z = t.z) AND {_IN} GROUP BY 1, 2, 3)) WHERE s >= 10""",
    ("transcripts", "planes"),
)
def cell_by_gene(v: Views):
    return assign.cell_by_gene(v.transcripts, v.boundaries, 10)


_CELL_REGION = """SELECT c.cell_id, c.sample, c.cell_type, c.volume_final, min(g.label) AS region FROM cells c LEFT JOIN regions g
    ON g.sample = c.sample AND c.x BETWEEN g.x0 AND g.x1 AND c.y BETWEEN g.y0 AND g.y1 GROUP BY 1, 2, 3, 4"""


def _rings(v: Views):
    x, y = lambda *c: F.array(*map(F.col, c)), lambda *c: F.array(*map(F.col, c))
    return v.regions.select("sample", "label", F.lit(0).alias("idx"), x("x0", "x1", "x1", "x0").alias("xs"), y("y0", "y0", "y1", "y1").alias("ys"))


def _cell_regions(v: Views):
    return assign.points_to_regions(v.cells, _rings(v), "cell_id", 350.0)


@query(f"SELECT cell_id, region FROM ({_CELL_REGION})", ("cells", "regions"))
def cells_to_regions(v: Views):
    return _cell_regions(v).select("cell_id", "region")


@query(
    f"""SELECT sample, region, cell_type, count(*) AS n, round(sum(volume_final), 4) AS volume,
    round(count(*) / sum(count(*)) OVER (PARTITION BY sample, region), 6) AS share, round(count(*) / (700 * 700 * 1e-6), 6) AS per_mm2
    FROM ({_CELL_REGION}) WHERE region IS NOT NULL GROUP BY 1, 2, 3""",
    ("cells", "regions"),
)
def region_composition(v: Views):
    from pyspark.sql import Window

    areas = _rings(v).select("sample", F.col("label").alias("region"), (geometry.area(F.col("xs"), F.col("ys")) * 1e-6).alias("mm2"))
    areas = areas.groupBy("sample", "region").agg(F.sum("mm2").alias("mm2"))
    g = _cell_regions(v).where("region is not null").groupBy("sample", "region", "cell_type").agg(F.count("*").alias("n"), F.round(F.sum("volume_final"), 4).alias("volume"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("sample", "region")), 6)
    return g.withColumn("share", share).join(areas, ["sample", "region"]).select("sample", "region", "cell_type", "n", "volume", "share", F.round(F.col("n") / F.col("mm2"), 6).alias("per_mm2"))


@query(
    """SELECT c.sample, count(*) AS n, sum((EXISTS (SELECT 1 FROM regions g WHERE g.sample = c.sample AND g.label = 'CTX'
    AND c.x BETWEEN g.x0 AND g.x1 AND c.y BETWEEN g.y0 AND g.y1))::INT)::BIGINT AS outliers FROM cells c GROUP BY 1""",
    ("cells", "regions"),
)
def spatial_outliers(v: Views):
    lassos = _rings(v).where("label = 'CTX'")
    return assign.outliers(v.cells, lassos).groupBy("sample").agg(F.count("*").alias("n"), F.sum(F.col("is_outlier").cast("long")).alias("outliers"))


@query(
    """SELECT t.gene, t.x, t.y, t.z, coalesce(p.k1, 21) AS factor, count(*) AS n FROM (SELECT DISTINCT gene, x, y, z FROM transcripts) t
    LEFT JOIN (SELECT x, y, arg_min(k1, (d2, px, py, k1)) AS k1 FROM (SELECT x, y, px, py, k1, (px - x) * (px - x) + (py - y) * (py - y) AS d2 FROM
    (SELECT DISTINCT x, y, x // 5 AS tx, y // 5 AS ty FROM transcripts) a JOIN (SELECT px, py, k1, px // 5 + i AS tx, py // 5 + j AS ty FROM (SELECT DISTINCT px, py, k1 FROM pixels), (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) b
    ON a.tx = b.tx AND a.ty = b.ty) WHERE d2 <= 25 GROUP BY 1, 2) p ON p.x = t.x AND p.y = t.y GROUP BY 1, 2, 3, 4, 5""",
    ("transcripts", "pixels"),
)
def nearest_factor(v: Views):
    t = v.transcripts.select("gene", "x", "y", "z").distinct()
    p = v.pixels.select(F.col("px").alias("rx"), F.col("py").alias("ry"), F.col("k1").alias("factor")).distinct()
    out = spatial.nearest_within(t, p, 5.0, "factor", ["rx", "ry"], F.lit(21))
    return out.groupBy("gene", "x", "y", "z", "factor").agg(F.count("*").alias("n"))


_KNN = """SELECT src, dst, d2, rank FROM (SELECT a.cell_id AS src, b.cell_id AS dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2,
    row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) AS rank
    FROM cells a JOIN cells b ON a.sample = b.sample AND a.cell_id <> b.cell_id AND abs(a.x-b.x) <= 60 AND abs(a.y-b.y) <= 60
    AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 3600) WHERE rank <= 10"""


@query(_KNN, ("cells",))
def neighbours(v: Views):
    return spatial.k_nearest(v.cells.select("cell_id", "sample", "x", "y"), 10, 60.0, ["sample"]).select("src", "dst", "d2", "rank")


@query(
    f"""SELECT * FROM (WITH k AS MATERIALIZED ({_KNN}), e AS MATERIALIZED (SELECT DISTINCT k.src, k.dst, a.cell_type AS src_type, b.cell_type AS dst_type FROM k JOIN cells a ON a.cell_id = k.src JOIN cells b ON b.cell_id = k.dst),
    hood AS (SELECT src, src_type, dst AS cell_id FROM e UNION SELECT src, src_type, src FROM e),
    total AS (SELECT h.src, g.gene, sum(x.count) AS total FROM hood h JOIN genes g ON g.gene_set = h.src_type JOIN expr x ON x.cell_id = h.cell_id AND x.gene = g.gene WHERE x.count > 0 GROUP BY 1, 2),
    t AS (SELECT e.src_type, e.dst_type, coalesce(x.count, 0) / total AS share FROM e JOIN total t ON t.src = e.src LEFT JOIN expr x ON x.cell_id = e.dst AND x.gene = t.gene
        WHERE e.src_type <> e.dst_type AND NOT EXISTS (SELECT 1 FROM genes g WHERE g.gene = t.gene AND g.gene_set = e.dst_type))
    SELECT src_type, dst_type, count(*) AS triples, round(sum(share) / (count(*) + 1), 6) AS score FROM t GROUP BY 1, 2)""",
    ("cells", "expr", "genes"),
)
def neighbour_contamination(v: Views):
    return hoods.neighbour_contamination(v.cells, v.expr, v.genes, 10, 60.0, ["sample"])


# --- cells ------------------------------------------------------------------------------------------------------------

_TOTALS = """SELECT c.*, coalesce(e.n_counts, 0) AS n_counts, coalesce(e.n_genes, 0) AS n_genes FROM cells c LEFT JOIN
    (SELECT cell_id, sum(count)::BIGINT AS n_counts, count(*) AS n_genes FROM expr GROUP BY 1) e ON e.cell_id = c.cell_id"""


def _totals(v: Views):
    return qc.cell_totals(v.cells, v.expr)


@query(f"SELECT cell_id, n_counts, n_genes FROM ({_TOTALS})", ("cells", "expr"))
def cell_totals(v: Views):
    return _totals(v).select("cell_id", "n_counts", "n_genes")


@query(
    f"""SELECT cell_id, (n_counts < 60 OR n_genes < 2) AS is_low_quality, (volume_final < 100 OR volume_final > 3 *
    (SELECT median(volume_final) FROM ({_TOTALS}) WHERE NOT (n_counts < 60 OR n_genes < 2))) AS volume_outlier FROM ({_TOTALS})""",
    ("cells", "expr"),
)
def quality_flags(v: Views):
    return qc.quality_flags(_totals(v), 60, 2, 100).select("cell_id", "is_low_quality", "volume_outlier")


@query(f"SELECT sample, round(100.0 * avg((n_counts < 60 OR n_genes < 2)::INT), 1) AS pct_low FROM ({_TOTALS}) GROUP BY 1", ("cells", "expr"))
def outlier_percentage(v: Views):
    return qc.outlier_percentage(_totals(v), "sample", 60, 2)


@query("SELECT gene, count(*) AS n_cells FROM expr WHERE count > 0 GROUP BY 1 HAVING count(DISTINCT cell_id) >= 600", ("expr",))
def kept_genes(v: Views):
    return qc.keep_genes(v.expr, 600).groupBy("gene").agg(F.count("*").alias("n_cells"))


@query("SELECT gene, count(*) AS n FROM transcripts WHERE NOT starts_with(gene, 'Blank') AND NOT regexp_matches(gene, '(?i)G9[0-4]') AND gene <> 'g7' GROUP BY 1", ("transcripts",))
def without_controls(v: Views):
    return qc.drop_controls(v.transcripts, pattern="G9[0-4]", names=("g7",)).groupBy("gene").agg(F.count("*").alias("n"))


@query(f"SELECT least(floor((n_counts - lo) * 60 / (hi - lo)) + 1, 60)::BIGINT AS bin, count(*) AS n FROM ({_TOTALS}), (SELECT min(n_counts)::DOUBLE AS lo, max(n_counts)::DOUBLE AS hi FROM ({_TOTALS})) GROUP BY 1", ("cells", "expr"))
def count_histogram(v: Views):
    return qc.histogram(_totals(v), "n_counts", 60)


@query(
    """SELECT * FROM (SELECT sample, gene, mean_pct, row_number() OVER (PARTITION BY sample ORDER BY mean_pct DESC, gene) AS rank FROM
    (SELECT c.sample, e.gene, round(sum(e.pct) / any_value(s.n), 6) AS mean_pct FROM
    (SELECT cell_id, gene, 100.0 * count / sum(count) OVER (PARTITION BY cell_id) AS pct FROM expr) e JOIN cells c ON c.cell_id = e.cell_id
    JOIN (SELECT sample, count(*) AS n FROM cells WHERE cell_id IN (SELECT cell_id FROM expr) GROUP BY 1) s ON s.sample = c.sample GROUP BY 1, 2)) WHERE rank <= 20""",
    ("expr", "cells"),
)
def top_expressed(v: Views):
    return qc.top_expressed(v.expr, v.cells, 20)


@query(
    """SELECT sample, cell_type, n, round(100.0 * n / sum(CASE WHEN ga = 1 THEN n END) OVER (PARTITION BY sample, gs), 6) AS pct FROM
    (SELECT sample, cell_type, grouping(sample) AS gs, grouping(cell_type) AS ga, count(*) AS n FROM cells GROUP BY CUBE (sample, cell_type))""",
    ("cells",),
)
def type_crosstab(v: Views):
    return qc.crosstab(v.cells, ["sample"], "cell_type")


@query("SELECT condition, count(DISTINCT sample) AS n_samples, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM cells GROUP BY 1", ("cells",))
def samples_per_condition(v: Views):
    return qc.samples_per_condition(v.cells)


@query(
    """SELECT cell_id, count(*) OVER w AS n_cells_sum, round(avg(volume_final) OVER w, 4) AS volume_mean, round(sum(volume_final) OVER w, 2) AS volume_sum
    FROM cells WINDOW w AS (PARTITION BY cell_type, sample)""",
    ("cells",),
)
def group_columns(v: Views):
    return qc.group_columns(v.cells, ["cell_type", "sample"]).select("cell_id", "n_cells_sum", F.round("volume_mean", 4).alias("volume_mean"), F.round("volume_sum", 2).alias("volume_sum"))


@query("SELECT gene, " + ", ".join(f"count(*) FILTER (sample = 's{i}') AS s{i}" for i in range(12)) + ", count(*) AS total FROM transcripts GROUP BY 1", ("transcripts",))
def counts_by_sample(v: Views):
    return qc.counts_by_sample(v.transcripts, [f"s{i}" for i in range(12)])


@query("SELECT sample, cell_id FROM (SELECT sample, cell_id, row_number() OVER (PARTITION BY sample ORDER BY md5('0:' || cell_id), cell_id) AS n FROM cells) WHERE n <= 50", ("cells",))
def subsample(v: Views):
    return qc.subsample(v.cells, ["sample"], 50, "cell_id").select("sample", "cell_id")


@query(f"SELECT c.cell_id, n_counts FROM ({_TOTALS}) c JOIN (SELECT sample, quantile_cont(n_counts, 0.99) AS q FROM ({_TOTALS}) GROUP BY 1) t ON t.sample = c.sample WHERE n_counts <= q", ("cells", "expr"))
def clipped_counts(v: Views):
    return qc.clip_high(_totals(v), "n_counts", ["sample"], 0.99).select("cell_id", "n_counts")


@query("SELECT CASE WHEN n > 1 THEN gene_set || '.' || (n - 1) ELSE gene_set END AS gene_set, gene FROM (SELECT *, row_number() OVER (PARTITION BY gene_set ORDER BY gene) AS n FROM genes)", ("genes",))
def unique_names(v: Views):
    return qc.unique_names(v.genes, "gene_set", ["gene"]).select("gene_set", "gene")


@query("SELECT c.cell_id, coalesce(m.assignment, 'Low-Read-Cells') AS label FROM cells c LEFT JOIN (SELECT * FROM mapping WHERE n_runners > 0) m ON m.cell_id = c.cell_id", ("cells", "mapping"))
def attached_labels(v: Views):
    right = v.mapping.where("n_runners > 0").select("cell_id", F.col("assignment").alias("label"))
    return qc.attach(v.cells, right, "cell_id", {"label": "Low-Read-Cells"}).select("cell_id", "label")


# --- normalisation ----------------------------------------------------------------------------------------------------

_VOL = """per AS (SELECT e.cell_id, e.gene, e.count, e.count / c.volume_final AS vol FROM expr e JOIN cells c ON c.cell_id = e.cell_id WHERE c.volume_final > 0),
    sums AS (SELECT cell_id, sum(vol) AS s FROM per GROUP BY 1),
    kept AS (SELECT * FROM sums WHERE s > (SELECT quantile_cont(s, 0.01) FROM sums) AND s < (SELECT quantile_cont(s, 0.99) FROM sums))"""


def _also(sql: str, more: str) -> str:
    """A query that needs further common tables behind the views."""
    return f"SELECT * FROM (WITH {more} {sql})"


@query(_also("SELECT p.cell_id, p.gene, round(ln(1 + vol * 250 / (SELECT avg(s) FROM kept)), 6) AS norm FROM per p JOIN kept k ON k.cell_id = p.cell_id", _VOL), ("expr", "cells"))
def volume_normalised(v: Views):
    return normalize.volume_normalised(v.expr, v.cells).select("cell_id", "gene", F.round("norm", 6).alias("norm"))


@query(
    """SELECT cell_id, gene, round(ln(1 + count / sum(count) OVER (PARTITION BY cell_id) * (SELECT median(n) FROM (SELECT sum(count) AS n FROM expr GROUP BY cell_id))), 6) AS norm FROM expr""",
    ("expr",),
)
def library_normalised(v: Views):
    return normalize.library_normalised(v.expr).select("cell_id", "gene", F.round("norm", 6).alias("norm"))


@query(
    """SELECT gene, round(s / n, 6) AS mean, round(sqrt((q - s * s / n) / (n - 1)), 6) AS sd FROM
    (SELECT gene, sum(count)::DOUBLE AS s, sum(count * count)::DOUBLE AS q FROM expr GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM cells)""",
    ("expr", "cells"),
)
def gene_moments(v: Views):
    return normalize.gene_moments(v.expr, v.cells.count()).select("gene", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(
    """SELECT gene, bin, relative, rank FROM (SELECT *, row_number() OVER (ORDER BY relative DESC, gene) AS rank FROM (SELECT gene, bin, round(d / avg(d) OVER (PARTITION BY bin), 6) AS relative FROM
    (SELECT gene, ntile(20) OVER (ORDER BY s / n, gene) AS bin, ((q - s * s / n) / (n - 1)) / (s / n) AS d FROM
    (SELECT gene, sum(count)::DOUBLE AS s, sum(count * count)::DOUBLE AS q FROM expr GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM cells)))) WHERE rank <= 20""",
    ("expr", "cells"),
)
def variable_genes(v: Views):
    return normalize.variable_genes(v.expr, v.cells.count())


_SCORE = """means AS (SELECT gene, sum(count) / (SELECT count(*) FROM cells) AS mean FROM expr GROUP BY 1),
    bins AS (SELECT gene, ntile(25) OVER (ORDER BY mean, gene) AS bin FROM means),
    drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(gene)) AS n FROM bins) WHERE n <= 50),
    marks AS (SELECT g.gene_set, g.gene, b.bin FROM genes g JOIN bins b ON b.gene = g.gene WHERE g.rank < 8),
    pool AS (SELECT DISTINCT m.gene_set, d.gene FROM marks m JOIN drawn d ON d.bin = m.bin WHERE NOT EXISTS (SELECT 1 FROM marks x WHERE x.gene_set = m.gene_set AND x.gene = d.gene)),
    weights AS (SELECT gene_set, gene, 1.0 / count(*) OVER (PARTITION BY gene_set) AS w FROM marks UNION ALL SELECT gene_set, gene, -1.0 / count(*) OVER (PARTITION BY gene_set) FROM pool),
    scores AS (SELECT e.cell_id, w.gene_set, round(sum(e.count * w.w), 6) AS score FROM expr e JOIN weights w ON w.gene = e.gene GROUP BY 1, 2)"""


def _scores(v: Views):
    return normalize.marker_scores(v.expr, v.genes, v.cells, top=8)


@query(_also("SELECT cell_id, gene_set, round(score, 4) AS score FROM scores", _SCORE), ("expr", "cells", "genes"))
def marker_gene_scores(v: Views):
    return _scores(v).withColumn("score", F.round("score", 4))


_LINEAGES = "(VALUES ('A', 'g10'), ('A', 'g20'), ('A', 'g30'), ('A', 'absent'), ('B', 'g11'), ('B', 'g21'), ('C', 'absent'))"


def _lineages(v: Views):
    rows = [("A", "g10"), ("A", "g20"), ("A", "g30"), ("A", "absent"), ("B", "g11"), ("B", "g21"), ("C", "absent")]
    return normalize.contamination(v.expr, v.cells, v.spark.createDataFrame(rows, "lineage string, gene string"))


@query(
    f"""SELECT cell_id, lineage, round(m, 6) AS mean_marker, round(z, 6) AS zscore, coalesce(m > 1 AND z > 2, false) AS contaminated FROM (SELECT *, (m - avg(m) OVER (PARTITION BY lineage)) / nullif(stddev_pop(m) OVER (PARTITION BY lineage), 0) AS z FROM
    (SELECT c.cell_id, l.lineage, coalesce(sum(e.count), 0) / any_value(l.k) AS m FROM cells c CROSS JOIN (SELECT lineage, nullif(count(*) FILTER (gene IN (SELECT gene FROM expr)), 0) AS k FROM {_LINEAGES} x(lineage, gene) GROUP BY 1) l
    LEFT JOIN (SELECT e.cell_id, e.count, x.lineage FROM expr e JOIN {_LINEAGES} x(lineage, gene) ON x.gene = e.gene) e ON e.cell_id = c.cell_id AND e.lineage = l.lineage GROUP BY 1, 2))""",
    ("expr", "cells"),
)
def contamination_flags(v: Views):
    return _lineages(v).withColumns({c: F.round(c, 6) for c in ("mean_marker", "zscore")})


@query(
    f"""SELECT cell_id, bool_or(coalesce(m > 1 AND z > 2, false)) AS contaminated FROM (SELECT *, (m - avg(m) OVER (PARTITION BY lineage)) / nullif(stddev_pop(m) OVER (PARTITION BY lineage), 0) AS z FROM
    (SELECT c.cell_id, l.lineage, coalesce(sum(e.count), 0) / any_value(l.k) AS m FROM cells c CROSS JOIN (SELECT lineage, nullif(count(*) FILTER (gene IN (SELECT gene FROM expr)), 0) AS k FROM {_LINEAGES} x(lineage, gene) GROUP BY 1) l
    LEFT JOIN (SELECT e.cell_id, e.count, x.lineage FROM expr e JOIN {_LINEAGES} x(lineage, gene) ON x.gene = e.gene) e ON e.cell_id = c.cell_id AND e.lineage = l.lineage GROUP BY 1, 2)) GROUP BY 1""",
    ("expr", "cells"),
)
def contaminated_cells(v: Views):
    return normalize.contaminated_cells(_lineages(v))


# --- annotation -------------------------------------------------------------------------------------------------------


@query(
    """SELECT m.cell_id, CASE WHEN probability < med - 1.2 * mad THEN 'Undefined' ELSE m.assignment END AS assignment FROM mapping m JOIN
    (SELECT x.assignment, any_value(med) AS med, median(abs(probability - med)) AS mad FROM mapping x JOIN (SELECT assignment, median(probability) AS med FROM mapping GROUP BY 1) y
    ON y.assignment = x.assignment GROUP BY 1) t ON t.assignment = m.assignment""",
    ("mapping",),
)
def mad_outliers(v: Views):
    m = v.mapping.withColumns({"probability": F.col("probability").cast("double"), "g": F.col("assignment")})
    return annotate.mad_outliers(m, "probability", "g", 1.2, "assignment").select("cell_id", "assignment")


def _runners(v: Views):
    each = lambda f: F.transform(F.sequence(F.lit(1), F.col("n_runners")), f)
    none = F.col("n_runners") == 0
    names = F.when(none, F.array().cast("array<string>")).otherwise(each(lambda k: F.concat(F.lit("T"), ((F.col("cell_id") + k) % 5).cast("string"))))
    probs = F.when(none, F.array().cast("array<double>")).otherwise(each(lambda k: ((F.col("cell_id") + k * 7) % 40).cast("double") / 100))
    return v.mapping.select("cell_id", "assignment", F.col("probability").cast("double").alias("probability"), names.alias("runner_up"), probs.alias("runner_up_probability"))


_LEAD = """SELECT cell_id, 'T' || (cell_id % 5) AS own, CASE WHEN n_runners > 0 THEN 'T' || ((cell_id + 1) % 5) END AS runner_1, CASE WHEN n_runners > 1 THEN 'T' || ((cell_id + 2) % 5) END AS runner_2,
    round(CASE WHEN n_runners > 0 THEN probability - ((cell_id + 7) % 40) / 100.0 ELSE 1.0 END, 6)::DOUBLE AS lead FROM mapping"""


@query(f"SELECT cell_id, runner_1, runner_2, lead FROM ({_LEAD})", ("mapping",))
def flat_mapping(v: Views):
    return annotate.flatten_mapping(_runners(v)).select("cell_id", "runner_1", "runner_2", F.round("lead", 6).alias("lead"))


@query(f"SELECT cell_id, coalesce(lead < 0.3 AND own <> runner_1, false) AS is_mixed, CASE WHEN coalesce(lead < 0.3 AND own <> runner_1, false) THEN own || '/' || runner_1 ELSE own END AS mixed_names FROM ({_LEAD})", ("mapping",))
def mixed_labels(v: Views):
    m = annotate.flatten_mapping(_runners(v)).select("cell_id", F.concat(F.lit("T"), (F.col("cell_id") % 5).cast("string")).alias("own"), "runner_1", F.round("lead", 6).alias("lead"))
    return annotate.mixed_labels(m, "own", "runner_1", "lead", 0.3).select("cell_id", "is_mixed", "mixed_names")


_CLUSTER = """clusters AS (SELECT cluster, cell_type, share FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY share DESC, cell_type) AS r FROM
    (SELECT cluster, cell_type, n / total AS share FROM (SELECT cluster, cell_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY cell_type) AS total FROM cells GROUP BY 1, 2) WHERE total >= 100)) WHERE r = 1)"""


@query(_also("SELECT cluster, cell_type, round(share, 6) AS share FROM clusters", _CLUSTER), ("cells",))
def cluster_labels(v: Views):
    return annotate.assign_clusters(v.cells, "cluster", "cell_type", 100)


@query(
    _also("SELECT c.cell_id, CASE WHEN s.score >= 0.3 THEN s.gene_set ELSE 'Undefined' END AS label FROM cells c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, gene_set) AS r FROM scores) s ON s.cell_id = c.cell_id AND s.r = 1", _SCORE),
    ("expr", "cells", "genes"),
)
def labels_by_score(v: Views):
    return annotate.label_by_score(_scores(v), v.cells, 0.3)


@query(
    _also(
        """SELECT l.cluster, l.cell_type AS label, CASE WHEN b.m >= 0.05 AND (o.m IS NULL OR b.m - o.m > 0.2) AND b.gene_set <> l.cell_type THEN b.gene_set WHEN coalesce(b.m < 0.03, true) THEN 'Undefined' ELSE l.cell_type END AS decided
        FROM clusters l LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY m DESC, gene_set) AS r FROM cm) WHERE r = 1) b ON b.cluster = l.cluster
        LEFT JOIN cm o ON o.cluster = l.cluster AND o.gene_set = l.cell_type""",
        f"""{_SCORE}, {_CLUSTER}, cm AS (SELECT c.cluster, s.gene_set, sum(s.score) / any_value(n.n) AS m FROM scores s JOIN cells c ON c.cell_id = s.cell_id
        JOIN (SELECT cluster, count(*) AS n FROM cells GROUP BY 1) n ON n.cluster = c.cluster GROUP BY 1, 2)""",
    ),
    ("expr", "cells", "genes"),
)
def decided_clusters(v: Views):
    labels = annotate.assign_clusters(v.cells, "cluster", "cell_type", 100).select("cluster", F.col("cell_type").alias("label"))
    return annotate.decide(_scores(v), v.cells, labels, 0.05, 0.03, 0.2).select("cluster", "label", "decided")


# --- metrics ----------------------------------------------------------------------------------------------------------

_CONF = """conf AS (SELECT cell_type, gene, tp, pos - tp AS fp, n_in - tp AS fn, total - n_in - pos + tp AS tn FROM (SELECT t.cell_type, g.gene, t.n_in, g.pos, coalesce(x.tp, 0) AS tp, (SELECT count(*) FROM cells) AS total
    FROM (SELECT cell_type, count(*) AS n_in FROM cells GROUP BY 1) t, (SELECT gene, count(*) AS pos FROM expr WHERE count > 20 GROUP BY 1) g
    LEFT JOIN (SELECT e.gene, c.cell_type, count(*) AS tp FROM expr e JOIN cells c ON c.cell_id = e.cell_id WHERE e.count > 20 GROUP BY 1, 2) x ON x.gene = g.gene AND x.cell_type = t.cell_type))"""


@query(
    _also(
        """SELECT cell_type, gene, round(tp / nullif(tp + fn, 0), 3) AS sensitivity, round(tn / nullif(tn + fp, 0), 3) AS specificity, round(fp / nullif(fp + tn, 0), 3) AS fpr,
        round(tp / nullif(tp + fp, 0), 3) AS ppv, round(tn / nullif(tn + fn, 0), 3) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 3) AS f1 FROM conf""", _CONF),
    ("expr", "cells"),
)
def marker_specificity(v: Views):
    return metrics.marker_scores(metrics.marker_confusion(v.expr, v.cells, v.genes, 20))


@query(
    _also(
        """SELECT c.cell_type, g.gene_set AS marker_type, c.gene, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
        c.cell_type = g.gene_set AS matches FROM conf c JOIN genes g ON g.gene = c.gene""", _CONF),
    ("expr", "cells", "genes"),
)
def cross_f1(v: Views):
    return metrics.cross_f1(v.expr, v.cells, v.genes, 20)


@query(_also("SELECT cell_type, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6) AS f1 FROM (SELECT c.* FROM conf c JOIN genes g ON g.gene = c.gene AND g.gene_set = c.cell_type) GROUP BY ROLLUP (cell_type)", _CONF), ("expr", "cells", "genes"))
def micro_f1(v: Views):
    return metrics.micro_f1(metrics.marker_confusion(v.expr, v.cells, v.genes, 20), v.genes)


@query(
    """SELECT m.gene_a, m.gene_b, coalesce(p."both", 0) AS "both", coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(p."both", 0) AS either,
    round(coalesce(p."both", 0) / nullif(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(p."both", 0), 0), 6) AS mecr FROM
    (SELECT gx.gene AS gene_a, gy.gene AS gene_b FROM genes gx JOIN genes gy ON gx.gene < gy.gene AND gx.gene_set <> gy.gene_set) m LEFT JOIN (SELECT x.gene AS gene_a, y.gene AS gene_b, count(*) AS "both" FROM expr x JOIN expr y ON x.cell_id = y.cell_id AND x.gene < y.gene JOIN genes gx ON gx.gene = x.gene JOIN genes gy ON gy.gene = y.gene AND gx.gene_set <> gy.gene_set
    WHERE x.count > 0 AND y.count > 0 GROUP BY 1, 2) p ON p.gene_a = m.gene_a AND p.gene_b = m.gene_b LEFT JOIN (SELECT gene, count(*) AS n FROM expr WHERE count > 0 GROUP BY 1) a ON a.gene = m.gene_a
    LEFT JOIN (SELECT gene, count(*) AS n FROM expr WHERE count > 0 GROUP BY 1) b ON b.gene = m.gene_b""",
    ("expr", "genes"),
)
def coexpression(v: Views):
    return metrics.coexpression(v.expr, v.genes)


@query(
    _also(
        """SELECT gene, round(sum(abs(fa - fb) * (nv - v)), 6) AS distance FROM (SELECT gene, v, lead(v) OVER w AS nv, sum(a) OVER w / n1 AS fa, sum(b) OVER w / n2 AS fb FROM every, sizes WINDOW w AS (PARTITION BY gene ORDER BY v)) GROUP BY 1""",
        f"""sizes AS (SELECT count(*) FILTER (cell_type = '{TYPES[0]}') AS n1, count(*) FILTER (cell_type <> '{TYPES[0]}') AS n2 FROM cells),
        vals AS (SELECT e.gene, e.count AS v, count(*) FILTER (c.cell_type = '{TYPES[0]}') AS a, count(*) FILTER (c.cell_type <> '{TYPES[0]}') AS b FROM expr e JOIN cells c ON c.cell_id = e.cell_id GROUP BY 1, 2),
        every AS (SELECT gene, v, sum(a) AS a, sum(b) AS b FROM (SELECT * FROM vals UNION ALL SELECT gene, 0, n1 - sum(a), n2 - sum(b) FROM vals, sizes GROUP BY gene, n1, n2) GROUP BY 1, 2)""",
    ),
    ("expr", "cells"),
)
def wasserstein(v: Views):
    return metrics.wasserstein(v.expr, v.cells, TYPES[0])


@query(
    """SELECT k, n, round((b / (k - 1)) / (w / (n - k)), 6) AS ch FROM (SELECT sum(g - s * s / n) AS b, sum(q - g) AS w, max(n)::BIGINT AS n, max(k) AS k FROM
    (SELECT d, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS g, sum(n) AS n, count(*) AS k FROM (SELECT label, d, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM
    (SELECT label, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1))""",
)
def calinski_harabasz(v: Views):
    return metrics.calinski_harabasz(v.embeddings)


# --- differential expression ------------------------------------------------------------------------------------------

_PB = """pb AS (SELECT b.subset, b.sample, e.gene, sum(e.count)::BIGINT AS count, any_value(n.n) AS n_cells FROM expr e JOIN
    (SELECT cell_id, sample, cell_type AS subset FROM cells UNION ALL SELECT cell_id, sample, 'all' FROM cells) b ON b.cell_id = e.cell_id JOIN
    (SELECT subset, sample, count(*) AS n FROM (SELECT sample, cell_type AS subset FROM cells UNION ALL SELECT sample, 'all' FROM cells) GROUP BY 1, 2 HAVING count(*) >= 15) n
    ON n.subset = b.subset AND n.sample = b.sample GROUP BY 1, 2, 3)"""


@query(_also("SELECT subset, sample, gene, count, n_cells FROM pb", _PB), ("expr", "cells"))
def pseudobulk(v: Views):
    return dea.pseudobulk(v.expr, v.cells).drop("rep")


@query(_also("SELECT subset FROM (SELECT p.subset, c.condition, count(*) AS n FROM (SELECT DISTINCT subset, sample FROM pb) p JOIN (SELECT DISTINCT sample, condition FROM cells) c ON c.sample = p.sample GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2 AND min(n) >= 2 AND bool_or(condition = 'WT')", _PB), ("expr", "cells"))
def testable_subsets(v: Views):
    return dea.testable(dea.pseudobulk(v.expr, v.cells), v.cells, "WT")


_RANKED = """here AS (SELECT e.gene, e.count AS v, c.condition = 'KO' AS t FROM expr e JOIN cells c ON c.cell_id = e.cell_id WHERE c.condition IN ('KO', 'WT')),
    sizes AS (SELECT count(*) FILTER (condition = 'KO') AS n1, count(*) FILTER (condition = 'WT') AS n2 FROM cells),
    vals AS (SELECT gene, v, count(*) FILTER (t) AS a, count(*) AS n FROM here GROUP BY 1, 2),
    every AS (SELECT gene, v, sum(a) AS a, sum(n) AS n FROM (SELECT * FROM vals UNION ALL SELECT gene, 0, n1 - sum(a), n1 + n2 - sum(n) FROM vals, sizes GROUP BY gene, n1, n2) GROUP BY 1, 2),
    ranked AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY gene ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk FROM every)"""


@query(
    _also("SELECT gene, round((sum(a * rk) - any_value(n1) * (any_value(n1) + any_value(n2) + 1) / 2) / sqrt(any_value(n1) * any_value(n2) * (any_value(n1) + any_value(n2) + 1) / 12), 6) AS u_z FROM ranked, sizes GROUP BY 1", _RANKED),
    ("expr", "cells"),
)
def rank_sum(v: Views):
    return dea.rank_sum(v.expr, v.cells, "KO", "WT").select("gene", "u_z")


_P = "(1 / (1 + abs(u_z) / sqrt(2) / 2))"
_TAIL = "0.0"
for _c in dea._ERFC:
    _TAIL = f"({_TAIL} * {_P} + {_c})"


@query(
    _also(
        f"""SELECT gene, u_z, log2fc, 'KOvsWT' AS test, round(p, 9) AS p, round(least(1, min(p * n / r) OVER (ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)), 9) AS fdr FROM
        (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, gene) AS r FROM (SELECT *, {_P} * exp({_TAIL} - u_z * u_z / 2) AS p FROM
        (SELECT gene, round((sum(a * rk) - any_value(n1) * (any_value(n1) + any_value(n2) + 1) / 2) / sqrt(any_value(n1) * any_value(n2) * (any_value(n1) + any_value(n2) + 1) / 12), 6) AS u_z,
        round(log2((exp(sum(a * v) / any_value(n1)) - 1 + 1e-9) / (exp(sum((n - a) * v) / any_value(n2)) - 1 + 1e-9)), 6) AS log2fc FROM ranked, sizes GROUP BY 1)))""",
        _RANKED,
    ),
    ("expr", "cells"),
)
def rank_sum_test(v: Views):
    return dea.rank_sum_test(v.expr, v.cells, "KO", "WT").withColumns({c: F.round(c, 9) for c in ("p", "fdr")})


def _xlogx(k: str, n: str) -> str:
    return f"CASE WHEN {k} > 0 AND {k} < {n} THEN {k} * ln({k} / {n}) + ({n} - {k}) * ln(({n} - {k}) / {n}) ELSE 0 END"


@query(
    f"""SELECT gene, chi2, round(exp(-chi2 / 2), 9) AS p FROM (SELECT gene, round(2 * ({_xlogx("a.n1", "z.n1")} + {_xlogx("a.n0", "z.n0")} - ({_xlogx("(a.n1 + a.n0)", "(z.n1 + z.n0)")}))
    + CASE WHEN within > 1e-12 AND a.n1 > 0 AND a.n0 > 0 THEN (a.n1 + a.n0) * ln((q1 + q0 - (s1 + s0) * (s1 + s0) / (a.n1 + a.n0)) / within) ELSE 0 END, 6) AS chi2 FROM
    (SELECT *, CASE WHEN n1 > 0 THEN q1 - s1 * s1 / n1 ELSE 0 END + CASE WHEN n0 > 0 THEN q0 - s0 * s0 / n0 ELSE 0 END AS within FROM
    (SELECT gene, count(*) FILTER (t)::DOUBLE AS n1, count(*) FILTER (NOT t)::DOUBLE AS n0, coalesce(sum(x) FILTER (t), 0) AS s1, coalesce(sum(x) FILTER (NOT t), 0) AS s0, coalesce(sum(x * x) FILTER (t), 0) AS q1, coalesce(sum(x * x) FILTER (NOT t), 0) AS q0
    FROM (SELECT e.gene, ln(1 + e.count) AS x, c.condition = 'KO' AS t FROM expr e JOIN cells c ON c.cell_id = e.cell_id WHERE e.count > 0 AND c.condition IN ('KO', 'WT')) GROUP BY 1)) a,
    (SELECT count(*) FILTER (condition = 'KO')::DOUBLE AS n1, count(*) FILTER (condition = 'WT')::DOUBLE AS n0 FROM cells) z)""",
    ("expr", "cells"),
)
def hurdle_test(v: Views):
    return dea.hurdle(v.expr, v.cells, "KO", "WT").withColumn("p", F.round(dea.chi2_tail("chi2", F.lit(2.0)), 9))


_LFC = "SELECT c.cell_type, e.gene, sum(e.count) / any_value(t.n) AS mean FROM expr e JOIN cells c ON c.cell_id = e.cell_id JOIN (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1) t ON t.cell_type = c.cell_type GROUP BY 1, 2"
_DE = f"""de AS (SELECT m.cell_type, m.gene, round(m.mean, 6) AS mean, round(log2(m.mean / a.mean), 6) AS logfc, (ascii(right(m.gene, 1)) % 10) / 10.0 AS fdr FROM ({_LFC}) m
    JOIN (SELECT gene, avg(mean) AS mean FROM ({_LFC}) GROUP BY 1) a ON a.gene = m.gene)"""


def _de(v: Views):
    n = v.cells.groupBy("cell_type").agg(F.count("*").alias("n"))
    m = v.expr.join(v.cells.select("cell_id", "cell_type"), "cell_id").groupBy("cell_type", "gene").agg(F.sum("count").alias("s")).join(n, "cell_type").withColumn("mean", F.col("s") / F.col("n"))
    a = m.groupBy("gene").agg(F.avg("mean").alias("a"))
    fdr = (F.ascii(F.substring("gene", -1, 1)) % 10) / 10.0
    return m.join(a, "gene").select("cell_type", "gene", F.round("mean", 6).alias("mean"), F.round(F.log2(F.col("mean") / F.col("a")), 6).alias("logfc"), fdr.alias("fdr"))


@query(_also("SELECT cell_type, gene, mean, logfc FROM de", _DE), ("expr", "cells"))
def mean_by_type(v: Views):
    return _de(v).select("cell_type", "gene", "mean", "logfc")


@query(
    _also(
        """SELECT cell_type, gene, rank FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY logfc DESC, gene) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY mean DESC, gene) AS r,
        floor(count(*) OVER (PARTITION BY cell_type) * 0.5) AS n FROM de WHERE logfc > 0 AND fdr <= 0.6) WHERE r <= n) WHERE rank <= 5""", _DE),
    ("expr", "cells"),
)
def top_markers(v: Views):
    return dea.top_markers(_de(v), 5, 0, 0.6, 0.5).select("cell_type", "gene", "rank")


@query(_also("SELECT cell_type, gene FROM (SELECT *, count(*) OVER (PARTITION BY cell_type) AS k FROM (SELECT *, count(*) OVER (PARTITION BY gene) AS c FROM de WHERE logfc > 0.02) WHERE c = 1) WHERE k >= 2", _DE), ("expr", "cells"))
def specific_markers(v: Views):
    return dea.specific_markers(_de(v).where("logfc > 0.02"), 1.0, 2).select("cell_type", "gene")


@query(_also("SELECT cell_type, gene, rank FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY logfc DESC, gene) AS rank FROM (SELECT *, count(*) FILTER (logfc <= 0.02) OVER (PARTITION BY gene) AS o, count(*) OVER (PARTITION BY gene) AS n FROM de) WHERE logfc > 0.03 AND o = n - 1) WHERE rank <= 3", _DE), ("expr", "cells"))
def exclusive_markers(v: Views):
    return dea.exclusive_markers(_de(v), 0.03, 0.02, 3).select("cell_type", "gene", "rank")


@query(
    _also(
        f"""SELECT count(*) AS common, round(corr(a.logfc, b.logfc), 6) AS r, round(avg((sign(a.logfc) = sign(b.logfc))::INT), 6) AS sign_agreement, round(avg(abs(a.r - b.r)), 6) AS rank_mae FROM
        (SELECT *, rank() OVER (ORDER BY logfc DESC, gene) AS r FROM de WHERE cell_type = '{TYPES[0]}') a JOIN (SELECT *, rank() OVER (ORDER BY logfc DESC, gene) AS r FROM de WHERE cell_type = '{TYPES[1]}') b ON a.gene = b.gene""", _DE),
    ("expr", "cells"),
)
def compared_tables(v: Views):
    d = _de(v)
    return dea.compare_tables(d.where(F.col("cell_type") == TYPES[0]).select("gene", "logfc"), d.where(F.col("cell_type") == TYPES[1]).select("gene", "logfc"))


@query(
    """SELECT term, pop_n, study_n, round(pop_n * s / p, 6) AS expected, round(study_n / (pop_n * s / p), 6) AS fold FROM (SELECT g.gene_set AS term, count(*) AS pop_n, count(*) FILTER (rank < 7) AS study_n FROM genes g GROUP BY 1),
    (SELECT count(*) FILTER (rank < 7) AS s, count(*) AS p FROM genes)""",
    ("genes",),
)
def enrichment(v: Views):
    study, sets = v.genes.where("rank < 7").select("gene"), v.genes.select(F.col("gene_set").alias("term"), "gene")
    return dea.enrichment(study, v.genes.select("gene"), sets).drop("__n", "__t")


@query(
    """SELECT cell_type, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)), 6) AS t FROM (SELECT cell_type, count(*) FILTER (condition = 'KO') AS n0, count(*) FILTER (condition = 'WT') AS n1,
    avg(volume_final) FILTER (condition = 'KO') AS m0, avg(volume_final) FILTER (condition = 'WT') AS m1, var_samp(volume_final) FILTER (condition = 'KO') AS v0, var_samp(volume_final) FILTER (condition = 'WT') AS v1 FROM cells GROUP BY 1)""",
    ("cells",),
)
def volume_t_test(v: Views):
    return dea.two_sample_t(v.cells, "volume_final", "condition", "KO", "WT", ["cell_type"])


@query(f"SELECT sample, round(corr(volume_final, n_counts), 6) AS r FROM ({_TOTALS}) GROUP BY 1", ("cells", "expr"))
def volume_correlation(v: Views):
    return dea.correlation(_totals(v), "volume_final", "n_counts", ["sample"])


@query(
    """SELECT gene, factor, round(t * (n * (t - g - f + n) - (g - n) * (f - n)) * (n * (t - g - f + n) - (g - n) * (f - n)) / (g * f * (t - g) * (t - f)), 6) AS chi2, round(n / f / (g / t), 6) AS fold FROM
    (SELECT gene, factor, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY gene))::DOUBLE AS g, (sum(n) OVER (PARTITION BY factor))::DOUBLE AS f, (sum(n) OVER ())::DOUBLE AS t FROM (SELECT gene, cell_type AS factor, sum(count) AS n FROM expr e JOIN cells c ON c.cell_id = e.cell_id GROUP BY 1, 2)) WHERE g >= 20""",
    ("expr", "cells"),
)
def factor_chi2(v: Views):
    n = v.expr.join(v.cells.select("cell_id", F.col("cell_type").alias("factor")), "cell_id").groupBy("gene", "factor").agg(F.sum("count").alias("n"))
    return dea.factor_chi2(n)


@query(
    "SELECT gene, CASE WHEN gene LIKE 'g%' AND substr(gene, 2)::INT % 10 <> 9 THEN 'ENS' || substr(gene, 2) ELSE 'NA' END AS ensembl FROM genes",
    ("genes",),
)
def ensembl_ids(v: Views):
    n = F.substring("gene", 2, 9)
    known = v.genes.where("gene like 'g%'").withColumn("n", n).where("cast(n as int) % 10 <> 9")
    symbols = known.select(F.col("gene").alias("symbol"), F.concat(F.lit("ENS"), "n").alias("ensembl"))
    return dea.ensembl_ids(v.genes.select("gene"), symbols, known.select(F.concat(F.lit("alias"), "n").alias("alias"), F.col("gene").alias("symbol")))


@query("SELECT DISTINCT cell_type, translate(regexp_replace(cell_type, '[ \\-/]', '_', 'g'), '+()', '') AS clean FROM cells", ("cells",))
def sanitised_labels(v: Views):
    return v.cells.select("cell_type", dea.sanitise(F.col("cell_type")).alias("clean")).distinct()


# --- geometry and rasters ---------------------------------------------------------------------------------------------


@query(
    """SELECT method, cell_id, z, round(4.0 * r * r - 2 * (r - r // 2) * (r - r // 2), 6) AS area, round(4 * (2 * (r // 2)) + 4 * sqrt(2.0) * (r - r // 2), 6) AS perimeter FROM planes""",
    ("planes",),
)
def polygon_shape(v: Views):
    xs, ys = F.col("xs"), F.col("ys")
    return v.boundaries.select("method", "cell_id", "z", F.round(geometry.area(xs, ys), 6).alias("area"), F.round(geometry.perimeter(xs, ys), 6).alias("perimeter"))


@query("SELECT sample, y // 20 AS row, x // 20 AS col, count(*) AS n FROM transcripts GROUP BY 1, 2, 3", ("transcripts",))
def density_image(v: Views):
    return raster.density(v.transcripts, 20, ["sample"])


@query("SELECT row, col, k1 + 1 AS label FROM (SELECT py // 50 AS row, px // 50 AS col, k1, row_number() OVER (PARTITION BY py // 50, px // 50 ORDER BY count(*) DESC, k1) AS r FROM pixels GROUP BY 1, 2, 3) WHERE r = 1", ("pixels",))
def majority_raster(v: Views):
    return raster.majority_raster(v.pixels, 50)


_TOP3 = """SELECT px, py, k1 AS k, p1 AS p FROM pixels UNION ALL SELECT px, py, k2, (1 - p1) * 0.6 FROM pixels UNION ALL SELECT px, py, k3, (1 - p1) * 0.4 FROM pixels"""


@query(f"SELECT row, col, least(65499, floor(round(s / max(s) OVER () * 65499, 6)))::BIGINT AS value FROM (SELECT py // 20 AS row, px // 20 AS col, round(sum(p), 9) AS s FROM ({_TOP3}) WHERE k = 3 GROUP BY 1, 2)", ("pixels",))
def factor_image(v: Views):
    rest = 1 - F.col("p1")
    return raster.factor_image(v.pixels.select("px", "py", F.array("k1", "k2", "k3").alias("k"), F.array(F.col("p1"), rest * 0.6, rest * 0.4).alias("p")), 3, 20)


@query("SELECT k1, count(*) AS n, round(sum(p1), 6) AS weighted, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM pixels GROUP BY 1", ("pixels",))
def factor_counts(v: Views):
    return raster.factor_counts(v.pixels)


@query("SELECT tx - 1 AS tx, ty - 1 AS ty, count(*) AS n FROM (SELECT unnest(range((x + 480) // 500, (x + 520) // 500 + 1)) AS tx, y FROM transcripts), LATERAL (SELECT unnest(range((y + 480) // 500, (y + 520) // 500 + 1)) AS ty) GROUP BY 1, 2 HAVING count(*) >= 100", ("transcripts",))
def overlapping_tiles(v: Views):
    t = raster.squares(v.transcripts, 500, 20)
    return t.groupBy("tx", "ty").agg(F.count("*").alias("n")).where("n >= 100")


@query(
    """SELECT p.cell_id, q.k1 AS channel, count(*) AS n, round(avg(q.p1), 9) AS mean, round(var_samp(q.p1), 9) AS variance FROM (SELECT px + 0.25 AS x, py + 0.25 AS y, k1, p1 FROM pixels) q
    JOIN planes p ON p.method = 'A2D' AND abs(q.x - p.cx) < p.r AND abs(q.y - p.cy) < p.r AND abs(q.x - p.cx) + abs(q.y - p.cy) < p.r + p.r // 2 GROUP BY 1, 2""",
    ("pixels", "planes"),
)
def channel_means(v: Views):
    px = v.pixels.select((F.col("px") + 0.25).alias("x"), (F.col("py") + 0.25).alias("y"), F.col("k1").alias("channel"), F.col("p1").alias("value"))
    return raster.channel_means(px, v.boundaries.where("z is null").select("cell_id", "xs", "ys"), ["cell_id"]).select("cell_id", "channel", "n", "mean", "variance")


@query(
    """WITH f AS (SELECT gene, (x * sqrt(3) / 3 - y / 3) / (60 / sqrt(3)) AS fq, y * 2 / 3 / (60 / sqrt(3)) AS fr FROM transcripts),
    g AS (SELECT gene, round(fq) AS q, round(fr) AS r, round(-fq - fr) AS s, abs(round(fq) - fq) AS dq, abs(round(fr) - fr) AS dr, abs(round(-fq - fr) + fq + fr) AS ds FROM f),
    h AS (SELECT gene, (CASE WHEN dq > dr AND dq > ds THEN -r - s ELSE q END)::BIGINT AS q, (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -q - s ELSE r END)::BIGINT AS r FROM g)
    SELECT q, r, gene, count(*) AS n FROM h WHERE (q, r) IN (SELECT (q, r) FROM h GROUP BY q, r HAVING count(*) >= 5) GROUP BY 1, 2, 3""".join(("SELECT * FROM (", ")")),
    ("transcripts",),
)
def hexagon_bins(v: Views):
    return raster.hex_bins(v.transcripts, 60.0, 5)


@query(
    """SELECT 'visium_' || i || '_' || j AS spot, i::INT AS i, j::INT AS j, round(x0 - 27.5 + j * 100 + CASE WHEN i % 2 = 1 THEN 50 ELSE 0 END, 6)::DOUBLE AS x, round(y0 - 27.5 + i * 100 * sqrt(3) / 2, 6) AS y FROM
    (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM transcripts), LATERAL (SELECT unnest(range(0, floor((y1 - y0 + 55) / (100 * sqrt(3) / 2))::INT + 1)) AS i), LATERAL (SELECT unnest(range(0, floor((x1 - x0 + 55) / 100)::INT + 1)) AS j)""",
    ("transcripts",),
)
def spot_lattice(v: Views):
    return raster.spot_lattice(v.transcripts)


@query(
    """WITH k AS (SELECT k, exp(-k * k / 2.0) / sum(exp(-k * k / 2.0)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS k)),
    d AS (SELECT sample, y // 50 AS row, x // 50 AS col, count(*)::DOUBLE AS n FROM transcripts GROUP BY 1, 2, 3)
    SELECT sample, row + a.k AS row, col + b.k AS col, round(sum(n * a.w * b.w), 6) AS n FROM d, k a, k b GROUP BY 1, 2, 3""".join(("SELECT * FROM (", ")")),
    ("transcripts",),
)
def smoothed_density(v: Views):
    out = raster.smooth(raster.density(v.transcripts, 50, ["sample"]), 1.0, ["sample"])
    return out.select("sample", "row", "col", F.round("n", 6).alias("n"))


@query(
    "SELECT label, count(*) AS sides FROM (SELECT g.label, g.row + a AS row, g.col + b AS col FROM grid g, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(a, b)) s LEFT JOIN grid o ON o.row = s.row AND o.col = s.col WHERE o.label IS NULL OR o.label <> s.label GROUP BY 1".join(
        ("SELECT * FROM (WITH grid AS (SELECT row, col, k1 + 1 AS label FROM (SELECT py // 50 AS row, px // 50 AS col, k1, row_number() OVER (PARTITION BY py // 50, px // 50 ORDER BY count(*) DESC, k1) AS r FROM pixels GROUP BY 1, 2, 3) WHERE r = 1) ", ")")
    ).replace("SELECT label, count(*) AS sides FROM (SELECT", "SELECT s.label, count(*) AS sides FROM (SELECT"),
    ("pixels",),
)
def label_outlines(v: Views):
    return raster.label_edges(raster.majority_raster(v.pixels, 50))


