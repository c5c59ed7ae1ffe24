"""Further registered queries: coordinate frames, volumes, intensities, mappings, result tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from spotloom.functions import geometry
from spotloom.operators import annotate, assign, dea, embed, factors, frames, graph, hoods, labels, metrics, normalize, qc, raster, shape, spatial, tiles
from spotloom.plans.catalog import _CONF, _DE, _IN, _KNN, _LEAD, _TOTALS, _also, _de, _runners
from spotloom.plans.catalog_more import _AREA, _GRID, _PERI, _grid, _scratch
from spotloom.plans.registry import Views, query
from spotloom.sources import readers

# --- coordinate frames -------------------------------------------------------------------------------------------------

_METHOD = "CASE cell_id % 3 WHEN 0 THEN 'P1_um' WHEN 1 THEN 'P2' ELSE 'A2D' END"


def _methods(v: Views):
    return v.cells.withColumn("method", F.expr(_METHOD))


@query(
    f"""SELECT cell_id, method, round(CASE WHEN method = 'P2' THEN x / 9.25 - 31.5 / 9.25 ELSE x END, 6)::DOUBLE AS um_x, round(CASE WHEN method = 'P2' THEN y / 9.25 - 12.0 / 9.25 ELSE y END, 6)::DOUBLE AS um_y,
    round(CASE WHEN method = 'P2' THEN x ELSE x * 9.25 + 31.5 END, 6)::DOUBLE AS px_x, round(CASE WHEN method = 'P2' THEN y ELSE y * 9.25 + 12.0 END, 6)::DOUBLE AS px_y FROM (SELECT *, {_METHOD} AS method FROM cells)""",
    ("cells",),
)
def coordinate_frames(v: Views):
    out = frames.both_frames(_methods(v), (9.25, 9.25), (31.5, 12.0), ["P"], ["P1_um"])
    return out.select("cell_id", "method", *[F.round(c, 6).alias(c) for c in ("um_x", "um_y", "px_x", "px_y")])


@query("SELECT round(px / 100.0 + 7, 6)::DOUBLE AS x, round(py / 100.0 + 9, 6)::DOUBLE AS y, count(*) AS n FROM pixels GROUP BY 1, 2", ("pixels",))
def pixel_coordinates(v: Views):
    return frames.decoded_um(v.pixels, 100.0, (7.0, 9.0), "px", "py").groupBy(F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).agg(F.count("*").alias("n"))


@query("SELECT method, cell_id, z, round(cx - r + 31.5 / 9.25 - 13, 6)::DOUBLE AS x0, round(cy + r + 12.0 / 9.25 - 13, 6)::DOUBLE AS y1 FROM planes", ("planes",))
def shifted_polygons(v: Views):
    s = frames.to_map_frame(v.boundaries, (9.25, 9.25), (31.5, 12.0))
    return s.select("method", "cell_id", "z", F.round(F.array_min("xs"), 6).alias("x0"), F.round(F.array_max("ys"), 6).alias("y1"))


# --- sources and sinks -------------------------------------------------------------------------------------------------


def _wkb(polygons, path: str) -> None:
    """Rings written as well-known binary, closed and with heights, as a boundary parquet."""

    def encode(batches):
        for b in batches:
            data = []
            for xs, ys in zip(b["xs"].to_pylist(), b["ys"].to_pylist(), strict=True):
                ring = [(x, y, 1.5) for x, y in zip([*xs, xs[0]], [*ys, ys[0]], strict=True)]
                one = struct.pack("<BIII", 1, 1003, 1, len(ring)) + b"".join(struct.pack("<ddd", *p) for p in ring)
                data.append(struct.pack("<BII", 1, 1006, 1) + one if len(data) % 2 else one)
            yield pa.RecordBatch.from_pydict({"ID": b["cell_id"], "EntityID": b["cell_id"], "ZIndex": b["z"], "ZLevel": b["method"], "Other": b["cell_id"], "Geometry": pa.array(data, pa.binary())})

    kinds = {f.name: f.dataType.simpleString() for f in polygons.schema.fields}
    schema = f"ID {kinds['cell_id']}, EntityID {kinds['cell_id']}, ZIndex {kinds['z']}, ZLevel string, Other {kinds['cell_id']}, Geometry binary"
    polygons.select("cell_id", "z", "method", "xs", "ys").mapInArrow(encode, schema).write.parquet(path)


@query(f"SELECT method, cell_id, z, round({_AREA}, 6) AS area FROM planes", ("planes",))
def boundary_parquet(v: Views):
    path = _scratch(v, "wkb")
    _wkb(v.boundaries, path)
    b = readers.boundary_parquet(v.spark, path)
    return b.select(F.col("ZLevel").alias("method"), F.col("EntityID").alias("cell_id"), F.col("ZIndex").alias("z"), F.round(geometry.area(F.col("xs"), F.col("ys")), 6).alias("area"))


_LEVELS = """SELECT m.cell_id::VARCHAR AS cell_id, l.level, CASE WHEN l.level = 'class' AND m.cell_id % 5 = 4 THEN 'Unknown' ELSE l.level || ' ' || (m.cell_id % 5) END AS assignment, m.avg_correlation::DOUBLE AS avg_correlation, m.probability::DOUBLE AS probability,
    CASE WHEN n_runners > 0 THEN CASE WHEN l.level = 'class' AND (m.cell_id + 1) % 5 = 4 THEN 'Unknown' ELSE l.level || ' ' || ((m.cell_id + 1) % 5) END END AS runner_1, CASE WHEN n_runners > 0 THEN ((m.cell_id + 7) % 40) / 100.0 END::DOUBLE AS runner_1_probability,
    round(CASE WHEN n_runners > 0 THEN probability - ((m.cell_id + 7) % 40) / 100.0 ELSE 1.0 END, 6)::DOUBLE AS lead_1, round(CASE WHEN n_runners > 1 THEN probability - ((m.cell_id + 14) % 40) / 100.0 ELSE 1.0 END, 6)::DOUBLE AS lead_2
    FROM mapping m, (SELECT 'class' AS level UNION ALL SELECT 'subclass') l"""


@query(_LEVELS, ("mapping",))
def mapping_levels(v: Views):
    """A mapping written as JSON, read back and flattened at every level of its taxonomy."""
    r = _runners(v).join(v.mapping.select("cell_id", "avg_correlation"), "cell_id")
    each = F.struct(
        F.concat(F.lit("T"), (F.col("cell_id") % 5).cast("string")).alias("assignment"),
        F.col("avg_correlation").cast("double").alias("avg_correlation"),
        F.col("probability").alias("bootstrapping_probability"),
        F.col("runner_up").alias("runner_up_assignment"),
        F.col("runner_up_probability").alias("runner_up_correlation"),
        F.col("runner_up_probability"),
    )
    cell = F.struct(F.col("cell_id").cast("string").alias("cell_id"), each.alias("class"), each.alias("subclass"))
    # One document (and file) for each part of the cells, each with the whole taxonomy.
    named = lambda level, k: F.map_from_arrays(F.array(*[F.lit(f"T{i}") for i in range(k)]), F.array(*[F.struct(F.lit(f"{level} {i}").alias("name")) for i in range(k)]))
    tree = F.struct(F.struct(named("class", 4).alias("class"), named("subclass", 5).alias("subclass")).alias("name_mapper"))
    docs = r.groupBy(F.floor(F.col("cell_id") / 2000).alias("part")).agg(F.collect_list(cell).alias("results"))
    path = _scratch(v, "mapping")
    docs.select("part", F.to_json(F.struct(tree.alias("taxonomy_tree"), "results")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    results, names = readers.mapping_json(v.spark, path, ["class", "subclass"])
    flat = annotate.flatten_levels(results, names.distinct())
    return flat.select("cell_id", "level", "assignment", "avg_correlation", "probability", "runner_1", "runner_1_probability", F.round("lead_1", 6).alias("lead_1"), F.round("lead_2", 6).alias("lead_2"))


@query(f"SELECT cell_id::VARCHAR AS cell_id, own AS label, lead FROM ({_LEAD})", ("mapping",))
def exported_annotations(v: Views):
    """Per-cell annotations written as CSV and read back."""
    m = annotate.flatten_mapping(_runners(v)).select("cell_id", F.concat(F.lit("T"), (F.col("cell_id") % 5).cast("string")).alias("label"), F.round("lead", 6).alias("lead"))
    path = _scratch(v, "annotations")
    labels.columns_like(m, ["cell_id", "label", "lead"]).write.option("header", True).csv(path)
    return v.spark.read.option("header", True).schema("cell_id string, label string, lead double").csv(path)


@query("SELECT gene, n, x_min, x_max, y_min, y_max FROM (SELECT gene, count(*) AS n FROM transcripts GROUP BY 1), (SELECT min(x)::DOUBLE AS x_min, max(x)::DOUBLE AS x_max, min(y)::DOUBLE AS y_min, max(y)::DOUBLE AS y_max FROM transcripts)", ("transcripts",))
def molecule_totals(v: Views):
    totals, limits = readers.molecule_totals(v.transcripts)
    return totals.crossJoin(F.broadcast(limits))  # one row


@query("SELECT sample, cell_type AS method, count(*) AS n, count(*) FILTER (cell_type IN ('1-URGENT', '2-HIGH')) AS first FROM cells GROUP BY 1, 2", ("cells",))
def written_once(v: Views):
    """Two writes of one table: the second adds only the (sample, method) that the first left out."""
    path = _scratch(v, "once")
    t = v.cells.select("sample", F.col("cell_type").alias("method"), "cell_id")
    readers.write_missing(t.where("method in ('1-URGENT', '2-HIGH')").withColumn("round", F.lit(1)), path, ["sample", "method"])
    readers.write_missing(t.withColumn("round", F.lit(2)), path, ["sample", "method"])
    return v.spark.read.parquet(path).groupBy(F.col("sample").cast("string").alias("sample"), F.col("method").cast("string").alias("method")).agg(F.count("*").alias("n"), F.count(F.when(F.col("round") == 1, 1)).alias("first"))


@query("SELECT sample, method, count(*) AS n FROM (SELECT sample, cell_type AS method FROM cells) WHERE method IN ('1-URGENT', '5-LOW') AND sample IN ('s1', 's2') GROUP BY 1, 2", ("cells",))
def picked_tables(v: Views):
    path = _scratch(v, "tables")
    v.cells.select("sample", F.col("cell_type").alias("method"), "cell_id").repartition("sample", "method").write.partitionBy("sample", "method").parquet(path)
    return readers.pick_tables(v.spark, path, ["1-URGENT", "5-LOW", "absent"], ["s1", "s2", "absent"]).groupBy(F.col("sample").cast("string").alias("sample"), F.col("method").cast("string").alias("method")).agg(F.count("*").alias("n"))


@query("SELECT sample, method, count(*) AS n FROM (SELECT sample, 'x' AS method FROM cells WHERE z < 3 UNION ALL SELECT sample, 'y' FROM cells) GROUP BY 1, 2", ("cells",))
def united_results(v: Views):
    a = v.cells.where("z < 3").select("cell_id", "sample", F.lit("x").alias("method"))
    b = v.cells.select("sample", "cell_id", F.lit("y").alias("method"), "cluster")
    return a.unionByName(b, allowMissingColumns=True).groupBy("sample", "method").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT sample, condition, slide FROM cells", ("cells",))
def sample_covariates(v: Views):
    return qc.distinct_pairs(v.cells, ["sample", "condition", "slide"])


# --- shapes and volumes ------------------------------------------------------------------------------------------------

_FLAT = f"SELECT cell_id, {_AREA} * 10.5 AS volume, 4 * pi() * {_AREA} / ({_PERI} * {_PERI}) AS sphericity FROM planes WHERE method = 'A2D'"
_DEEP = f"""SELECT cell_id, planes, CASE WHEN planes = 1 THEN area * 1.5 ELSE deep END AS volume, CASE WHEN planes = 1 THEN 2 * area + p * 1.5 ELSE p * span * 1.5 + ends END AS surface FROM
    (SELECT cell_id, count(*) AS planes, max(a) AS area, avg(p) AS p, max(z) - min(z) AS span, sum(coalesce((a + na) / 2 * (nz - z) * 1.5, 0) + CASE WHEN r1 AND z = z0 THEN a * 0.75 ELSE 0 END + CASE WHEN nz IS NULL AND z = z1 THEN a * 0.75 ELSE 0 END) AS deep,
    sum(CASE WHEN r1 THEN a ELSE 0 END + CASE WHEN nz IS NULL THEN a ELSE 0 END) AS ends FROM (SELECT cell_id, z, {_AREA} AS a, {_PERI} AS p, lead({_AREA}) OVER w AS na, lead(z) OVER w AS nz, row_number() OVER w = 1 AS r1,
    min(z) OVER () AS z0, max(z) OVER () AS z1 FROM planes WHERE method = 'B3D' WINDOW w AS (PARTITION BY cell_id ORDER BY z)) GROUP BY 1)"""
_SHAPES = f"""SELECT 'A2D' AS method, cell_id, '2D' AS dimensionality, 1::BIGINT AS planes, volume, sphericity, NULL::DOUBLE AS surface FROM ({_FLAT}) UNION ALL
    SELECT 'B3D', cell_id, '3D', planes, volume, pow(pi(), 1 / 3.0) * pow(6 * volume, 2 / 3.0) / surface, surface FROM ({_DEEP})"""


@query(f"SELECT method, cell_id, dimensionality, planes, round(volume, 6) AS volume, round(sphericity, 6) AS sphericity, round(surface, 6) AS surface FROM ({_SHAPES})", ("planes",))
def morphology(v: Views):
    return shape.morphology(v.boundaries).select("method", "cell_id", "dimensionality", "planes", *[F.round(c, 6).alias(c) for c in ("volume", "sphericity", "surface")])


@query(f"SELECT method, dimensionality, count(*) AS n FROM ({_SHAPES}) GROUP BY 1, 2", ("planes",))
def cells_by_dimension(v: Views):
    return shape.morphology(v.boundaries).groupBy("method", "dimensionality").agg(F.count("*").alias("n"))


@query(f"SELECT c.method, c.cell_id, c.n, dimensionality, round(volume, 6) AS volume, round(area, 6) AS area FROM (SELECT method, cell_id, count(*) AS n FROM planes WHERE cell_id % 3 > 0 GROUP BY 1, 2) c JOIN ({_SHAPES}) s ON s.method = c.method AND s.cell_id = c.cell_id JOIN (SELECT method, cell_id, max({_AREA}) AS area FROM planes GROUP BY 1, 2) a ON a.method = c.method AND a.cell_id = c.cell_id", ("planes",))
def dispatched_volumes(v: Views):
    cells = v.boundaries.where("cell_id % 3 > 0").groupBy("method", "cell_id").agg(F.count("*").alias("n")).withColumn("area", F.lit(-1.0))
    return shape.with_volume(cells, v.boundaries).select("method", "cell_id", "n", "dimensionality", F.round("volume", 6).alias("volume"), F.round("area", 6).alias("area"))


@query(
    f"""SELECT cell_id, planes, round(a, 6) AS area, round(a * 1.5, 6) AS volume, round(p, 6) AS perimeter, round(c, 6) AS circularity, round(1 - least(w, h) / greatest(w, h), 6) AS elongation FROM
    (SELECT cell_id, count(*) AS planes, sum({_AREA}) AS a, avg({_PERI}) AS p, avg(4 * pi() * {_AREA} / ({_PERI} * {_PERI})) AS c, max(2.0 * r) AS w, (max(z) - min(z))::DOUBLE AS h FROM planes WHERE method = 'B3D' GROUP BY 1)""",
    ("planes",),
)
def plane_sums(v: Views):
    s = shape.plane_sums(v.boundaries.where("z is not null"))
    return s.select("cell_id", "planes", *[F.round(c, 6).alias(c) for c in ("area", "volume", "perimeter", "circularity", "elongation")])


@query(f"SELECT method, cell_id, count(*) AS n FROM (SELECT DISTINCT t.gene, t.x, t.y, p.method, p.cell_id FROM (SELECT DISTINCT gene, x, y FROM transcripts) t JOIN planes p ON {_IN}) GROUP BY 1, 2", ("transcripts", "planes"))
def union_membership(v: Views):
    """Places of transcripts in the dissolved outline of each cell, whatever their plane."""
    shapes, members = spatial.alike(shape.parts(shape.dissolved_cells(v.boundaries)), ["method", "cell_id"])
    held = spatial.points_in_polygons(v.transcripts.select("gene", "x", "y").distinct(), shapes).distinct()
    return members.join(held.groupBy("__shape").agg(F.count("*").alias("n")), "__shape").select("method", "cell_id", "n")


@query("SELECT method, count(*) AS n FROM planes WHERE cell_id % 4 > 1 GROUP BY 1", ("planes",))
def repaired_polygons(v: Views):
    """Rings of which some were cut down to a line, to one place, or to nothing."""
    k = F.col("cell_id") % 4
    cut = lambda c: F.when(k == 0, F.slice(c, 1, 2)).when((k == 1) & (F.col("cell_id") % 8 == 1), F.transform(c, lambda x: F.get(c, F.lit(0)))).when(k == 1, F.lit(None)).otherwise(F.col(c))
    return shape.repaired(v.boundaries.withColumns({"xs": cut("xs"), "ys": cut("ys")})).groupBy("method").agg(F.count("*").alias("n"))


# --- intensities -------------------------------------------------------------------------------------------------------

_INSIDE = "abs(q.x - p.cx) < p.r AND abs(q.y - p.cy) < p.r AND abs(q.x - p.cx) + abs(q.y - p.cy) < p.r + p.r // 2"
_CHANNELS = f"""SELECT p.cell_id, q.k1 AS channel, avg(q.p1) AS m, var_samp(q.p1) AS s FROM (SELECT px + 0.25 AS x, py + 0.25 AS y, k1, p1 FROM pixels) q JOIN planes p ON p.method = 'A2D' AND {_INSIDE} GROUP BY 1, 2"""


def _factor_pixels(v: Views):
    return v.pixels.select((F.col("px") + 0.25).alias("x"), (F.col("py") + 0.25).alias("y"), F.col("k1").alias("channel"), F.col("p1").alias("value"))


def _flat_polygons(v: Views):
    return v.boundaries.where("z is null").select("cell_id", "xs", "ys")


@query(f"SELECT cell_id, channel, round(round(m, 9) / top, 6) AS mean, round(round(s, 9) / (top * top), 6) AS variance FROM ({_CHANNELS}), (SELECT max(round(m, 9)) AS top FROM ({_CHANNELS}))", ("pixels", "planes"))
def factor_intensities(v: Views):
    return raster.factor_intensities(_factor_pixels(v), _flat_polygons(v), ["cell_id"])


def _plane_pixels(v: Views):
    channel = F.when(F.col("x") % 4 == 1, "DAPI").otherwise("PolyT")
    return v.transcripts.select("x", "y", "z", channel.alias("channel"), (F.col("cell_id") % 256).alias("value"))


@query(
    f"""SELECT cell_id, channel, count(*) AS planes, round(avg(m), 6) AS mean FROM (SELECT p.cell_id, CASE WHEN t.x % 4 = 1 THEN 'DAPI' ELSE 'PolyT' END AS channel, t.z, avg(t.cell_id % 256) AS m
    FROM transcripts t JOIN planes p ON p.method = 'B3D' AND p.z = t.z AND {_IN} GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ("transcripts", "planes"),
)
def plane_intensities(v: Views):
    return raster.plane_intensities(_plane_pixels(v), v.boundaries.where("z is not null").select("cell_id", "z", "xs", "ys"), ["cell_id"])


@query(
    f"SELECT p.cell_id, count(*) AS n, round(avg(q.p1), 9) AS mean, round(var_samp(q.p1), 9) AS variance FROM (SELECT px + 13.25 - 1 AS x, py + 13.25 - 2 AS y, p1 FROM pixels) q JOIN planes p ON p.method = 'A2D' AND {_INSIDE} GROUP BY 1",
    ("pixels", "planes"),
)
def map_integrity(v: Views):
    """Mean and variance of a map's values in polygons that are moved to its frame."""
    moved = frames.to_map_frame(_flat_polygons(v), (2.0, 2.0), (2.0, 4.0)).select("cell_id", "xs", "ys")
    s = raster.channel_means(_factor_pixels(v).withColumn("channel", F.lit(0)), moved, ["cell_id"])
    return s.select("cell_id", "n", "mean", "variance")


@query("SELECT method, channel, count(*) AS n, round(median(value), 6) AS median, row_number() OVER (PARTITION BY channel ORDER BY round(median(value), 6) DESC, method) AS rank FROM (SELECT *, quantile_cont(value, 0.99) OVER (PARTITION BY method, channel) AS cut FROM (SELECT cell_type AS method, 'volume' AS channel, volume_final AS value FROM cells UNION ALL SELECT cell_type, 'x', x FROM cells)) WHERE value <= cut GROUP BY 1, 2", ("cells",))
def intensity_ranges(v: Views):
    c = v.cells.select(F.col("cell_type").alias("method"), F.col("volume_final").alias("volume"), F.col("x").cast("double").alias("x"))
    return raster.intensity_ranges(c, ["volume", "x"])


@query(f"SELECT sample, c.cell_type, k.channel, round(avg(round(k.m, 9)), 6) AS mean FROM ({_CHANNELS}) k JOIN cells c ON c.cell_id = k.cell_id GROUP BY 1, 2, 3", ("pixels", "planes", "cells"))
def intensity_by_type(v: Views):
    s = raster.channel_means(_factor_pixels(v), _flat_polygons(v), ["cell_id"])
    return raster.mean_of_cells(s, v.cells, ["sample", "cell_type"])


# --- cells and metrics -------------------------------------------------------------------------------------------------


@query(f"SELECT method, count(*) AS n FROM (SELECT *, {_METHOD} AS method FROM ({_TOTALS})) WHERE n_counts >= CASE WHEN starts_with(method, 'P2') THEN 40 ELSE 80 END AND n_genes >= 2 GROUP BY 1", ("cells", "expr"))
def refiltered_cells(v: Views):
    t = qc.cell_totals(_methods(v), v.expr)
    return qc.refilter(t, 80, 2, {"P2": 40}).groupBy("method").agg(F.count("*").alias("n"))


@query(f"SELECT c.cell_id, n_counts, 'm' || c.cell_id AS new_id FROM ({_TOTALS}) c JOIN (SELECT DISTINCT cell_id FROM cells WHERE cell_id % 100 <> 7) b ON b.cell_id = c.cell_id", ("cells", "expr"))
def complete_cells(v: Views):
    t = qc.cell_totals(v.cells, v.expr)
    known = v.cells.where("cell_id % 100 <> 7")
    ids = v.cells.select("cell_id", F.concat(F.lit("m"), F.col("cell_id").cast("string")).alias("new_id"))
    return qc.mapped_ids(qc.with_boundaries(t, known, 10, 0.05), ids).select("cell_id", "n_counts", "new_id")


@query("WITH n AS (SELECT method, sample, count(*) AS n FROM (SELECT cell_type AS method, sample FROM cells) GROUP BY 1, 2) SELECT a.method, b.method AS prior, count(*) AS n_samples, round(corr(a.n, b.n), 6) AS r FROM n a JOIN n b ON a.sample = b.sample AND b.method < a.method GROUP BY 1, 2".join(("SELECT * FROM (", ")")), ("cells",))
def prior_correlation(v: Views):
    return qc.prior_pairs(v.cells.groupBy(F.col("cell_type").alias("method"), "sample").agg(F.count("*").alias("n")))


@query(f"SELECT method, round_even(avg(a), 0)::DOUBLE AS mean_area FROM (SELECT method, {_AREA} AS a FROM planes WHERE cell_id % 5 > 0) GROUP BY 1", ("planes",))
def mean_area(v: Views):
    c = v.boundaries.select("method", geometry.area(F.col("xs"), F.col("ys")).alias("area"), (F.col("cell_id") % 5 == 0).alias("is_outlier"))
    return qc.mean_area(c)


@query(
    f"""SELECT method, round(avg(n / (a * 7)), 4) AS density FROM (SELECT b.method, b.cell_id, b.a, coalesce(t.n, 0) AS n FROM (SELECT method, cell_id, avg({_AREA}) AS a FROM planes GROUP BY 1, 2) b LEFT JOIN
    (SELECT p.method, p.cell_id, count(*) AS n FROM planes p JOIN transcripts t ON (p.z IS NULL OR p.z = t.z) AND {_IN} GROUP BY 1, 2) t ON t.method = b.method AND t.cell_id = b.cell_id) GROUP BY 1""",
    ("transcripts", "planes"),
)
def density_by_method(v: Views):
    n = assign.cell_by_gene(v.transcripts, v.boundaries, 0).groupBy("method", "cell_id").agg(F.sum("count").alias("n_counts"))
    areas = v.boundaries.groupBy("method", "cell_id").agg(F.avg(geometry.area(F.col("xs"), F.col("ys"))).alias("area"))
    return qc.transcript_density(areas.join(n, ["method", "cell_id"], "left").na.fill(0, ["n_counts"]))


@query("SELECT condition, count(*) AS n, count(*) FILTER (cell_type IN ('1-URGENT', '2-HIGH')) AS n_neurons, count(*) FILTER (cell_type = '5-LOW') AS n_vascular, round(100.0 * count(*) FILTER (cell_type IN ('1-URGENT', '2-HIGH')) / count(*), 6) AS pct_neurons, round(100.0 * count(*) FILTER (cell_type = '5-LOW') / count(*), 6) AS pct_vascular FROM cells GROUP BY 1", ("cells",))
def lineage_ratios(v: Views):
    return factors.lineage_ratios(v.cells, {"neurons": ["1-URGENT", "2-HIGH"], "vascular": ["5-LOW"]}, "condition")


@query("SELECT c.sample, round(sum(volume_final), 4) AS volume, round(sum(volume_final) / any_value(t), 6) AS fraction FROM cells c JOIN (SELECT sample, sum((x1 - x0) * (y1 - y0)) * 10.5 AS t FROM regions GROUP BY 1) r ON r.sample = c.sample GROUP BY 1", ("cells", "regions"))
def covered_volume(v: Views):
    tissue = v.regions.groupBy("sample").agg((F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) * 10.5).alias("tissue_volume"))
    return qc.covered_fraction(v.cells.select("sample", F.col("volume_final").alias("volume")), tissue, ["sample"])


@query("SELECT gene, n, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS z FROM (SELECT gene, count(*) AS n FROM transcripts WHERE NOT starts_with(gene, 'Blank') GROUP BY 1)", ("transcripts",))
def total_z_scores(v: Views):
    return qc.total_z_scores(v.transcripts)


@query(
    _also(
        """SELECT gene, round(max(logfc) FILTER (r = 1) / nullif(max(logfc) FILTER (r = 2), 0), 6) AS ratio, round(stddev_samp(logfc), 6) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY logfc DESC, cell_type) AS r FROM de) GROUP BY 1""", _DE),
    ("expr", "cells"),
)
def marker_ratios(v: Views):
    return dea.marker_ratios(_de(v))


@query(_also("SELECT gene AS \"Gene\", logfc AS \"log2FC\", round(pow(2, logfc), 6) AS \"FC\", fdr AS \"FDR\", 'KOvsWT' AS test FROM de WHERE fdr <= 0.5", _DE), ("expr", "cells"))
def shaped_results(v: Views):
    out = dea.shaped_results(_de(v), "KO", "WT", {"gene": "Gene", "logfc": "log2FC", "fc": "FC", "fdr": "FDR", "test": "test"}, 0.5)
    return out.withColumn("FC", F.round("FC", 6))


@query("SELECT cell_type AS method, median(volume_final) AS median, row_number() OVER (ORDER BY median(volume_final) DESC, cell_type) AS rank FROM cells GROUP BY 1", ("cells",))
def ordered_by_median(v: Views):
    return qc.order_by_median(v.cells.select(F.col("cell_type").alias("method"), "volume_final"), "volume_final")


@query("SELECT cell_id FROM cells WHERE ('0x' || left(md5('0:' || cell_id), 8))::BIGINT < floor(0.1 * 4294967296)", ("cells",))
def random_fraction(v: Views):
    return qc.random_fraction(v.cells, 0.1, ["cell_id"]).select("cell_id")


_ALLOWED = """own AS (SELECT factor, sum(CASE WHEN factor = substr(cell_type, 1, 1)::INT - 1 THEN a ELSE 0 END) AS tp, sum(a) AS every, sum(a) * 1.5 AS total FROM (SELECT cluster % 7 AS factor, cell_type, volume_final AS a FROM cells) GROUP BY 1 HAVING factor < 5)"""


@query(
    _also("SELECT factor::VARCHAR AS factor, round(2 * tp / (2 * tp + (every - tp) + (total - every)), 6) AS f1 FROM own UNION ALL SELECT 'macro', round(avg(2 * tp / (2 * tp + (every - tp) + (total - every))), 6) FROM own UNION ALL SELECT 'micro', round(2 * sum(tp) / (2 * sum(tp) + sum(every - tp) + sum(total - every)), 6) FROM own", _ALLOWED),
    ("cells",),
)
def allowed_f1(v: Views):
    a = v.cells.select((F.col("cluster") % 7).alias("factor"), "cell_type", F.col("volume_final").alias("area"))
    allowed = v.cells.select((F.substring("cell_type", 1, 1).cast("long") - 1).alias("factor"), "cell_type").distinct()
    return factors.allowed_f1(a, a.groupBy("factor").agg((F.sum("area") * 1.5).alias("total")), allowed)


@query("SELECT gene, max(CASE WHEN r = 1 THEN cell_type END) AS first_type, count(*) AS types FROM (SELECT e.gene, c.cell_type, count(*) AS n, row_number() OVER (PARTITION BY c.cell_type ORDER BY count(*) DESC, e.gene) AS r FROM expr e JOIN cells c ON c.cell_id = e.cell_id GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1", ("expr", "cells"))
def top_genes_of_factors(v: Views):
    n = factors.gene_shares(v.expr.join(v.cells.select("cell_id", "cell_type"), "cell_id"), "cell_type")
    top = dea.top_n(n, ["cell_type"], "n", "gene", 5)
    return top.groupBy("gene").agg(F.max(F.when(F.col("rank") == 1, F.col("cell_type"))).alias("first_type"), F.count("*").alias("types"))


@query("SELECT c.sample, c.cell_type, e.gene, round(sum(e.count) / any_value(t.n), 6) AS mean FROM expr e JOIN cells c ON c.cell_id = e.cell_id JOIN (SELECT sample, cell_type, count(*) AS n FROM cells GROUP BY 1, 2) t ON t.sample = c.sample AND t.cell_type = c.cell_type GROUP BY 1, 2, 3", ("expr", "cells"))
def mean_by_sample_and_type(v: Views):
    return qc.mean_expression(v.expr, v.cells, ["sample", "cell_type"])


@query(
    _also(
        "SELECT cell_id, gene, round(ln(1 + vol * 250 / (SELECT avg(s) FROM sums)), 6) AS norm FROM per",
        """good AS (SELECT c.cell_id, c.volume_final FROM cells c JOIN (SELECT cell_id, sum(count) AS n, count(*) AS g FROM expr GROUP BY 1) t ON t.cell_id = c.cell_id WHERE n >= 20 AND g >= 2),
        per AS (SELECT e.cell_id, e.gene, e.count / g.volume_final AS vol FROM expr e JOIN good g ON g.cell_id = e.cell_id WHERE g.volume_final > 0), sums AS (SELECT cell_id, sum(vol) AS s FROM per GROUP BY 1)""",
    ),
    ("expr", "cells"),
)
def annotation_input(v: Views):
    """The chain before annotation: cells that are good enough, their counts by volume without trimming, as logarithms."""
    good = qc.refilter(qc.cell_totals(v.cells.withColumn("method", F.lit("x")), v.expr), 20, 2)
    kept = v.expr.join(good.select("cell_id"), "cell_id", "left_semi")
    return normalize.volume_normalised(kept, good, trim=None).select("cell_id", "gene", F.round("norm", 6).alias("norm"))


# --- label grids -------------------------------------------------------------------------------------------------------

_REACH = "reach(r0, c0, row, col, label) AS (SELECT row, col, row, col, label FROM grid UNION SELECT r0, c0, g.row, g.col, g.label FROM reach h JOIN grid g ON g.label = h.label AND abs(g.row - h.row) + abs(g.col - h.col) = 1)"


@query(
    f"""SELECT * FROM (WITH RECURSIVE {_GRID}, {_REACH}, parts AS (SELECT row, col, label, min(r0 * 100000 + c0) AS component FROM reach GROUP BY 1, 2, 3),
    kept AS (SELECT row, col, label FROM parts WHERE component IN (SELECT component FROM parts GROUP BY 1 HAVING count(*) >= 4)),
    box AS (SELECT r AS row, c AS col FROM (SELECT unnest(range(max(row) + 1)) AS r FROM grid), (SELECT unnest(range(max(col) + 1)) AS c FROM grid)),
    empty AS (SELECT b.row, b.col, l.label FROM box b, (SELECT DISTINCT label FROM kept) l ANTI JOIN kept k ON k.row = b.row AND k.col = b.col AND k.label = l.label),
    spread(r0, c0, row, col, label) AS (SELECT row, col, row, col, label FROM empty UNION SELECT r0, c0, g.row, g.col, g.label FROM spread h JOIN empty g ON g.label = h.label AND abs(g.row - h.row) + abs(g.col - h.col) = 1),
    gaps AS (SELECT row, col, label, min(r0 * 100000 + c0) AS component FROM spread GROUP BY 1, 2, 3),
    holes AS (SELECT row, col, label FROM gaps g WHERE (SELECT count(*) FROM gaps o WHERE o.label = g.label AND o.component = g.component) < 4)
    SELECT row, col, min(label) AS label FROM (SELECT * FROM kept UNION ALL SELECT * FROM holes) GROUP BY 1, 2)""",
    ("pixels",),
)
def without_specks(v: Views):
    return tiles.without_specks(_grid(v), 4)


@query()
def split_segments(v: Views):
    """Segments of a label grid split among the cells that lie in them."""
    parts = graph.grid_components(_grid(v)).withColumn("component", F.col("component.row") * 100000 + F.col("component.col"))
    seeds = v.cells.select(F.floor(F.col("y") / 100).alias("row"), F.floor(F.col("x") / 100).alias("col"), F.col("cell_id").alias("seed"))
    return tiles.split_by_seeds(parts, seeds)


@query(
    """SELECT src, dst, rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10"""
)
def vector_neighbours(v: Views):
    """The ten nearest vectors of each cell in component space."""
    return embed.k_nearest_vectors(v.embeddings, 10)


@query(
    f"""SELECT k.src AS cell_id, e.gene, round(sqrt(pow(sum(e.count * coalesce((b.x - a.x) / nullif(sqrt(k.d2), 0), 0)), 2) + pow(sum(e.count * coalesce((b.y - a.y) / nullif(sqrt(k.d2), 0), 0)), 2)) / any_value(n.n), 6) AS gradient
    FROM ({_KNN}) k JOIN expr e ON e.cell_id = k.dst JOIN cells a ON a.cell_id = k.src JOIN cells b ON b.cell_id = k.dst JOIN (SELECT src, count(*) AS n FROM ({_KNN}) GROUP BY 1) n ON n.src = k.src GROUP BY 1, 2""",
    ("cells", "expr"),
)
def neighbour_gradients(v: Views):
    return hoods.neighbour_gradients(v.cells.select("cell_id", "sample", "x", "y"), v.expr, 10, 60.0, ["sample"])


@query(
    _also("SELECT gene, round(avg(fpr), 6) AS mean, min(fpr) AS min, max(fpr) AS max, round(stddev_samp(fpr), 6) AS sd, count(fpr) AS n FROM (SELECT cell_type, gene, round(fp / nullif(fp + tn, 0), 3) AS fpr FROM conf) GROUP BY 1", _CONF),
    ("expr", "cells"),
)
def false_positive_summary(v: Views):
    """False-positive rates of each marker over the groups, summed up."""
    s = metrics.marker_scores(metrics.marker_confusion(v.expr, v.cells, v.genes, 20)).groupBy("gene")
    return s.agg(F.round(F.avg("fpr"), 6).alias("mean"), F.min("fpr").alias("min"), F.max("fpr").alias("max"), F.round(F.stddev_samp("fpr"), 6).alias("sd"), F.count("fpr").alias("n"))
