"""Readers and writers: transcript CSV, wide matrices, GeoJSON, pixel decodes, lassos, affine maps; partitioned results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType, StringType

from spotloom.functions import geometry


def transcripts_csv(spark: SparkSession, path: str) -> DataFrame:
    """gene, x, y, z of a detected-transcripts CSV; only these columns are parsed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select("gene", *[F.col(f"global_{c}").cast("double").alias(c) for c in ("x", "y")], F.col("global_z").cast("int").alias("z"))


def wide_to_long(df: DataFrame, key: str, name: str = "gene", value: str = "count") -> DataFrame:
    """One row for each value of a wide matrix that is neither null nor, among numbers, 0."""
    long = df.unpivot([key], [c for c in df.columns if c != key], name, value)
    return long.where(F.col(value).isNotNull() if long.schema[value].dataType.typeName() == "string" else F.col(value) != 0)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """cell, layer, part, xs, ys of polygon and multi-polygon features (outer rings)."""
    shape = "type string, features array<struct<properties: struct<cell: string, layer: int>, geometry: struct<type: string, coordinates: string>>>"
    each = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    rings = each.select(F.col("f.properties.cell").alias("cell"), F.col("f.properties.layer").alias("layer"), F.posexplode(parts).alias("part", "p"))
    ring = F.get("p", F.lit(0))
    return rings.select("cell", "layer", "part", F.transform(ring, lambda v: F.get(v, F.lit(0))).alias("xs"), F.transform(ring, lambda v: F.get(v, F.lit(1))).alias("ys"))


def pixel_header(spark: SparkSession, path: str) -> dict[str, str]:
    """The key=value pairs of the lines that begin with ## (three of them)."""
    lines = spark.read.text(path).where(F.col("value").startswith("##")).limit(100).collect()
    return dict(pair.split("=", 1) for r in lines for pair in r["value"].lstrip("#").split(";") if "=" in pair)


def pixel_decode(spark: SparkSession, path: str) -> DataFrame:
    """X, Y, K1.., P1.. of a decode file as arrays k and p."""
    body = spark.read.option("sep", "\t").option("comment", "#").schema("X int, Y int, K1 int, K2 int, K3 int, P1 double, P2 double, P3 double").csv(path)
    return body.select("X", "Y", F.array("K1", "K2", "K3").alias("k"), F.array("P1", "P2", "P3").alias("p"))


def lassos(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """sample, selection, xs, ys of polygons with three points or more, in file order; lines that begin with # are comments."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    missing = {"Selection", "X", "Y"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = raw.withColumn("n", F.monotonically_increasing_id()).groupBy("Selection").agg(F.sort_array(F.collect_list(F.struct("n", F.col("X").cast("double").alias("x"), F.col("Y").cast("double").alias("y")))).alias("v"))
    return rows.where(F.size("v") >= 3).select(F.lit(sample).alias("sample"), F.col("Selection").alias("selection"), F.col("v.x").alias("xs"), F.col("v.y").alias("ys"))


def affine_matrix(spark: SparkSession, path: str) -> list[list[float]]:
    """A 3x3 matrix, one row of numbers between blanks on each line."""
    return [[float(x) for x in r["value"].split()] for r in spark.read.text(path).limit(3).collect()]


def mapped_lassos(found: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """lassos() in the frame that a 3x3 affine matrix (see affine_matrix) maps them to."""
    xs, ys = geometry.affine(F.col("xs"), F.col("ys"), matrix)
    return found.withColumns({"xs": xs, "ys": ys})


def polygons_of_cells(polygons: DataFrame, cells: DataFrame, key: str = "cell") -> DataFrame:
    """polygons (of geojson()) of the cells that a table has, with its columns."""
    return polygons.join(cells, key, "inner")


def write_tests(de: DataFrame, path: str, mode: str = "ignore") -> None:
    """Results of tests partitioned by method and test, one file each, the subset 'all' first, then by subset and gene."""
    ordered = de.withColumn("__rest", F.col("subset") != "all").repartition("method", "test").sortWithinPartitions("method", "test", "__rest", "subset", "gene").drop("__rest")
    ordered.write.mode(mode).partitionBy("method", "test").parquet(path)


def write_results(df: DataFrame, path: str, by: list[str], order: list[str], mode: str = "ignore") -> None:
    """Partitioned by `by`, rows sorted within; columns without any value are left out; what is there already stays.

    Rows are dealt by ranges that go on over `order` and the other plain columns, so that a large value of `by` is no single task.
    """
    seen = df.agg(*[F.count(c).alias(c) for c in df.columns]).head()
    keep = [c for c in df.columns if seen[c] or c in by]
    plain = [c for c in keep if c not in (*by, *order) and isinstance(df.schema[c].dataType, (BooleanType, DatetimeType, NumericType, StringType))]
    df.select(*keep).repartitionByRange(*by, *order, *plain).sortWithinPartitions(*by, *order).write.mode(mode).partitionBy(*by).parquet(path)


def export_molecules(df: DataFrame, path: str, precision: int = 2) -> None:
    """Gzip CSV of X, Y, gene, Count, sorted by X."""
    out = df.select(F.round("x", precision).alias("X"), F.round("y", precision).alias("Y"), "gene", F.lit(1).alias("Count"))
    out.orderBy("X", "Y", "gene").write.option("header", True).option("compression", "gzip").csv(path)


def boundary_parquet(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ID", "EntityID", "ZIndex", "ZLevel", "Geometry")) -> DataFrame:
    """A boundary parquet, only these columns, its well-known-binary Geometry as rings: one row for each polygon part (xs, ys,
    outer ring without the repeated last corner). Other kinds of geometry, and nulls, have no row."""
    import numpy as np
    import pyarrow as pa

    def rings(data: bytes) -> list[tuple[list[float], list[float]]]:
        def number(at: int, kind: str) -> int:
            return int(np.frombuffer(data, kind, 1, at)[0])

        def polygon(at: int) -> tuple[tuple | None, int]:
            order = "<" if data[at] == 1 else ">"
            kind = number(at + 1, f"{order}u4")
            dims = 3 if kind & 0x80000000 or 1000 < kind % 10000 < 2000 else 2
            at, outer = at + 5, None
            count, at = number(at, f"{order}u4"), at + 4
            if kind % 1000 == 6 or kind & 0xFF == 6:
                parts = []
                for _ in range(count):
                    part, at = polygon(at)
                    parts += part or []
                return parts, at
            if kind % 1000 != 3 and kind & 0xFF != 3:
                return None, len(data)
            for k in range(count):
                n, at = number(at, f"{order}u4"), at + 4
                if k == 0:
                    outer = np.frombuffer(data, f"{order}f8", n * dims, at).reshape(n, dims)
                at += 8 * n * dims
            if outer is None or not len(outer):
                return None, at
            closed = len(outer) > 1 and (outer[0, :2] == outer[-1, :2]).all()
            outer = outer[:-1] if closed else outer
            return [(outer[:, 0].tolist(), outer[:, 1].tolist())], at

        return polygon(0)[0] or []

    def decode(batches):
        for batch in batches:
            found = [rings(g) if g is not None else [] for g in batch["Geometry"].to_pylist()]
            row = pa.array([i for i, r in enumerate(found) for _ in r], pa.int64())
            each = [r for x in found for r in x]
            cols = {c: batch[c].take(row) for c in others}
            numbers = pa.array([k for x in found for k in range(len(x))], pa.int32())
            xs, ys = (pa.array([r[k] for r in each], pa.list_(pa.float64())) for k in (0, 1))
            yield pa.RecordBatch.from_pydict({**cols, "part": numbers, "xs": xs, "ys": ys})

    raw = spark.read.parquet(path).select(*columns)
    others = [c for c in columns if c != "Geometry"]
    schema = ", ".join(f"`{c}` {raw.schema[c].dataType.simpleString()}" for c in others) + ", part int, xs array<double>, ys array<double>"
    return raw.mapInArrow(decode, schema)


def mapping_json(spark: SparkSession, path: str, levels: list[str]) -> tuple[DataFrame, DataFrame]:
    """A taxonomy-mapping JSON as (results, names): cell_id, level, assignment, avg_correlation, probability and the runner-up
    arrays, one row for each cell and level; level, node, name of the taxonomy."""
    from functools import reduce

    entry = "struct<assignment: string, avg_correlation: double, bootstrapping_probability: double, runner_up_assignment: array<string>, runner_up_correlation: array<double>, runner_up_probability: array<double>>"
    cell = "cell_id: string, " + ", ".join(f"`{x}`: {entry}" for x in levels)
    mapper = ", ".join(f"`{x}`: map<string, struct<name: string>>" for x in levels)
    raw = spark.read.schema(f"taxonomy_tree struct<name_mapper: struct<{mapper}>>, results array<struct<{cell}>>").option("multiLine", True).json(path)
    each = raw.select(F.explode("results").alias("r"))
    pick = lambda x: each.where(F.col(f"r.`{x}`").isNotNull()).select(
        "r.cell_id", F.lit(x).alias("level"), *[F.col(f"r.`{x}`.{a}").alias(b) for a, b in (
            ("assignment", "assignment"), ("avg_correlation", "avg_correlation"), ("bootstrapping_probability", "probability"), ("runner_up_assignment", "runner_up"),
            ("runner_up_correlation", "runner_up_correlation"), ("runner_up_probability", "runner_up_probability"))])
    names = [raw.select(F.lit(x).alias("level"), F.explode(F.col(f"taxonomy_tree.name_mapper.`{x}`")).alias("node", "n")).select("level", "node", F.col("n.name").alias("name")) for x in levels]
    return reduce(DataFrame.unionByName, map(pick, levels)), reduce(DataFrame.unionByName, names)


def write_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append only the partitions (keys) that are not at path yet; what is there stays as it is."""
    try:
        there = df.sparkSession.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    new = df if there is None else df.join(there.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys]), keys, "left_anti")
    new.repartition(*keys).write.mode("append").partitionBy(*keys).parquet(path)


def pick_tables(spark: SparkSession, path: str, methods: list[str], samples: list[str] | None = None) -> DataFrame:
    """Rows of the wanted methods (and samples) of a table partitioned by method and sample; what is missing is left out."""
    df = spark.read.parquet(path)
    df = df.where(F.col("method").isin(*methods))
    return df if samples is None else df.where(F.col("sample").isin(*samples))


def molecule_totals(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The side tables of a molecule export: gene, n; and one row of coordinate limits."""
    limits = df.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])
    return df.groupBy("gene").agg(F.count("*").alias("n")), limits
