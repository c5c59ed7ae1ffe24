"""Views that let the star-schema test tables stand in for transcripts, cells, counts, polygons and rasters.

Each view exists as a DataFrame and as DuckDB SQL (SQL), from one set of formulas; both engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LABELS = ["CTX", "HIP", "STR", "BS", "fiber_tracts", "Meninges", "TH", "HY"]

_GENE = "CASE WHEN {g} < 4 THEN concat('Blank-', {g}) ELSE concat('g', {g}) END"
_TYPES = "CASE {k} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"

#: name -> (SQL that Spark and DuckDB both run, views it reads)
_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "transcripts": (
        f"""SELECT concat('s', o_custkey % 12) AS sample, {_GENE.format(g='(l_partkey % 100)')} AS gene,
        ((l_partkey * 37 + l_orderkey * 11) % 1000) * 2 + 1 AS x, ((l_suppkey * 53 + l_orderkey * 7) % 1000) * 2 + 1 AS y,
        l_linenumber - 1 AS z, l_orderkey AS cell_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        (),
    ),
    "cells": (
        """SELECT o_orderkey AS cell_id, concat('s', o_custkey % 12) AS sample, concat('b', o_custkey % 4) AS slide,
        CASE o_custkey % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'KO' ELSE 'AGED' END AS condition, o_orderpriority AS cell_type,
        o_orderkey % 40 AS cluster, o_totalprice / 100 AS volume_final,
        ((o_orderkey * 37 + o_custkey * 11) % 1000) * 2 + 1 AS x, ((o_orderkey * 53 + o_custkey * 7) % 1000) * 2 + 1 AS y,
        o_orderkey % 7 AS z FROM orders""",
        (),
    ),
    "expr": (
        f"""SELECT l_orderkey AS cell_id, {_GENE.format(g='(l_partkey % 100)')} AS gene,
        CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2""",
        (),
    ),
    "genes": (
        f"""SELECT DISTINCT {_GENE.format(g='(l_partkey % 100)')} AS gene, {_TYPES.format(k='(l_partkey % 100 % 5)')} AS gene_set,
        CAST(floor(l_partkey % 100 / 5) AS INT) AS rank FROM lineitem""",
        (),
    ),
    "regions": (
        "SELECT concat('s', o_custkey % 12) AS sample, i, j, CAST(i * 700 AS DOUBLE) AS x0, CAST(j * 700 AS DOUBLE) AS y0, "
        "CAST(i * 700 + 700 AS DOUBLE) AS x1, CAST(j * 700 + 700 AS DOUBLE) AS y1, CASE i * 3 + j "
        + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(LABELS))
        + " END AS label FROM (SELECT DISTINCT o_custkey % 12 AS o_custkey FROM orders) s, "
        "(SELECT DISTINCT n_nationkey % 3 AS i FROM nation) a, (SELECT DISTINCT n_nationkey % 3 AS j FROM nation) b WHERE i * 3 + j < 8",
        (),
    ),
    "octagons": (
        """SELECT s_suppkey AS cell_id, ((s_suppkey * 97) % 100) * 20 AS cx, ((s_suppkey * 61) % 100) * 20 AS cy,
        22 + 4 * (s_suppkey % 10) AS r FROM supplier""",
        (),
    ),
    "planes": (
        """SELECT 'A2D' AS method, cell_id, CAST(NULL AS INT) AS z, cx, cy, r FROM octagons UNION ALL
        SELECT 'B3D', cell_id, CAST(k AS INT), cx, cy, r - 4 * abs(k - 3) FROM octagons,
        (SELECT DISTINCT n_nationkey % 7 AS k FROM nation) p WHERE k <= cell_id % 7""",
        ("octagons",),
    ),
    "pixels": (
        """SELECT (l_partkey * 37 + l_linenumber * 101) % 2000 AS px, (l_suppkey * 53 + l_orderkey * 7) % 2000 AS py,
        l_suppkey % 21 AS k1, l_partkey % 21 AS k2, l_orderkey % 21 AS k3, (50 + l_quantity) / 100 AS p1 FROM lineitem""",
        (),
    ),
    "mapping": (
        """SELECT o_orderkey AS cell_id, o_orderpriority AS assignment, (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0 AS avg_correlation,
        (o_orderkey % 100) / 100.0 AS probability, o_orderkey % 3 AS n_runners FROM orders""",
        (),
    ),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def with_views(sql: str, *names: str) -> str:
    """sql behind a WITH of the views it names and what they read."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in _VIEWS[name][1]:
                add(x)
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({_VIEWS[n][0]})" for n in order) + " " + sql if order else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table as it is."""
    if name not in _VIEWS:
        return table(spark, sf_dir, name)
    sql = with_views(f"SELECT * FROM {name}", name)
    read = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql.replace(",", " ")}
    for t in read:
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **{t: d for t, d in read.items() if f"{{{t}}}" in sql})


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, cell_id, z, xs, ys: octagons with integer vertices, none of which has a transcript on its edge."""
    p = view(spark, sf_dir, "planes")
    h = F.floor(F.col("r") / 2)
    dx = [F.col("r"), h, -h, -F.col("r"), -F.col("r"), -h, h, F.col("r")]
    dy = [h, F.col("r"), F.col("r"), h, -h, -F.col("r"), -F.col("r"), -h]
    ring = lambda c, d: F.array(*[(F.col(c) + x).cast("double") for x in d])
    return p.select("method", "cell_id", "z", ring("cx", dx).alias("xs"), ring("cy", dy).alias("ys"))
