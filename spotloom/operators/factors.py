"""Factors of pixels and transcripts, and scores of factors against cell types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gene_shares(df: DataFrame, factor: str) -> DataFrame:
    """gene, factor, n, of_factor (share of the factor's transcripts), of_gene (share of the gene's)."""
    c = df.groupBy("gene", factor).agg(F.count("*").alias("n"))
    by = lambda k: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(k)), 6)
    return c.withColumns({"of_factor": by(factor), "of_gene": by("gene")})


def log_ratio(shares: DataFrame, factor: str, least: float = 0.0) -> DataFrame:
    """gene, factor, log2 ratio of a gene's share in the factor and in all others."""
    f, g, t = Window.partitionBy(factor), Window.partitionBy("gene"), Window.partitionBy()
    s = shares.withColumns({"f": F.sum("n").over(f), "g": F.sum("n").over(g), "t": F.sum("n").over(t)})
    rest = (F.col("g") - F.col("n")) / (F.col("t") - F.col("f"))
    out = s.where(rest > 0).select("gene", factor, F.round(F.log2(F.col("n") / F.col("f") / rest), 6).alias("ratio"))
    return out.where(F.col("ratio") > least)


def marker_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """a.name, b.name, n: genes that two families of sets(name, gene) share; pairs without any are absent."""
    return a.withColumnRenamed("name", "name_a").distinct().join(b.withColumnRenamed("name", "name_b").distinct(), "gene").groupBy("name_a", "name_b").agg(F.count("*").alias("n"))


def coverage_f1(area: DataFrame, totals: DataFrame) -> DataFrame:
    """cell_type, factor, f1 of area(cell_type, factor, area) and totals(factor, total), pooled over samples.

    TP: covered by the type; FP: covered by others; FN: the rest of the factor.
    """
    a = area.groupBy("cell_type", "factor").agg(F.sum("area").alias("tp"))
    a = a.withColumn("every", F.sum("tp").over(Window.partitionBy("factor"))).join(totals.groupBy("factor").agg(F.sum("total").alias("total")), "factor")
    fp = F.col("every") - F.col("tp")
    fn = F.col("total") - F.col("every")
    return a.select("cell_type", "factor", F.round(2 * F.col("tp") / (2 * F.col("tp") + fp + fn), 6).alias("f1"))


def threshold_f1(values: DataFrame, allowed: DataFrame, least: float) -> DataFrame:
    """factor, f1 of `value >= least` as a test for the allowed(factor, cell_type) types; null factor: pooled."""
    hit = F.col("value") >= least
    own = values.join(F.broadcast(allowed.withColumn("own", F.lit(True))), ["factor", "cell_type"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    n = lambda c: F.sum(c.cast("long"))
    g = own.rollup("factor").agg(n(hit & F.col("own")).alias("tp"), n(hit & ~F.col("own")).alias("fp"), n(~hit & F.col("own")).alias("fn"))
    return g.select("factor", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def distribution(df: DataFrame, by: str, label: str) -> DataFrame:
    """by, label, n, pct of a method's cells."""
    c = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def summed_once(df: DataFrame, once: list[str], by: list[str], value: str) -> DataFrame:
    """The first value of each `once` group, summed over `by`: values repeated for each row are not counted twice."""
    return df.groupBy(*once).agg(F.min(value).alias(value)).groupBy(*by).agg(F.round(F.sum(value), 6).alias(value))


def allowed_f1(area: DataFrame, totals: DataFrame, allowed: DataFrame) -> DataFrame:
    """factor, f1 of area(cell_type, factor, area) and totals(factor, total), with the types allowed(factor, cell_type).

    TP: covered by allowed types; FP: by others; FN: the rest of the factor. Two rows more: macro (mean over factors) and
    micro (pooled).
    """
    own = area.join(F.broadcast(allowed.select("factor", "cell_type", F.lit(True).alias("own")).distinct()), ["factor", "cell_type"], "left")  # types by factors
    s = own.groupBy("factor").agg(F.sum(F.when(F.col("own"), F.col("area")).otherwise(0.0)).alias("tp"), F.sum("area").alias("every"))
    s = s.join(allowed.select("factor").distinct(), "factor", "left_semi").join(totals.groupBy("factor").agg(F.sum("total").alias("total")), "factor")
    s = s.select(F.col("factor").cast("string").alias("factor"), "tp", (F.col("every") - F.col("tp")).alias("fp"), (F.col("total") - F.col("every")).alias("fn"))
    f1 = lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn)
    each = s.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = each.agg(F.avg("f1").alias("f1")).select(F.lit("macro").alias("factor"), "f1")
    micro = s.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("micro").alias("factor"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    return each.select("factor", "f1").unionByName(macro).unionByName(micro).select("factor", F.round("f1", 6).alias("f1"))


def lineage_ratios(cells: DataFrame, lineages: dict[str, list[str]], by: str = "method", label: str = "cell_type") -> DataFrame:
    """by, n, and of each lineage its number and percentage of a group's cells."""
    counts = {k: F.count(F.when(F.col(label).isin(*v), 1)) for k, v in lineages.items()}
    out = cells.groupBy(by).agg(F.count("*").alias("n"), *[c.alias(f"n_{k}") for k, c in counts.items()])
    return out.withColumns({f"pct_{k}": F.round(100.0 * F.col(f"n_{k}") / F.col("n"), 6) for k in lineages})
