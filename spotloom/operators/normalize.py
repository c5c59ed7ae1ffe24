"""Normalisation of the long count table; absent rows are zeros and enter every mean and variance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def volume_normalised(expr: DataFrame, cells: DataFrame, target: float = 250, trim: tuple[float, float] | None = (1, 99), volume: str = "volume_final") -> DataFrame:
    """cell_id, gene, count, vol (count by volume), scaled (rescaled to the target) and norm (log1p of it).

    Cells whose sum of counts by volume is not strictly between the trim percentiles of those sums are left out.
    """
    per = expr.join(cells.where(F.col(volume) > 0).select("cell_id", volume), "cell_id").withColumn("vol", F.col("count") / F.col(volume))
    sums = per.groupBy("cell_id").agg(F.sum("vol").alias("vol_sum"))
    if trim:
        low, high = sums.agg(F.percentile("vol_sum", F.array(F.lit(trim[0] / 100), F.lit(trim[1] / 100))).alias("p")).head()["p"] or (0.0, 0.0)
        sums = sums.where((F.col("vol_sum") > low) & (F.col("vol_sum") < high))
    scale = sums.agg(F.avg("vol_sum").alias("m")).head()["m"] or 1.0
    out = per.join(sums, "cell_id").withColumn("scaled", F.col("vol") * F.lit(target / scale))
    return out.select("cell_id", "gene", "count", "vol", "scaled", F.log1p("scaled").alias("norm"))


def library_normalised(expr: DataFrame) -> DataFrame:
    """log1p of counts scaled to the median of cell totals."""
    w = Window.partitionBy("cell_id")
    totals = expr.groupBy("cell_id").agg(F.sum("count").alias("n"))
    middle = totals.where("n > 0").agg(F.median("n").alias("m")).head()["m"]
    return expr.withColumn("norm", F.log1p(F.col("count") / F.sum("count").over(w) * F.lit(middle)))


def gene_moments(expr: DataFrame, n_cells: int, value: str = "count") -> DataFrame:
    """gene, mean, sd (sample, zeros included; 1 where it is 0), zero_z (the z-score of an absent row)."""
    s = expr.groupBy("gene").agg(F.sum(value).cast("double").alias("s"), F.sum(F.col(value) * F.col(value)).cast("double").alias("q"))
    n = float(n_cells)
    var = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
    out = s.select("gene", (F.col("s") / n).alias("mean"), F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("sd"))
    return out.withColumn("zero_z", -F.col("mean") / F.col("sd"))


def z_scores(expr: DataFrame, n_cells: int, value: str = "count") -> DataFrame:
    return expr.join(gene_moments(expr, n_cells, value), "gene").withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd"))


def variable_genes(expr: DataFrame, n_cells: int, n_top: int = 20, bins: int = 20) -> DataFrame:
    """Genes by dispersion (variance by mean) relative to the others of their bin of means."""
    m = gene_moments(expr, n_cells).withColumn("dispersion", F.col("sd") * F.col("sd") / F.col("mean"))
    binned = m.withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "gene")))  # one row for each gene
    w = Window.partitionBy("bin")
    score = binned.withColumn("relative", F.round(F.col("dispersion") / F.avg("dispersion").over(w), 6))
    ranked = score.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relative"), "gene")))
    return ranked.where(F.col("rank") <= n_top).select("gene", "bin", "relative", "rank")


def marker_scores(expr: DataFrame, genes: DataFrame, cells: DataFrame, top: int = 25, bins: int = 25, controls: int = 50) -> DataFrame:
    """cell_id, gene_set, score: mean of a set's genes less the mean of control genes alike in mean expression.

    Controls of a set are up to `controls` genes, first by a digest of their name, of each bin of mean expression that
    holds a gene of the set; the set's own genes are left out. Cells that have none of these genes score 0 and have no row.
    """
    n_cells = cells.count()
    means = expr.groupBy("gene").agg((F.sum("count") / n_cells).alias("mean"))
    binned = means.withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "gene")))  # one row for each gene
    drawn = binned.withColumn("n", F.row_number().over(Window.partitionBy("bin").orderBy(F.md5("gene")))).where(F.col("n") <= controls)
    marks = genes.where(F.col("rank") < top).select("gene_set", "gene").join(binned, "gene")
    pool = marks.select("gene_set", "bin").distinct().join(drawn.select("gene", "bin"), "bin").join(marks.select("gene_set", "gene"), ["gene_set", "gene"], "left_anti")
    weights = marks.select("gene_set", "gene", F.lit(1).alias("side")).unionByName(pool.select("gene_set", "gene", F.lit(-1).alias("side")))
    size = F.count("*").over(Window.partitionBy("gene_set", "side"))
    weighted = weights.withColumn("w", F.col("side") / size)
    return expr.join(weighted, "gene").groupBy("cell_id", "gene_set").agg(F.round(F.sum(F.col("count") * F.col("w")), 6).alias("score"))


def contamination(expr: DataFrame, cells: DataFrame, markers: DataFrame, absolute: float = 1, z: float = 2, value: str = "count") -> DataFrame:
    """cell_id, lineage, mean_marker, zscore, contaminated of markers(lineage, gene): mean over the lineage's genes that the
    table has, zeros included, above absolute and with a population z-score above z. A lineage without such genes flags no cell.

    All lineages in one pass; lineages are few.
    """
    here = markers.select("lineage", "gene").distinct().join(expr.select("gene").distinct(), "gene")
    size = markers.select("lineage").distinct().join(here.groupBy("lineage").agg(F.count("*").alias("k")), "lineage", "left")
    per = expr.join(here, "gene").groupBy("cell_id", "lineage").agg(F.sum(value).alias("s"))
    full = cells.select("cell_id").distinct().crossJoin(F.broadcast(size)).join(per, ["cell_id", "lineage"], "left")
    full = full.select("cell_id", "lineage", F.when(F.col("k").isNotNull(), F.coalesce(F.col("s"), F.lit(0)) / F.col("k")).alias("mean_marker"))
    whole = full.groupBy("lineage").agg(F.avg("mean_marker").alias("m"), F.stddev_pop("mean_marker").alias("sd"))
    score = F.when(F.col("sd") > 0, (F.col("mean_marker") - F.col("m")) / F.col("sd"))
    out = full.join(F.broadcast(whole), "lineage").withColumn("zscore", score)
    hit = F.coalesce((F.col("mean_marker") > absolute) & (F.col("zscore") > z), F.lit(False))
    return out.select("cell_id", "lineage", "mean_marker", "zscore", hit.alias("contaminated"))


def contaminated_cells(flags: DataFrame) -> DataFrame:
    """cell_id, contaminated: in any lineage of contamination()."""
    return flags.groupBy("cell_id").agg(F.bool_or("contaminated").alias("contaminated"))
