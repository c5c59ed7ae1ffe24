"""Cell tables: counts, low-quality and volume flags, gene filters, joins of annotations, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators.tables import keep


def cell_totals(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """cells with n_counts and n_genes; cells without any count have 0."""
    totals = expr.groupBy("cell_id").agg(F.sum("count").alias("n_counts"), F.count("*").alias("n_genes"))
    zero = F.lit(0).cast("long")
    return cells.join(totals, "cell_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_counts", "n_genes")})


def require_integer_counts(expr: DataFrame, column: str = "count") -> DataFrame:
    """expr as it is; raises when a count is not a whole number."""
    bad = expr.where(F.col(column) % 1 != 0).limit(1).count()
    if bad:
        raise ValueError(f"{column} holds values that are not whole numbers")
    return expr


def low_quality(min_counts: int = 25, min_genes: int = 5) -> Column:
    return (F.col("n_counts") < min_counts) | (F.col("n_genes") < min_genes)


def quality_flags(cells: DataFrame, min_counts: int = 25, min_genes: int = 5, min_volume: float = 10, factor: float = 3, volume: str = "volume_final") -> DataFrame:
    """cells with is_low_quality and volume_outlier: below min_volume, or above factor times the median of good cells."""
    flagged = cells.withColumn("is_low_quality", low_quality(min_counts, min_genes))
    middle = flagged.where(~F.col("is_low_quality")).agg(F.median(volume).alias("__m")).head()["__m"]
    high = F.col(volume) > F.lit(middle) * factor if middle is not None else F.lit(False)
    return flagged.withColumn("volume_outlier", (F.col(volume) < min_volume) | high)


def outlier_percentage(cells: DataFrame, by: str, min_counts: int = 25, min_genes: int = 5) -> DataFrame:
    return cells.groupBy(by).agg(F.round(F.avg(low_quality(min_counts, min_genes).cast("double")) * 100, 1).alias("pct_low"))


def keep_genes(expr: DataFrame, min_cells: int = 10) -> DataFrame:
    """Rows of genes detected in at least min_cells cells.

    expr is written once, so that a task holds the groups of a table still to be computed or those of its cells, not both.
    """
    expr = keep(expr, "expr")
    enough = expr.where("count > 0").groupBy("gene").agg(F.count_distinct("cell_id").alias("n")).where(F.col("n") >= min_cells)
    return expr.join(enough, "gene", "left_semi")


def drop_controls(df: DataFrame, prefix: str = "Blank", pattern: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """Without control probes: by prefix, by case-insensitive pattern, by name."""
    out = df.where(~F.col("gene").startswith(prefix))
    if pattern:
        out = out.where(~F.col("gene").rlike(f"(?i){pattern}"))
    return out.where(~F.col("gene").isin(*names)) if names else out


def attach(cells: DataFrame, annotations: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Left join by key as text; columns that exist already are replaced, missing values get their default."""
    new = [c for c in annotations.columns if c != key]
    right = annotations.select(F.col(key).cast("string").alias("__k"), *new)
    out = cells.drop(*new).join(right, F.col(key).cast("string") == F.col("__k"), "left").drop("__k")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def attach_strict(cells: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Inner join by key; raises when a cell has no values."""
    if cells.join(values, key, "left_anti").limit(1).count():
        raise ValueError("some cells have no values")
    return cells.join(values, key)


def unique_names(df: DataFrame, name: str, order: list[str], within: list[str] | None = None, sep: str = ".") -> DataFrame:
    """Names made unique: the second gets .1, the third .2, in the given order."""
    w = Window.partitionBy(*(within or []), name).orderBy(*order)
    n = F.row_number().over(w) - 1
    return df.withColumn(name, F.when(n > 0, F.concat(F.col(name), F.lit(sep), n.cast("string"))).otherwise(F.col(name)))


def subsample(df: DataFrame, by: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows for each group, the first by a digest of the key."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def clip_high(df: DataFrame, column: str, by: list[str], q: float = 0.99) -> DataFrame:
    """Rows up to the q-quantile of their group."""
    top = df.groupBy(*by).agg(F.percentile(column, q).alias("__top"))
    return df.join(top, by).where(F.col(column) <= F.col("__top")).drop("__top")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (1..bins), n: equal widths from the least to the greatest value."""
    low, high = df.agg(F.min(column), F.max(column)).head()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin long, n long")
    wide = (float(high) - float(low)) or 1.0
    at = F.least(F.floor((F.col(column) - float(low)) * bins / wide) + 1, F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def top_expressed(expr: DataFrame, cells: DataFrame, n: int = 20) -> DataFrame:
    """sample, gene, mean_pct, rank: genes by their mean share of a cell's counts, cells without the gene included."""
    share = expr.withColumn("pct", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("cell_id")))
    sizes = expr.select("cell_id").distinct().join(cells.select("cell_id", "sample"), "cell_id").groupBy("sample").agg(F.count("*").alias("n"))
    mean = share.join(cells.select("cell_id", "sample"), "cell_id").groupBy("sample", "gene").agg(F.sum("pct").alias("s")).join(sizes, "sample")
    mean = mean.select("sample", "gene", F.round(F.col("s") / F.col("n"), 6).alias("mean_pct"))
    w = Window.partitionBy("sample").orderBy(F.desc("mean_pct"), "gene")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def crosstab(df: DataFrame, rows: list[str], column: str) -> DataFrame:
    """Counts of each pair with margins (null for all) and the share of the row's total in %."""
    counts = df.cube(*rows, column).agg(F.count("*").alias("n"), F.grouping(column).alias("__all"), *[F.grouping(r).alias(f"__{r}") for r in rows])
    whole = counts.where("__all = 1").select(*[F.col(r).alias(f"w_{r}") for r in rows], *[F.col(f"__{r}").alias(f"wg_{r}") for r in rows], F.col("n").alias("total"))
    same = F.lit(True)
    for r in rows:
        same = same & F.col(r).eqNullSafe(F.col(f"w_{r}")) & (F.col(f"__{r}") == F.col(f"wg_{r}"))
    return counts.join(whole, same).select(*rows, column, "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


def samples_per_condition(cells: DataFrame) -> DataFrame:
    return cells.groupBy("condition").agg(F.count_distinct("sample").alias("n_samples"), F.array_join(F.sort_array(F.collect_set("sample")), ",").alias("samples"))


def group_columns(cells: DataFrame, by: list[str], volume: str = "volume_final") -> DataFrame:
    """cells with n_cells_sum, volume_mean and volume_sum of their group."""
    w = Window.partitionBy(*by)
    return cells.withColumns({"n_cells_sum": F.count("*").over(w), "volume_mean": F.avg(volume).over(w), "volume_sum": F.sum(volume).over(w)})


def counts_by_sample(transcripts: DataFrame, samples: list[str]) -> DataFrame:
    """gene, one column of counts for each of the samples (0 where none), total over all transcripts of the gene."""
    each = [F.count(F.when(F.col("sample") == s, 1)).alias(s) for s in samples]
    return transcripts.groupBy("gene").agg(*each, F.count("*").alias("total"))


def refilter(cells: DataFrame, min_counts: int = 20, min_genes: int = 5, overrides: dict[str, int] | None = None) -> DataFrame:
    """cells(method, n_counts, n_genes) with enough counts and genes; overrides: other least counts by method prefix."""
    least = F.lit(min_counts)
    for prefix, k in (overrides or {}).items():
        least = F.when(F.coalesce("method", F.lit("")).startswith(prefix), F.lit(k)).otherwise(least)
    return cells.where((F.col("n_counts") >= least) & (F.col("n_genes") >= min_genes))


def with_boundaries(cells: DataFrame, boundaries: DataFrame, min_counts: int = 10, most_missing: float = 0.05, key: str = "cell_id") -> DataFrame:
    """cells(key, n_counts, ...) that have a boundary; an error if more than most_missing of those with enough counts have none."""
    known = boundaries.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    seen = cells.where(F.col("n_counts") >= min_counts).join(known, F.col(key) == F.col("__k"), "left").agg(F.count("*").alias("n"), F.count("__k").alias("k")).head()
    if seen["n"] and (seen["n"] - seen["k"]) / seen["n"] > most_missing:
        raise ValueError(f"{seen['n'] - seen['k']} of {seen['n']} cells with {min_counts} counts or more have no boundary")
    return cells.join(known, F.col(key) == F.col("__k"), "left_semi")


def mapped_ids(cells: DataFrame, ids: DataFrame, key: str = "cell_id") -> DataFrame:
    """cells with the ids(key, new_id) that a map gives them; cells it does not name are left out."""
    return cells.join(ids.select(key, "new_id").distinct(), key)


def mean_area(cells: DataFrame, by: str = "method", area: str = "area", outlier: str = "is_outlier") -> DataFrame:
    """by, mean_area: rounded mean area of the cells that are not outliers (half to even)."""
    return cells.where(~F.coalesce(outlier, F.lit(False))).groupBy(by).agg(F.bround(F.avg(area), 0).alias("mean_area"))


def transcript_density(cells: DataFrame, by: str = "method", planes: int = 7) -> DataFrame:
    """by, density: mean of n_counts / (area * planes), 4 digits; cells without area take no part."""
    return cells.where("area > 0").groupBy(by).agg(F.round(F.avg(F.col("n_counts") / (F.col("area") * planes)), 4).alias("density"))


def covered_fraction(cells: DataFrame, tissue: DataFrame, keys: list[str]) -> DataFrame:
    """keys, volume, fraction: summed volume of cells by the tissue's volume(keys, tissue_volume)."""
    g = cells.groupBy(*keys).agg(F.sum("volume").alias("volume")).join(tissue, keys)
    return g.select(*keys, F.round("volume", 4).alias("volume"), F.round(F.col("volume") / F.col("tissue_volume"), 6).alias("fraction"))


def total_z_scores(transcripts: DataFrame, controls: str = "Blank") -> DataFrame:
    """gene, n, z: totals of genes that are no control probes, and their z-scores (population deviation; 0 where it is 0)."""
    totals = transcripts.where(~F.col("gene").startswith(controls)).groupBy("gene").agg(F.count("*").alias("n"))
    over = Window.partitionBy()  # one row for each gene
    mean, sd = F.avg("n").over(over), F.stddev_pop("n").over(over)
    return totals.withColumn("z", F.round(F.when(sd > 0, (F.col("n") - mean) / sd).otherwise(0.0), 6))


def order_by_median(df: DataFrame, value: str, by: str = "method") -> DataFrame:
    """by, median, rank: groups in falling order of their median, then by name."""
    g = df.groupBy(by).agg(F.median(value).alias("median"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("median"), by)))  # one row for each group


def random_fraction(df: DataFrame, fraction: float, key: list[str], seed: int = 0) -> DataFrame:
    """About a fraction of the rows, by a digest of their key: the same rows in every run."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)), 1, 8), 16, 10).cast("long")
    return df.where(digest < F.lit(int(fraction * (1 << 32))))


def distinct_pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each combination of the keys once."""
    return df.select(*keys).dropDuplicates()


def prior_pairs(counts: DataFrame, method: str = "method", value: str = "n") -> DataFrame:
    """method, prior, n_samples, r: each method with each method before it by name, and the correlation of their counts by sample."""
    a = counts.select(F.col(method).alias("method"), "sample", F.col(value).cast("double").alias("a"))
    b = counts.select(F.col(method).alias("prior"), "sample", F.col(value).cast("double").alias("b"))
    g = a.join(b, "sample").where("prior < method").groupBy("method", "prior")
    return g.agg(F.count("*").alias("n_samples"), F.round(F.corr("a", "b"), 6).alias("r"))


def mean_expression(expr: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """by, gene, mean count over a group's cells, absent rows as zeros; genes that no cell of a group has are absent."""
    n = cells.groupBy(*by).agg(F.count("*").alias("n"))
    s = expr.join(cells.select("cell_id", *by), "cell_id").groupBy(*by, "gene").agg(F.sum("count").alias("s"))
    return s.join(n, by).select(*by, "gene", F.round(F.col("s") / F.col("n"), 6).alias("mean"))
