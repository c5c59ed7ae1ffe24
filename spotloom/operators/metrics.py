"""Scores of rival segmentations: markers, co-expression, contamination, distances between distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.when(b > 0, a / b)


def marker_confusion(expr: DataFrame, cells: DataFrame, markers: DataFrame, threshold: float = 0) -> DataFrame:
    """cell_type, gene, tp, fp, fn, tn of `count > threshold` as a test for the type, for every type and marker gene."""
    sizes = cells.groupBy("cell_type").agg(F.count("*").alias("n_in"))
    total = cells.count()
    hits = expr.where(F.col("count") > threshold).join(markers.select("gene").distinct(), "gene", "left_semi").join(cells.select("cell_id", "cell_type"), "cell_id")
    by = hits.groupBy("gene", "cell_type").agg(F.count("*").alias("tp"))
    every = hits.groupBy("gene").agg(F.count("*").alias("pos"))
    types = F.array(*[F.lit(r["cell_type"]) for r in sizes.select("cell_type").orderBy("cell_type").collect()])  # a few dozen names
    full = every.withColumn("cell_type", F.explode(types)).join(by, ["gene", "cell_type"], "left").join(sizes, "cell_type")
    tp = F.coalesce("tp", F.lit(0))
    return full.select(
        "cell_type", "gene", tp.alias("tp"), (F.col("pos") - tp).alias("fp"), (F.col("n_in") - tp).alias("fn"), (F.lit(total) - F.col("n_in") - F.col("pos") + tp).alias("tn")
    )


def marker_scores(confusion: DataFrame, digits: int = 3) -> DataFrame:
    """Sensitivity, specificity, fpr, ppv, npv and f1; null where nothing to divide by."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = {
        "sensitivity": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "fpr": _ratio(fp, fp + tn),
        "ppv": _ratio(tp, tp + fp), "npv": _ratio(tn, tn + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    return confusion.select("cell_type", "gene", *[F.round(v, digits).alias(k) for k, v in out.items()])


def pattern_scores(expr: DataFrame, cells: DataFrame, patterns: list[str], threshold: float = 0, digits: int = 3) -> DataFrame:
    """pattern, cell_type, genes, tp, fp, fn, tn and their scores, pooled over all genes of the table that begin with a match of the
    pattern: each pair of a cell and such a gene counts once. A pattern without genes has no row. Patterns are few.
    """
    known = expr.select("gene").distinct()
    each = known.withColumn("pattern", F.explode(F.array(*map(F.lit, patterns)))).where(F.regexp_like("gene", F.concat(F.lit("^(?:"), "pattern", F.lit(")"))))
    genes = each.groupBy("pattern").agg(F.count("*").alias("genes"))
    sizes = cells.groupBy("cell_type").agg(F.count("*").alias("n_in"))
    hits = expr.where(F.col("count") > threshold).join(each, "gene").join(cells.select("cell_id", "cell_type"), "cell_id").groupBy("pattern", "cell_type").agg(F.count("*").alias("tp"))
    full = genes.crossJoin(F.broadcast(sizes)).join(hits, ["pattern", "cell_type"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))  # types by patterns: some hundreds
    whole = Window.partitionBy("pattern")
    pos, total = F.sum("tp").over(whole), F.sum("n_in").over(whole)
    told = full.withColumns({"pos": pos, "total": total}).select("pattern", "cell_type", "genes", "tp", (F.col("pos") - F.col("tp")).alias("fp"), (F.col("n_in") * F.col("genes") - F.col("tp")).alias("fn"), ((F.col("total") - F.col("n_in")) * F.col("genes") - F.col("pos") + F.col("tp")).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = {"sensitivity": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "fpr": _ratio(fp, fp + tn), "ppv": _ratio(tp, tp + fp), "npv": _ratio(tn, tn + fn)}
    return told.withColumns({k: F.round(v, digits) for k, v in out.items()})


def cross_f1(expr: DataFrame, cells: DataFrame, markers: DataFrame, threshold: float = 0) -> DataFrame:
    """F1, precision and recall of every type and marker, and whether the marker is the type's own."""
    c = marker_confusion(expr, cells, markers, threshold)
    own = markers.select("gene", F.col("gene_set").alias("marker_type"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    out = c.join(own, "gene").select(
        "cell_type", "marker_type", "gene", F.round(_ratio(tp, tp + fp), 6).alias("precision"), F.round(_ratio(tp, tp + fn), 6).alias("recall"), F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1")
    )
    return out.withColumn("matches", F.col("cell_type") == F.col("marker_type"))


def micro_f1(confusion: DataFrame, markers: DataFrame) -> DataFrame:
    """Pooled F1 of the matching pairs, per type and over all (null type)."""
    own = confusion.join(markers.select("gene", F.col("gene_set").alias("cell_type")), ["gene", "cell_type"])
    s = own.rollup("cell_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.select("cell_type", F.round(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def coexpression(expr: DataFrame, markers: DataFrame) -> DataFrame:
    """gene_a, gene_b, both, either, mecr: cells with both markers of different types, by cells with either.

    Every pair of markers of different types has a row, also if no cell has both; mecr is null where no cell has either.
    The self-join runs over one cell's marker genes, of which there are at most as many as markers.
    """
    sets = markers.select("gene", "gene_set").distinct()
    first = sets.select(F.col("gene").alias("gene_a"), F.col("gene_set").alias("sa"))
    second = sets.select(F.col("gene").alias("gene_b"), F.col("gene_set").alias("sb"))
    pairs = first.join(second, (F.col("gene_a") < F.col("gene_b")) & (F.col("sa") != F.col("sb"))).select("gene_a", "gene_b").distinct()  # of markers: some hundreds
    on = expr.where("count > 0").join(markers.select("gene", "gene_set"), "gene").select("cell_id", "gene", "gene_set")
    a = on.select("cell_id", F.col("gene").alias("gene_a"), F.col("gene_set").alias("sa"))
    b = on.select("cell_id", F.col("gene").alias("gene_b"), F.col("gene_set").alias("sb"))
    both = a.join(b, "cell_id").where("gene_a < gene_b and sa <> sb").groupBy("gene_a", "gene_b").agg(F.count("*").alias("both"))
    n = on.groupBy("gene").agg(F.count("*").alias("n"))
    out = pairs.join(both, ["gene_a", "gene_b"], "left")
    for side in ("a", "b"):
        out = out.join(n.select(F.col("gene").alias(f"gene_{side}"), F.col("n").alias(f"n{side}")), f"gene_{side}", "left")
    out = out.na.fill(0, ["both", "na", "nb"]).withColumn("either", F.col("na") + F.col("nb") - F.col("both"))
    return out.select("gene_a", "gene_b", "both", "either", F.round(_ratio(F.col("both"), F.col("either")), 6).alias("mecr"))


def wasserstein(expr: DataFrame, cells: DataFrame, target: str) -> DataFrame:
    """gene, distance: area between the distribution functions of a type's cells and of all others, zeros included.

    Counts are pre-aggregated by value, so the running sums go over a gene's distinct values.
    """
    n_in = cells.where(F.col("cell_type") == target).count()
    n_out = cells.count() - n_in
    values = expr.join(cells.select("cell_id", (F.col("cell_type") == target).alias("inside")), "cell_id").groupBy("gene", F.col("count").alias("v")).agg(
        F.sum(F.col("inside").cast("long")).alias("a"), F.sum((~F.col("inside")).cast("long")).alias("b")
    )
    seen = values.groupBy("gene").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    zeros = seen.select("gene", F.lit(0).cast("long").alias("v"), (F.lit(n_in) - F.col("sa")).alias("a"), (F.lit(n_out) - F.col("sb")).alias("b"))
    w = Window.partitionBy("gene").orderBy("v")
    run = values.unionByName(zeros).groupBy("gene", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.abs(F.sum("a").over(upto) / n_in - F.sum("b").over(upto) / n_out) * (F.lead("v").over(w) - F.col("v"))
    return run.withColumn("step", step).groupBy("gene").agg(F.round(F.sum("step"), 6).alias("distance"))


def calinski_harabasz(vectors: DataFrame, value: str = "embedding", label: str = "label") -> DataFrame:
    """k, n, ch: between- by within-group variance of labelled vectors, from sums per label and dimension."""
    each = vectors.where(F.col(label).isNotNull()).select(label, F.posexplode(value).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    cells = each.groupBy(label, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    dims = cells.groupBy("d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"), F.sum("n").alias("n"), F.count("*").alias("k"))
    t = dims.agg(F.sum(F.col("g") - F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("q") - F.col("g")).alias("within"), F.max("n").alias("n"), F.max("k").alias("k"))
    return t.select("k", "n", F.round((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))), 6).alias("ch"))


def combine(tables: list[DataFrame], key: str = "method") -> DataFrame:
    """Full outer join of metric tables: one row for each method, null where a metric is missing."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full")
    return out
