"""Cell types from mapping results, marker scores and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mad_outliers(df: DataFrame, value: str, group: str, k: float, label: str, undefined: str = "Undefined") -> DataFrame:
    """Labels of rows below median - k * MAD (unscaled) of their group become `undefined`; a null group is left alone."""
    middle = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.median(value).alias("__m"))
    with_m = df.join(middle, F.col(group) == F.col("__g"), "left")
    spread = with_m.groupBy(F.col("__g").alias("__h")).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("__d"))
    out = with_m.join(spread, F.col("__g") == F.col("__h"), "left")
    low = F.coalesce(F.col(value) < F.col("__m") - k * F.col("__d"), F.lit(False))
    return out.withColumn("is_low", low).withColumn(label, F.when(low, F.lit(undefined)).otherwise(F.col(label))).drop("__g", "__h", "__m", "__d")


def mixed_labels(df: DataFrame, main: str, runner: str, diff: str, threshold: float = 0.5) -> DataFrame:
    """is_mixed, mixed ('Mixed' or the label), mixed_names ('a/b' or the label): close calls between different labels."""
    hit = F.coalesce((F.col(diff) < threshold) & (F.col(main) != F.col(runner)), F.lit(False))
    return df.withColumns(
        {"is_mixed": hit, "mixed": F.when(hit, F.lit("Mixed")).otherwise(F.col(main)), "mixed_names": F.when(hit, F.concat_ws("/", main, runner)).otherwise(F.col(main))}
    )


def flatten_mapping(df: DataFrame, names: Column | None = None) -> DataFrame:
    """runner_up, runner_up_probability: arrays -> first two of each (null if absent) and the lead over the first (1 if absent)."""
    p, q = F.get("runner_up_probability", F.lit(0)), F.get("runner_up_probability", F.lit(1))
    return df.withColumns(
        {
            "runner_1": F.get("runner_up", F.lit(0)),
            "runner_2": F.get("runner_up", F.lit(1)),
            "runner_1_probability": p,
            "runner_2_probability": q,
            "lead": F.coalesce(F.col("probability") - p, F.lit(1.0)),
        }
    ).drop("runner_up", "runner_up_probability")


def assign_clusters(cells: DataFrame, cluster: str, label: str, min_cells: int = 100) -> DataFrame:
    """cluster, label, share: the label that is most over-represented in a cluster.

    Counts are divided by the label's total over all clusters; labels with fewer than min_cells cells take no part; ties
    go to the first label.
    """
    counts = cells.groupBy(cluster, label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(label))
    shares = counts.withColumn("total", total).where(F.col("total") >= min_cells).withColumn("share", F.col("n") / F.col("total"))
    w = Window.partitionBy(cluster).orderBy(F.desc("share"), label)
    return shares.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(cluster, label, F.round("share", 6).alias("share"))


def label_by_score(scores: DataFrame, cells: DataFrame, threshold: float = 0.3, undefined: str = "Undefined") -> DataFrame:
    """cell_id, label: the set with the highest score from the threshold on, the first by name among equals."""
    w = Window.partitionBy("cell_id").orderBy(F.desc("score"), "gene_set")
    best = scores.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    out = cells.select("cell_id").join(best, "cell_id", "left")
    return out.select("cell_id", F.when(F.col("score") >= threshold, F.col("gene_set")).otherwise(undefined).alias("label"))


def decide(scores: DataFrame, cells: DataFrame, labels: DataFrame, high: float = 0.5, low: float = 0.25, delta: float = 0.2) -> DataFrame:
    """cluster, label, decided, reason: mean scores of a cluster against the label that it has.

    The best-scoring set replaces the label if its mean is at least `high` and more than `delta` above the label's own
    (or the label has none); if all means are below `low` the cluster is Undefined; else the label stays.
    """
    sizes = cells.groupBy("cluster").agg(F.count("*").alias("n"))
    means = scores.join(cells.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "gene_set").agg(F.sum("score").alias("s")).join(sizes, "cluster")
    means = means.select("cluster", "gene_set", (F.col("s") / F.col("n")).alias("mean"))
    w = Window.partitionBy("cluster").orderBy(F.desc("mean"), "gene_set")
    best = means.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("cluster", F.col("gene_set").alias("best"), F.col("mean").alias("best_mean"))
    own = means.select("cluster", F.col("gene_set").alias("label"), F.col("mean").alias("own_mean"))
    all_ = labels.join(best, "cluster", "left").join(own, ["cluster", "label"], "left")
    move = (F.col("best_mean") >= high) & (F.col("own_mean").isNull() | (F.col("best_mean") - F.col("own_mean") > delta)) & (F.col("best") != F.col("label"))
    reason = F.when(F.coalesce(move, F.lit(False)), "reassigned").when(F.coalesce(F.col("best_mean") < low, F.lit(True)), "undefined").otherwise("kept")
    out = all_.withColumn("reason", reason)
    return out.select("cluster", "label", F.when(F.col("reason") == "reassigned", F.col("best")).when(F.col("reason") == "undefined", "Undefined").otherwise(F.col("label")).alias("decided"), "reason")


def flatten_levels(df: DataFrame, names: DataFrame) -> DataFrame:
    """cell_id and, of each taxonomy level, a flat row: names of node and of the first two runners-up, their correlations and
    probabilities, and the leads over both.

    df has cell_id, level, assignment, avg_correlation, probability and the arrays runner_up, runner_up_correlation,
    runner_up_probability; names(level, node, name) gives nodes their names, "Unknown" where it has none. A runner-up that
    is missing is null, and its lead 1.
    """
    named = F.broadcast(names.groupBy("level").agg(F.map_from_entries(F.collect_list(F.struct("node", "name"))).alias("names")))  # a taxonomy
    at = df.join(named, "level", "left")
    name = lambda node: F.when(node.isNotNull(), F.coalesce(F.try_element_at("names", node), F.lit("Unknown")))
    out = [F.col("cell_id"), F.col("level"), name(F.col("assignment")).alias("assignment"), F.col("avg_correlation"), F.col("probability")]
    for k in (1, 2):
        p = F.get("runner_up_probability", F.lit(k - 1))
        out += [
            name(F.get("runner_up", F.lit(k - 1))).alias(f"runner_{k}"),
            F.get("runner_up_correlation", F.lit(k - 1)).alias(f"runner_{k}_correlation"),
            p.alias(f"runner_{k}_probability"),
            F.coalesce(F.col("probability") - p, F.lit(1.0)).alias(f"lead_{k}"),
        ]
    return at.select(*out)


def revised_summary(cells: DataFrame, before: list[str], after: str = "decided") -> DataFrame:
    """column, label, n, n_after: cells of each label in each of several label columns, and how many of them kept it."""
    long = cells.unpivot(["cell_id", after], before, "column", "label").where(F.col("label").isNotNull())
    return long.groupBy("column", "label").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == F.col(after), 1)).alias("n_after"))
