"""Differential expression: pseudobulk, rank-sum and hurdle tests, adjustment, markers, comparisons, enrichment.

Statistics are SQL; tail probabilities come from Arrow batches of them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# Coefficients of a published Chebyshev fit of erfc, highest power first.
_ERFC = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]


def normal_two_sided(z: Column | str) -> Column:
    """Two-sided tail probability of a normal deviate, with a relative error below 1.2e-7; null and NaN give null."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(0.0)
    for c in _ERFC:
        poly = poly * t + c
    return F.when(~F.isnan(z), t * F.exp(poly - x * x))


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a != a else _gamma_upper(k / 2, a / 2) for a, k in zip(x, df, strict=True)], dtype=float)


def _hypergeometric_tail(k: int, n: int, m: int, total: int) -> float:
    """Chance of k or more marked among n drawn of total, m of them marked."""
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return min(1.0, sum(math.exp(choose(m, i) + choose(total - m, n - i) - choose(total, n)) for i in range(k, min(n, m) + 1) if n - i <= total - m))


@F.pandas_udf(DoubleType())
def hypergeometric_tail(k: pd.Series, n: pd.Series, m: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([_hypergeometric_tail(*map(int, x)) for x in zip(k, n, m, total, strict=True)])


def pseudobulk(expr: DataFrame, cells: DataFrame, subset: str = "cell_type", min_cells: int = 15, replicates: int = 1, seed: int = 0) -> DataFrame:
    """subset, sample, rep, gene, count, n_cells: sums over samples with enough cells, for each subset and for 'all'.

    Replicates split a sample's cells by the order of a digest of their ids. The window over (subset, sample) is only
    needed for more than one replicate.
    """
    each = cells.select("cell_id", "sample", F.col(subset).alias("subset"))
    both = each.unionByName(each.withColumn("subset", F.lit("all")))
    if replicates > 1:
        w = Window.partitionBy("subset", "sample").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "cell_id")))
        both = both.withColumn("rep", F.ntile(replicates).over(w))
    else:
        both = both.withColumn("rep", F.lit(1))
    sizes = both.groupBy("subset", "sample").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    sums = expr.join(both, "cell_id").groupBy("subset", "sample", "rep", "gene").agg(F.sum("count").alias("count"))
    return sums.join(sizes, ["subset", "sample"])


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], order: list[str], out: str = "fdr") -> DataFrame:
    """Adjusted p-values within groups (a contrast's genes)."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.asc(p), *order))
    raw = df.withColumn("__raw", F.col(p) * F.count(p).over(w) / rank)
    back = w.orderBy(F.desc(p), *[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.least(F.lit(1.0), F.min("__raw").over(back))).drop("__raw")


def rank_sum(expr: DataFrame, cells: DataFrame, test: str, ref: str, group: str = "condition", value: str = "count") -> DataFrame:
    """gene, u_z, log2fc: Wilcoxon rank-sum of two groups' cells, normal approximation without correction for ties.

    Absent rows are zeros: one tied block below all stored values. Values are counted first, so the running ranks go
    over a gene's distinct values, not over cells.
    """
    sizes = {r[group]: r["count"] for r in cells.where(F.col(group).isin(test, ref)).groupBy(group).count().collect()}
    n1, n2 = sizes.get(test, 0), sizes.get(ref, 0)
    here = expr.join(cells.where(F.col(group).isin(test, ref)).select("cell_id", (F.col(group) == test).alias("t")), "cell_id")
    v = here.groupBy("gene", F.col(value).alias("v")).agg(F.sum(F.col("t").cast("long")).alias("a"), F.count("*").alias("n"))
    stored = v.groupBy("gene").agg(F.sum("a").alias("sa"), F.sum("n").alias("sn"))
    zero = stored.select("gene", F.lit(0).cast(v.schema["v"].dataType).alias("v"), (F.lit(n1) - F.col("sa")).alias("a"), (F.lit(n1 + n2) - F.col("sn")).alias("n"))
    every = v.unionByName(zero).groupBy("gene", "v").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("gene").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = every.withColumn("rank", below + (F.col("n") + 1) / 2)
    s = ranked.groupBy("gene").agg(
        F.sum(F.col("a") * F.col("rank")).alias("r"),
        (F.sum(F.col("a") * F.col("v")) / n1).alias("m1"),
        (F.sum((F.col("n") - F.col("a")) * F.col("v")) / n2).alias("m2"),
    )
    z = (F.col("r") - n1 * (n1 + n2 + 1) / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return s.select("gene", F.round(z, 6).alias("u_z"), F.round(F.log2((F.expm1("m1") + 1e-9) / (F.expm1("m2") + 1e-9)), 6).alias("log2fc"))


def rank_sum_test(expr: DataFrame, cells: DataFrame, test: str, ref: str, group: str = "condition") -> DataFrame:
    """rank_sum() with p and fdr."""
    out = rank_sum(expr, cells, test, ref, group).withColumn("p", normal_two_sided("u_z")).withColumn("test", F.lit(f"{test}vs{ref}"))
    return benjamini_hochberg(out, "p", ["test"], ["gene"])


def rank_sum_by(expr: DataFrame, cells: DataFrame, test: str, ref: str, subset: str = "cell_type", group: str = "condition", least: int = 1) -> DataFrame:
    """subset, gene, u_z, log2fc, p, fdr of rank_sum() within each subset of the cells and in 'all', in one job.

    Subsets with fewer than `least` cells of either group have no row; genes without counts in a subset have none there.
    """
    each = cells.where(F.col(group).isin(test, ref)).select("cell_id", (F.col(group) == test).alias("t"), F.col(subset).alias("subset"))
    both = each.unionByName(each.withColumn("subset", F.lit("all")))
    sizes = both.groupBy("subset").agg(F.count_if("t").alias("n1"), F.count_if(~F.col("t")).alias("n2")).where((F.col("n1") >= least) & (F.col("n2") >= least))
    v = expr.where("count > 0").join(both.join(F.broadcast(sizes), "subset", "left_semi"), "cell_id").groupBy("subset", "gene", F.col("count").alias("v")).agg(F.sum(F.col("t").cast("long")).alias("a"), F.count("*").alias("n"))
    stored = v.groupBy("subset", "gene").agg(F.sum("a").alias("sa"), F.sum("n").alias("sn")).join(sizes, "subset")
    zero = stored.select("subset", "gene", F.lit(0).cast(v.schema["v"].dataType).alias("v"), (F.col("n1") - F.col("sa")).alias("a"), (F.col("n1") + F.col("n2") - F.col("sn")).alias("n"))
    w = Window.partitionBy("subset", "gene").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = v.unionByName(zero).withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    s = ranked.groupBy("subset", "gene").agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(F.col("a") * F.col("v")).alias("s1"), F.sum((F.col("n") - F.col("a")) * F.col("v")).alias("s2")).join(sizes, "subset")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")  # the product of three sizes is beyond a long from millions of cells
    z = (F.col("r") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    fold = F.log2((F.expm1(F.col("s1") / n1) + 1e-9) / (F.expm1(F.col("s2") / n2) + 1e-9))
    out = s.select("subset", "gene", F.round(z, 6).alias("u_z"), F.round(fold, 6).alias("log2fc")).withColumn("p", normal_two_sided("u_z"))
    return benjamini_hochberg(out, "p", ["subset"], ["gene"])


def hurdle(expr: DataFrame, cells: DataFrame, test: str, ref: str, group: str = "condition") -> DataFrame:
    """gene, chi2: likelihood ratio of a detection (binomial) and an expression (Gaussian, log1p) part, by closed form."""
    sizes = {r[group]: r["count"] for r in cells.where(F.col(group).isin(test, ref)).groupBy(group).count().collect()}
    x = F.log1p("count")
    here = expr.where("count > 0").join(cells.where(F.col(group).isin(test, ref)).select("cell_id", (F.col(group) == test).alias("t")), "cell_id").withColumn("x", x)
    part = lambda c, t: F.coalesce(F.sum(F.when(F.col("t") == t, c)), F.lit(0))
    s = here.groupBy("gene").agg(*[part(c, t).cast("double").alias(f"{k}{int(t)}") for t in (True, False) for k, c in (("n", F.lit(1)), ("s", F.col("x")), ("q", F.col("x") * F.col("x")))])
    xlogx = lambda k, n: F.when((k > 0) & (k < n), k * F.log(k / n) + (n - k) * F.log((n - k) / n)).otherwise(0.0)
    n1, n0 = F.lit(float(sizes.get(test, 0))), F.lit(float(sizes.get(ref, 0)))
    d = 2 * (xlogx(F.col("n1"), n1) + xlogx(F.col("n0"), n0) - xlogx(F.col("n1") + F.col("n0"), n1 + n0))
    k = F.col("n1") + F.col("n0")
    own = lambda t: F.when(F.col(f"n{t}") > 0, F.col(f"q{t}") - F.col(f"s{t}") * F.col(f"s{t}") / F.col(f"n{t}")).otherwise(0.0)
    rss1, rss0 = own(1) + own(0), F.col("q1") + F.col("q0") - (F.col("s1") + F.col("s0")) * (F.col("s1") + F.col("s0")) / k
    c = F.when((rss1 > 1e-12) & (F.col("n1") > 0) & (F.col("n0") > 0), k * F.log(rss0 / rss1)).otherwise(0.0)
    return s.select("gene", F.round(d + c, 6).alias("chi2"))


def detected_genes(pb: DataFrame, min_count: float = 2, min_total: float = 15) -> DataFrame:
    """Genes of a pseudobulk with enough counts per million in as many samples as the smallest group has."""
    lib = pb.groupBy("subset", "sample").agg(F.sum("count").alias("lib"))
    middle = lib.groupBy("subset").agg(F.median("lib").alias("m"), F.count("*").alias("n_samples"))
    cpm = pb.join(lib, ["subset", "sample"]).join(middle, "subset").withColumn("ok", (F.col("count") * 1e6 / F.col("lib") >= min_count * 1e6 / F.col("m")).cast("long"))
    g = cpm.groupBy("subset", "gene").agg(F.sum("ok").alias("ok"), F.sum("count").alias("total"), F.max("n_samples").alias("n_samples"))
    return g.where((F.col("total") >= min_total) & (F.col("ok") * 3 >= F.col("n_samples"))).select("subset", "gene", "total")


def testable(pb: DataFrame, samples: DataFrame, ref: str, min_samples: int = 2) -> DataFrame:
    """Subsets that have the reference and another condition, each with enough samples."""
    s = pb.select("subset", "sample").distinct().join(samples.select("sample", "condition").distinct(), "sample").groupBy("subset", "condition").agg(F.count("*").alias("n"))
    g = s.groupBy("subset").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max((F.col("condition") == ref).cast("int")).alias("has_ref"))
    return g.where((F.col("k") >= 2) & (F.col("least") >= min_samples) & (F.col("has_ref") == 1)).select("subset")


def group_sample_counts(de: DataFrame, cells: DataFrame, subset: str = "cell_type") -> DataFrame:
    """de(subset, test_group, ref) with n_test and n_ref: distinct samples of each, 0 if absent."""
    n = cells.groupBy(F.col(subset).alias("subset"), "condition").agg(F.count_distinct("sample").alias("n"))
    out = de
    for side, name in (("test_group", "n_test"), ("ref", "n_ref")):
        out = out.join(n.select("subset", F.col("condition").alias(side), F.col("n").alias(name)), ["subset", side], "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n_test", "n_ref")})


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """common, r, sign_agreement, rank_mae of two tables(gene, logfc)."""
    w = Window.orderBy(F.desc("logfc"), "gene")  # one row for each gene
    ra, rb = a.withColumn("ra", F.rank().over(w)), b.withColumn("rb", F.rank().over(w))
    j = ra.withColumnRenamed("logfc", "fa").join(rb.withColumnRenamed("logfc", "fb"), "gene")
    return j.agg(
        F.count("*").alias("common"), F.round(F.corr("fa", "fb"), 6).alias("r"), F.round(F.avg((F.signum("fa") == F.signum("fb")).cast("double")), 6).alias("sign_agreement"),
        F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 6).alias("rank_mae"),
    )


def top_markers(de: DataFrame, k: int, min_fc: float = 0, max_fdr: float = 1.0, share: float = 1.0, by: str = "cell_type") -> DataFrame:
    """The k genes with the highest logfc of each type, after filters and the top share by mean expression."""
    ok = de.where((F.col("logfc") > min_fc) & (F.col("fdr") <= max_fdr))
    w = Window.partitionBy(by)
    ranked = ok.withColumn("__r", F.row_number().over(w.orderBy(F.desc("mean"), "gene"))).withColumn("__n", F.floor(F.count("*").over(w) * share))
    best = ranked.where(F.col("__r") <= F.col("__n")).withColumn("rank", F.row_number().over(w.orderBy(F.desc("logfc"), "gene")))
    return best.where(F.col("rank") <= k).drop("__r", "__n")


def specific_markers(de: DataFrame, max_fdr: float, min_left: int) -> DataFrame:
    """Significant genes of one type only; types with fewer than min_left of them are left out."""
    ok = de.where(F.col("fdr") <= max_fdr).withColumn("__k", F.count("*").over(Window.partitionBy("gene"))).where("__k = 1")
    return ok.withColumn("__n", F.count("*").over(Window.partitionBy("cell_type"))).where(F.col("__n") >= min_left).drop("__k", "__n")


def exclusive_markers(de: DataFrame, in_fc: float, out_fc: float, top: int) -> DataFrame:
    """Genes above in_fc in one type and at most out_fc in all others, top by logfc."""
    w = Window.partitionBy("gene")
    ok = de.withColumn("__others", F.sum((F.col("logfc") <= out_fc).cast("int")).over(w)).withColumn("__n", F.count("*").over(w))
    hit = ok.where((F.col("logfc") > in_fc) & (F.col("__others") == F.col("__n") - 1))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("cell_type").orderBy(F.desc("logfc"), "gene"))).where(F.col("rank") <= top).drop("__others", "__n")


def rank_methods(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """method, one rank for each metric (1: highest), their sum and the final rank."""
    out = metrics
    for c in columns:
        out = out.withColumn(f"rank_{c}", F.row_number().over(Window.orderBy(F.desc(c), "method")))  # one row for each method
    out = out.withColumn("rank_sum", sum((F.col(f"rank_{c}") for c in columns), F.lit(0)))
    return out.withColumn("final_rank", F.row_number().over(Window.orderBy("rank_sum", "method")))


def ensembl_ids(df: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """df(gene) with ensembl: by symbol, else by the symbol that the gene is an alias of, else 'NA'."""
    direct = symbols.select(F.col("symbol").alias("gene"), F.col("ensembl").alias("e1"))
    by_alias = aliases.join(symbols, "symbol").select(F.col("alias").alias("gene"), F.col("ensembl").alias("e2"))
    return df.join(direct, "gene", "left").join(by_alias, "gene", "left").withColumn("ensembl", F.coalesce("e1", "e2", F.lit("NA"))).drop("e1", "e2")


def enrichment(study: DataFrame, population: DataFrame, sets: DataFrame, min_pop: int = 5, min_study: int = 1) -> DataFrame:
    """term, pop_n, study_n, expected, fold: how a study's genes fall into sets(term, gene)."""
    n_study, n_pop = study.count(), population.count()
    pop = sets.join(population.select("gene").distinct(), "gene").join(study.select("gene").distinct().withColumn("__s", F.lit(1)), "gene", "left")
    c = pop.groupBy("term").agg(F.count("*").alias("pop_n"), F.count("__s").alias("study_n")).where((F.col("pop_n") >= min_pop) & (F.col("study_n") >= min_study))
    expected = F.col("pop_n") * n_study / n_pop
    return c.withColumns({"expected": F.round(expected, 6), "fold": F.round(F.col("study_n") / expected, 6), "__n": F.lit(n_study), "__t": F.lit(n_pop)})


def enrichment_test(study: DataFrame, population: DataFrame, sets: DataFrame, **limits: int) -> DataFrame:
    e = enrichment(study, population, sets, **limits)
    return e.withColumn("p", hypergeometric_tail("study_n", "__n", "pop_n", "__t")).drop("__n", "__t")


def two_sample_t(df: DataFrame, value: str, group: str, a: str, b: str, by: list[str]) -> DataFrame:
    """by, t: equal-variance t statistic of two groups; null with fewer than two values in either."""
    s = df.groupBy(*by).agg(
        *[f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    t = (F.col("m0") - F.col("m1")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    return s.select(*by, F.round(F.when((F.col("n0") > 1) & (F.col("n1") > 1) & (pooled > 0), t), 6).alias("t"))


def top_terms(enriched: DataFrame, n: int = 30) -> DataFrame:
    """The n terms of enrichment_test() of least p (then of greatest fold, then by name), with fdr over all terms."""
    one = enriched.withColumn("__one", F.lit(1))
    out = benjamini_hochberg(one, "p", ["__one"], ["term"]).drop("__one")
    return out.orderBy("p", F.desc("fold"), "term").limit(n)


def two_sample_tests(df: DataFrame, value: str, group: str, a: str, b: str, by: list[str]) -> DataFrame:
    """by, n_a, n_b, delta (difference of means), relative (by the mean of b), t, p of two groups with equal variances; t and p
    are null with fewer than two values in either or none that differ."""
    from spotloom.operators import models

    @F.pandas_udf(DoubleType())
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else models.f_tail(x * x, 1, k) for x, k in zip(t, n, strict=True)], dtype=float)

    g = [F.when(F.col(group) == k, F.col(value)) for k in (a, b)]
    s = df.groupBy(*by).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(g) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    free = F.col("n0") + F.col("n1") - 2
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / free
    t = F.when((F.col("n0") > 1) & (F.col("n1") > 1) & (pooled > 0), (F.col("m0") - F.col("m1")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1"))))
    out = s.withColumn("t", t).select(*by, F.col("n0").alias("n_a"), F.col("n1").alias("n_b"), (F.col("m0") - F.col("m1")).alias("delta"), F.when(F.col("m1") != 0, (F.col("m0") - F.col("m1")) / F.col("m1")).alias("relative"), "t")
    return out.withColumn("p", tail("t", (F.col("n_a") + F.col("n_b") - 2).cast("double")))


def factor_chi2(counts: DataFrame, min_count: int = 20) -> DataFrame:
    """gene, factor, chi2, fold of counts(gene, factor, n): one gene and factor against all others."""
    g, f = F.sum("n").over(Window.partitionBy("gene")), F.sum("n").over(Window.partitionBy("factor"))
    whole = counts.agg(F.sum("n").alias("t")).head()["t"] or 0
    c = counts.withColumns({"g": g, "f": f}).where(F.col("g") >= min_count)
    a, t = F.col("n").cast("double"), F.lit(float(whole))
    b, d = F.col("g") - a, F.col("f") - a
    e = t - a - b - d
    chi = t * (a * e - b * d) * (a * e - b * d) / (F.col("g") * F.col("f") * (t - F.col("g")) * (t - F.col("f")))
    return c.select("gene", "factor", F.round(chi, 6).alias("chi2"), F.round(a / F.col("f") / (F.col("g") / t), 6).alias("fold"))


def correlation(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.round(F.corr(a, b), 6).alias("r"))


def sanitise(c: Column) -> Column:
    """Labels fit for file names: blanks, slashes and dashes to '_', plus signs and brackets dropped."""
    return F.translate(F.regexp_replace(c, r"[ \-/]", "_"), "+()", "")


def trimmed_factors(pb: DataFrame, ref: str, trim: float = 0.3) -> DataFrame:
    """sample, factor: 2 to the mean log ratio to the reference sample, over genes between the trim quantiles of it."""
    lib = pb.groupBy("sample").agg(F.sum("count").alias("lib"))
    s = pb.join(lib, "sample").select("sample", "gene", (F.col("count") / F.col("lib")).alias("f"))
    m = s.join(s.where(F.col("sample") == ref).select("gene", F.col("f").alias("g")), "gene").where("f > 0 and g > 0").withColumn("m", F.round(F.log2(F.col("f") / F.col("g")), 9))
    q = m.groupBy("sample").agg(F.percentile("m", trim).alias("lo"), F.percentile("m", 1 - trim).alias("hi"))
    inside = m.join(q, "sample").where("m between lo and hi")
    return inside.groupBy("sample").agg(F.round(F.pow(F.lit(2.0), F.avg("m")), 6).alias("factor"))


def moderated_t(pb: DataFrame, samples: DataFrame, test: str, ref: str, prior_df: float = 4) -> DataFrame:
    """gene, logfc, t of log2 counts per million of two conditions' samples; variances are drawn to their mean over genes.

    Samples without a gene count as 0 (log2 of 0.5 in place of the count).
    """
    lib = pb.groupBy("sample").agg(F.sum("count").alias("lib")).join(samples.where(F.col("condition").isin(test, ref)).select("sample", "condition").distinct(), "sample")
    full = pb.select("gene").distinct().withColumn("__k", F.lit(1)).join(F.broadcast(lib.withColumn("__k", F.lit(1))), "__k").join(pb.select("sample", "gene", "count"), ["sample", "gene"], "left")  # one row for each sample is sent
    y = F.log2((F.coalesce("count", F.lit(0)) + 0.5) / (F.col("lib") + 1) * 1e6)
    g = full.withColumn("y", y).groupBy("gene").agg(
        *[f(F.when(F.col("condition") == c, F.col("y"))).alias(f"{n}{i}") for i, c in enumerate((test, ref)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    ).where("n0 > 1 and n1 > 1")
    d = F.col("n0") + F.col("n1") - 2
    g = g.withColumns({"d": d, "s2": ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / d})
    s0 = g.agg(F.avg("s2").alias("s")).head()["s"] or 0.0
    mod = (prior_df * s0 + F.col("d") * F.col("s2")) / (prior_df + F.col("d"))
    return g.select("gene", F.round(F.col("m0") - F.col("m1"), 6).alias("logfc"), F.round((F.col("m0") - F.col("m1")) / F.sqrt(mod * (1 / F.col("n0") + 1 / F.col("n1"))), 6).alias("t"))


def _nb_fit(y, x, offset, phi, rounds: int = 50):
    """Coefficients, log-likelihood and covariance of a negative-binomial log-linear model with fixed dispersion."""
    import numpy as np

    beta = np.zeros(x.shape[1])
    beta[0] = math.log(max(y.sum(), 0.5) / np.exp(offset).sum())
    for _ in range(rounds):
        mu = np.exp(np.clip(x @ beta + offset, -30, 30))
        w = mu / (1 + phi * mu)
        h = x.T @ (w[:, None] * x) + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ ((y - mu) / (1 + phi * mu)))
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    mu = np.exp(np.clip(x @ beta + offset, -30, 30))
    size = 1 / phi
    ll = sum(math.lgamma(a + size) - math.lgamma(size) - math.lgamma(a + 1) + size * math.log(size / (size + m)) + a * math.log(m / (size + m)) for a, m in zip(y, mu, strict=True))
    return beta, ll, np.linalg.inv(h)


def common_dispersion(pb: DataFrame, samples: DataFrame) -> float:
    """Median over genes of the excess of variance over the mean, by the squared mean, of scaled counts."""
    lib = pb.groupBy("sample").agg(F.sum("count").alias("lib"))
    mean = lib.agg(F.avg("lib").alias("m")).head()["m"] or 1.0
    v = pb.join(lib, "sample").withColumn("y", F.col("count") / F.col("lib") * mean).join(samples.select("sample", "condition").distinct(), "sample")
    g = v.groupBy("gene", "condition").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    phi = g.where("m > 0 and v is not null").agg(F.median((F.col("v") - F.col("m")) / (F.col("m") * F.col("m"))).alias("phi")).head()["phi"]
    return max(phi or 0.0, 1e-3)


def negative_binomial(pb: DataFrame, samples: DataFrame, test: str, ref: str, others: bool = False) -> DataFrame:
    """gene, logfc (base 2), stat, p: counts ~ condition with library sizes as offsets and one common dispersion.

    By default a likelihood-ratio test of `test` against `ref`; with others, a Wald test of `test` against the mean of all
    other conditions. Genes are fitted one by one in a grouped map; the design (one row for each sample) is shared. Without
    two conditions or with fewer samples than coefficients plus one there is nothing to test and no row.
    """
    import numpy as np
    import pandas as pd

    lib = pb.groupBy("sample").agg(F.sum("count").alias("lib")).join(samples.select("sample", "condition").distinct(), "sample")
    if not others:
        lib = lib.where(F.col("condition").isin(test, ref))
    design = lib.orderBy("sample").toPandas()
    levels = [ref, *sorted(set(design["condition"]) - {ref})] if not design.empty else []
    schema = "gene string, logfc double, stat double, p double"
    if len(levels) < 2 or test not in levels or len(design) <= len(levels):
        return pb.sparkSession.createDataFrame([], schema)
    x = np.column_stack([np.ones(len(design))] + [(design["condition"] == c).to_numpy(float) for c in levels[1:]])
    offset, at = np.log(design["lib"].to_numpy(float)), {s: i for i, s in enumerate(design["sample"])}
    phi, place = common_dispersion(pb, samples), levels.index(test)
    contrast = np.zeros(len(levels))
    if others:
        contrast[place] = 1
        contrast[[i for i in range(1, len(levels)) if i != place]] = -1 / (len(levels) - 1)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(len(at))
        for s, c in zip(f["sample"], f["count"], strict=True):
            y[at[s]] += c
        beta, ll, cov = _nb_fit(y, x, offset, phi)
        if others:
            fc = float(contrast @ beta)
            stat = fc * fc / float(contrast @ cov @ contrast)
        else:
            fc = float(beta[place])
            stat = max(0.0, 2 * (ll - _nb_fit(y, x[:, :1], offset, phi)[1]))
        return pd.DataFrame({"gene": [f["gene"].iloc[0]], "logfc": [fc / math.log(2)], "stat": [stat], "p": [math.erfc(math.sqrt(stat / 2))]})

    here = pb.join(F.broadcast(lib.select("sample")), "sample", "left_semi").select("gene", "sample", "count")  # one row for each sample
    return here.groupBy("gene").applyInPandas(fit, schema)


def marker_ratios(de: DataFrame) -> DataFrame:
    """gene, ratio (greatest logfc by the second one, null where that is 0), sd (sample deviation over types)."""
    w = Window.partitionBy("gene").orderBy(F.desc("logfc"), "cell_type")
    ranked = de.where("logfc is not null").withColumn("r", F.row_number().over(w))
    top = lambda k: F.max(F.when(F.col("r") == k, F.col("logfc")))
    g = ranked.groupBy("gene").agg(top(1).alias("first"), top(2).alias("second"), F.stddev_samp("logfc").alias("sd"))
    return g.select("gene", F.round(F.when(F.col("second") != 0, F.col("first") / F.col("second")), 6).alias("ratio"), F.round("sd", 6).alias("sd"))


def shaped_results(de: DataFrame, test: str, ref: str, columns: dict[str, str], most_fdr: float | None = None) -> DataFrame:
    """A result table in its final form: columns renamed and in the order given, fc = 2 ** logfc, test = "AvsB", by FDR cut."""
    out = de.withColumns({"fc": F.pow(F.lit(2.0), F.col("logfc")), "test": F.lit(f"{test}vs{ref}"), "test_group": F.lit(test), "ref": F.lit(ref)})
    out = out if most_fdr is None else out.where(F.col("fdr") <= most_fdr)
    return out.select(*[F.col(a).alias(b) for a, b in columns.items()])


def top_n(df: DataFrame, by: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The n rows of each group with the greatest value, ties by name, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
