"""Models per gene: negative-binomial and quasi-likelihood tests, precision-weighted linear models, hurdle tests with covariates.

What needs all genes of a subset at once (dispersions, trends, prior degrees of freedom) is worked out in one Arrow group per
subset: genes of the panel by samples, not cells. Filters, library factors and adjustment are SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators import dea
from spotloom.operators.tables import keep

# --- special functions -------------------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series behind a shift by ten."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    for i in range(10):
        shift = shift * (x + i)
    y = x + 10
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def trigamma_inverse(y: float) -> float:
    """x > 0 with trigamma(x) = y, by halving."""
    low, high = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if trigamma(mid) > y else (low, mid)
    return math.sqrt(low * high)


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def f_tail(f: float, d1: float, d2: float) -> float:
    """Chance of a value above f of the F distribution; d2 may be infinite."""
    if not f > 0:
        return 1.0
    return dea._gamma_upper(d1 / 2, d1 * f / 2) if math.isinf(d2) else beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def prior_of_variances(s2: np.ndarray, df: float) -> tuple[float, float]:
    """Prior degrees of freedom (infinite where variances differ by no more than chance) and variance, by the moments of log variances."""
    s2 = np.maximum(s2, 1e-5 * max(float(np.median(s2)), 1e-300))
    e = np.log(s2) - digamma(df / 2) + math.log(df / 2)
    more = float(e.var(ddof=1)) - trigamma(df / 2) if len(e) > 1 else 0.0
    if more <= 0:
        return math.inf, math.exp(float(e.mean()))
    d0 = 2 * trigamma_inverse(more)
    return d0, math.exp(float(e.mean()) + digamma(d0 / 2) - math.log(d0 / 2))


def squeezed(s2: np.ndarray, df: float, d0: float, s0: float) -> np.ndarray:
    return np.full_like(s2, s0) if math.isinf(d0) else (d0 * s0 + df * s2) / (d0 + df)


# --- negative binomial -------------------------------------------------------------------------------------------------

#: Base-2 logarithms of the dispersions that are tried.
GRID = np.arange(-14, 5.01, 0.5)


def fit_counts(y: np.ndarray, x: np.ndarray, offset: np.ndarray, phi: np.ndarray, start: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (genes, columns) and means of log-linear negative-binomial models of counts (genes, samples), all genes at once."""
    phi = np.broadcast_to(phi, (len(y),))[:, None]
    if start is None:
        level = np.log((y.sum(axis=1) + 0.5) / np.exp(offset).sum())
        start = np.linalg.lstsq(x, np.ones(len(x)), rcond=None)[0] * level[:, None]
    beta = start.copy()
    ridge = 1e-9 * np.eye(x.shape[1])
    for _ in range(rounds):
        mu = np.exp(np.clip(beta @ x.T + offset, -30, 30))
        w = mu / (1 + phi * mu)
        h = np.einsum("ni,gn,nj->gij", x, w, x) + ridge
        step = np.linalg.solve(h, ((y - mu) / (1 + phi * mu) @ x)[:, :, None])[:, :, 0]
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta, np.exp(np.clip(beta @ x.T + offset, -30, 30))


def count_likelihood(y: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    r = 1 / np.broadcast_to(phi, (len(y),))[:, None]
    return (lgamma(y + r) - lgamma(r) - lgamma(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum(axis=1)


def count_deviance(y: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    r = 1 / np.broadcast_to(phi, (len(y),))[:, None]
    own = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0)
    return np.maximum(2 * (own - (y + r) * np.log((y + r) / (mu + r))).sum(axis=1), 0)


def profiles(y: np.ndarray, x: np.ndarray, offset: np.ndarray, grid: np.ndarray = GRID) -> np.ndarray:
    """Adjusted profile likelihood (genes, grid) of dispersions 2 ** grid: the likelihood at the fitted means, less half the
    logarithm of the determinant of their information."""
    out, beta = [], None
    for g in grid:
        phi = np.full(len(y), 2.0**g)
        beta, mu = fit_counts(y, x, offset, phi, beta)
        w = mu / (1 + phi[:, None] * mu)
        info = np.einsum("ni,gn,nj->gij", x, w, x) + 1e-12 * np.eye(x.shape[1])
        out.append(count_likelihood(y, mu, phi) - 0.5 * np.linalg.slogdet(info)[1])
    return np.stack(out, axis=1)


def peaks(curves: np.ndarray, grid: np.ndarray = GRID) -> np.ndarray:
    """2 to the place of each curve's maximum, between grid points by the parabola through the three highest."""
    at = np.clip(curves.argmax(axis=1), 1, len(grid) - 2)
    i = np.arange(len(curves))
    a, b, c = curves[i, at - 1], curves[i, at], curves[i, at + 1]
    bend = a - 2 * b + c
    shift = np.where(bend < 0, 0.5 * (a - c) / np.where(bend < 0, bend, 1), np.where(a > c, -1.0, 1.0))
    return 2.0 ** (grid[at] + np.clip(shift, -1, 1) * (grid[1] - grid[0]))


def dispersions(y: np.ndarray, x: np.ndarray, offset: np.ndarray, level: np.ndarray, prior_df: float = 10.0, span: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Dispersion of each gene, drawn to that of genes of like abundance, and that trend itself.

    The trend's curve is the mean of those of the nearest genes by level (a share `span`, ten at least); a gene's own counts as
    prior_df over the residual degrees of freedom of them.
    """
    own = profiles(y, x, offset)
    order = np.argsort(level, kind="stable")
    n = len(y)
    width = min(n, max(10, math.ceil(span * n)))
    total = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own[order], axis=0)])
    first = np.clip(np.arange(n) - width // 2, 0, n - width)
    near = np.empty_like(own)
    near[order] = (total[first + width] - total[first]) / width
    return peaks(own + prior_df / (len(x) - x.shape[1]) * near), peaks(near)


def design(condition: np.ndarray, batch: np.ndarray | None) -> tuple[np.ndarray, list[str]] | None:
    """Columns of conditions (one each) and batches (but the first); null without full rank or residual degrees of freedom."""
    levels = sorted(set(condition.tolist()))
    cols = [(condition == c).astype(float) for c in levels]
    if batch is not None:
        cols += [(batch == b).astype(float) for b in sorted(set(batch.tolist()))[1:]]
    x = np.column_stack(cols)
    rank = np.linalg.matrix_rank(x)
    return (x, levels) if rank == x.shape[1] and len(x) > rank else None


def contrasts(levels: list[str], ref: str | None, columns: int) -> dict[str, np.ndarray]:
    """Each other condition less the reference or, without one, each condition less the mean of the others."""
    out = {}
    for i, test in enumerate(levels):
        c = np.zeros(columns)
        if ref is None:
            c[: len(levels)] = -1 / max(1, len(levels) - 1)
        elif test != ref and ref in levels:
            c[levels.index(ref)] = -1
        else:
            continue
        c[i] = 1
        out[f"{test}vs{ref if ref is not None else 'others'}"] = c
    return out


def without(x: np.ndarray, contrast: np.ndarray) -> np.ndarray:
    """Design of the models in which the contrast is zero."""
    return x @ np.linalg.svd(contrast[None, :])[2][1:].T


def count_tests(y: np.ndarray, x: np.ndarray, size: np.ndarray, tested: dict[str, np.ndarray], kind: str) -> dict[str, dict[str, np.ndarray]]:
    """Of each contrast logfc (base 2), stat and p of each gene, with logcpm and dispersion; size are effective library sizes."""
    offset, df = np.log(size), len(x) - x.shape[1]
    level = np.log2((y.sum(axis=1) + 0.5) / size.sum() * 1e6)
    own, trend = dispersions(y, x, offset, level)
    phi = trend if kind == "QL" else own
    beta, mu = fit_counts(y, x, offset, phi)
    full, out = count_likelihood(y, mu, phi), {}
    if kind == "QL":
        s2 = count_deviance(y, mu, phi) / df
        d0, s0 = prior_of_variances(s2, df)
        post, total = squeezed(s2, df, d0, s0), min(d0 + df, df * len(y))
    for name, c in tested.items():
        x0 = without(x, c)
        _, mu0 = fit_counts(y, x0, offset, phi)
        lr = np.maximum(2 * (full - count_likelihood(y, mu0, phi)), 0)
        stat = lr / post if kind == "QL" else lr
        p = [f_tail(float(s), 1, total) for s in stat] if kind == "QL" else [dea._gamma_upper(0.5, float(s) / 2) for s in stat]
        out[name] = {"logfc": beta @ c / math.log(2), "logcpm": level, "stat": stat, "p": np.array(p), "dispersion": phi}
    return out


# --- precision weights -------------------------------------------------------------------------------------------------


def local_line(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.5) -> np.ndarray:
    """Local linear regression with tricube weights over the nearest share `span` of the points."""
    k = min(len(x), max(2, math.ceil(span * len(x))))
    out = np.empty(len(at))
    for i, v in enumerate(at):
        d = np.abs(x - v)
        reach = max(np.partition(d, k - 1)[k - 1] * 1.0000001, 1e-12)
        w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3
        m, t = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        s = (w * (x - m) ** 2).sum()
        out[i] = t + (v - m) * ((w * (x - m) * (y - t)).sum() / s if s > 1e-12 else 0.0)
    return out


def weighted_fit(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residual variances and unscaled covariances of weighted linear models of all genes."""
    inv = np.linalg.inv(np.einsum("ni,gn,nj->gij", x, w, x))
    beta = np.einsum("gij,gj->gi", inv, (w * y) @ x)
    return beta, (w * (y - beta @ x.T) ** 2).sum(axis=1) / (len(x) - x.shape[1]), inv


def precision_weights(count: np.ndarray, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 counts per million and their weights: the inverse fourth power of the square root of a residual's deviation that
    the trend over mean log counts gives at each fitted value."""
    y = np.log2((count + 0.5) / (size + 1) * 1e6)
    beta, s2, _ = weighted_fit(y, x, np.ones_like(y))
    sx = y.mean(axis=1) + np.log2(size + 1).mean() - math.log2(1e6)
    sy = np.sqrt(np.sqrt(s2))
    knots = np.unique(sx)
    trend = np.maximum(local_line(sx, sy, knots), 1e-3)
    fitted = beta @ x.T + np.log2(size + 1) - math.log2(1e6)
    return y, 1 / np.interp(fitted, knots, trend) ** 4


def linear_tests(count: np.ndarray, x: np.ndarray, size: np.ndarray, tested: dict[str, np.ndarray]) -> dict[str, dict[str, np.ndarray]]:
    """As count_tests(), by moderated t of weighted linear models; dispersion is the moderated variance."""
    y, w = precision_weights(count, x, size)
    beta, s2, inv = weighted_fit(y, x, w)
    df = len(x) - x.shape[1]
    d0, s0 = prior_of_variances(s2, df)
    post, total, out = squeezed(s2, df, d0, s0), min(d0 + df, df * len(y)), {}
    for name, c in tested.items():
        t = beta @ c / np.sqrt(post * np.einsum("i,gij,j->g", c, inv, c))
        out[name] = {"logfc": beta @ c, "logcpm": y.mean(axis=1), "stat": t, "p": np.array([f_tail(float(v * v), 1, total) for v in t]), "dispersion": post}
    return out


# --- on tables ---------------------------------------------------------------------------------------------------------


def sample_sizes(pb: DataFrame, cells: DataFrame, subset: str = "cell_type", volume: str = "volume_final") -> DataFrame:
    """subset, sample, size: summed volume of the sample's cells in each subset of a pseudobulk and in 'all'."""
    each = cells.select("sample", F.col(subset).alias("subset"), F.col(volume).alias("v"))
    both = each.unionByName(each.withColumn("subset", F.lit("all")))
    return both.groupBy("subset", "sample").agg(F.sum("v").cast("double").alias("size")).join(pb.select("subset", "sample").distinct(), ["subset", "sample"], "left_semi")


def expressed(pb: DataFrame, samples: DataFrame, min_count: float = 2, min_total: float = 15) -> DataFrame:
    """subset, gene of pb(subset, sample, gene, count) with enough counts per million (min_count at the median library) in
    as many samples as the smallest condition has (beyond ten, ten and 70 % of the rest), and min_total counts."""
    lib = pb.groupBy("subset", "sample").agg(F.sum("count").alias("lib")).join(samples.select("sample", "condition").distinct(), "sample")
    least = lib.groupBy("subset", "condition").agg(F.count("*").alias("n")).groupBy("subset").agg(F.min("n").alias("n"))
    need = F.when(F.col("n") > 10, 10 + (F.col("n") - 10) * 0.7).otherwise(F.col("n"))
    rule = lib.groupBy("subset").agg(F.median("lib").alias("m")).join(least, "subset").select("subset", "m", need.alias("need"))
    ok = (F.col("count") / F.col("lib") >= min_count / F.col("m")).cast("int")
    each = pb.join(lib.select("subset", "sample", "lib"), ["subset", "sample"]).join(rule, "subset")
    g = each.groupBy("subset", "gene").agg(F.sum(ok).alias("k"), F.sum("count").alias("t"), F.first("need").alias("need"))
    return g.where((F.col("k") >= F.col("need") - 1e-14) & (F.col("t") >= min_total)).select("subset", "gene")


def trimmed_mean_factors(pb: DataFrame, sizes: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """subset, sample, size, factor of pb(subset, sample, gene, count) and sizes(subset, sample, size).

    The reference of a subset is the sample whose upper quartile of counts by size is nearest to the mean of all samples'
    (least name among equals). A factor is 2 to the mean log ratio to it (M), weighted by the inverse of its approximate variance, over the genes of both samples
    that are neither among the outer trim_m by M nor among the outer trim_a by mean log level (A), on both sides; factors of
    a subset multiply to 1. A sample without common genes has the factor 1 before that.
    """
    sizes = keep(sizes, "sizes")
    p = keep(pb.join(sizes.where("size > 0"), ["subset", "sample"]), "sized")
    genes = p.groupBy("subset").agg(F.count_distinct("gene").alias("genes"))
    # Quartiles are those of all genes of the subset, zeros included.
    w = Window.partitionBy("subset", "sample").orderBy(F.desc("count"), "gene")
    at = (F.col("genes") - 1) * 0.25
    ranked = p.join(genes, "subset").withColumn("r", F.row_number().over(w) - 1)
    share = F.greatest(F.lit(0.0), 1 - F.abs(F.col("r") - at))
    quart = ranked.groupBy("subset", "sample").agg(F.sum(F.col("count") / F.col("size") * share).alias("q"))
    mean = quart.groupBy("subset").agg(F.avg("q").alias("m"))
    ref = quart.join(mean, "subset").groupBy("subset").agg(F.min(F.struct(F.round(F.abs(F.col("q") - F.col("m")), 12).alias("d"), "sample")).getField("sample").alias("ref"))
    f = p.where("count > 0").select("subset", "sample", "gene", "count", "size")
    base = f.join(ref, "subset").where("sample = ref").select("subset", "gene", F.col("count").alias("rc"), F.col("size").alias("rs"))
    m = F.log2((F.col("count") / F.col("size")) / (F.col("rc") / F.col("rs")))
    a = (F.log2(F.col("count") / F.col("size")) + F.log2(F.col("rc") / F.col("rs"))) / 2
    v = 1 / F.col("count") - 1 / F.col("size") + 1 / F.col("rc") - 1 / F.col("rs")
    v = F.when(v > 0, v).otherwise(1 / F.col("count") + 1 / F.col("rc"))
    each = f.join(base, ["subset", "gene"]).select("subset", "sample", "gene", F.round(m, 9).alias("m"), F.round(a, 9).alias("a"), v.alias("v"))
    by = Window.partitionBy("subset", "sample")
    mid = lambda c: F.rank().over(by.orderBy(c)) + (F.count("*").over(Window.partitionBy("subset", "sample", c)) - 1) / 2
    each = each.withColumns({"n": F.count("*").over(by), "rm": mid("m"), "ra": mid("a")})
    low = lambda t: F.floor(F.col("n") * t) + 1
    inside = F.col("rm").between(low(trim_m), F.col("n") + 1 - low(trim_m)) & F.col("ra").between(low(trim_a), F.col("n") + 1 - low(trim_a))
    raw = each.where(inside).groupBy("subset", "sample").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("log"))
    full = sizes.where("size > 0").join(raw, ["subset", "sample"], "left").withColumn("log", F.coalesce("log", F.lit(0.0)))
    mean = F.avg("log").over(Window.partitionBy("subset"))
    return full.select("subset", "sample", "size", F.pow(F.lit(2.0), F.col("log") - mean).alias("factor"))


_TESTS = "subset string, test string, gene string, logfc double, logcpm double, stat double, p double, dispersion double"


def sample_tests(pb: DataFrame, cells: DataFrame, ref: str | None, kind: str = "QL", batch: str | None = None, subset: str = "cell_type", min_samples: int = 2) -> DataFrame:
    """subset, test, gene, logfc, logcpm, stat, p, dispersion, fdr of each condition against ref, or, where it is null, against
    the mean of the others, for each subset of a pseudobulk and 'all' in one job.

    kind: LRT or QL (negative binomial with dispersions of their own or of the trend and quasi-likelihood), or WLS (linear
    models with precision weights). Libraries are summed volumes times trimmed factors; genes are filtered by expression. Subsets without the
    reference and another condition, with fewer than min_samples of one, without a design of full rank (condition and batch)
    or without residual degrees of freedom have no row. One group holds a subset's genes by samples.
    """
    known = cells.select("sample", "condition", *([F.col(batch).cast("string").alias("batch")] if batch else [])).groupBy("sample").agg(F.min("condition").alias("condition"), *([F.min("batch").alias("batch")] if batch else []))
    pb, known = keep(pb, "pseudobulk"), keep(known, "samples")
    good = dea.testable(pb, known, ref, min_samples) if ref is not None else pb.select("subset").distinct()
    kept = keep(pb.join(good, "subset", "left_semi").join(expressed(pb, known), ["subset", "gene"], "left_semi"), "tested")
    lib = keep(trimmed_mean_factors(kept, sample_sizes(pb, cells, subset)), "factors")
    rows = kept.join(lib, ["subset", "sample"]).join(known, "sample").select("subset", "sample", "gene", F.col("count").cast("double").alias("count"), (F.col("size") * F.col("factor")).alias("size"), "condition", *(["batch"] if batch else []))

    def kernel(table: pa.Table) -> pa.Table:
        got = table.to_pydict()
        names, genes = sorted(set(got["sample"])), sorted(set(got["gene"]))
        at, place = {s: i for i, s in enumerate(names)}, {g: i for i, g in enumerate(genes)}
        y, size = np.zeros((len(genes), len(names))), np.zeros(len(names))
        condition, batches = np.empty(len(names), object), np.empty(len(names), object)
        for i, (s, g, c) in enumerate(zip(got["sample"], got["gene"], got["count"], strict=True)):
            j = at[s]
            y[place[g], j], size[j], condition[j], batches[j] = c, got["size"][i], got["condition"][i], (got["batch"][i] or "") if batch else ""
        made = design(condition.astype(str), batches.astype(str) if batch and len(set(batches.tolist())) > 1 else None)
        out = []
        if made is not None:
            tested = contrasts(made[1], ref, made[0].shape[1])
            found = linear_tests(y, made[0], size, tested) if kind == "WLS" else count_tests(y, made[0], size, tested, kind)
            out = [(got["subset"][0], name, g, *(float(t[c][i]) for c in ("logfc", "logcpm", "stat", "p", "dispersion"))) for name, t in found.items() for i, g in enumerate(genes)]
        cols = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.string()] * 3 + [pa.float64()] * 5
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("subset", "test", "gene", "logfc", "logcpm", "stat", "p", "dispersion"), cols, types, strict=True)})

    tests = rows.groupBy("subset").applyInArrow(kernel, _TESTS)
    return dea.benjamini_hochberg(tests, "p", ["subset", "test"], ["gene"])


def strong(de: DataFrame, most_fdr: float = 1e-5, top: float = 0.5) -> DataFrame:
    """Rows of sample_tests() with a fdr below most_fdr and a logcpm in the upper share `top` of their subset and test."""
    cut = F.percentile("logcpm", F.lit(1 - top)).over(Window.partitionBy("subset", "test"))
    return de.withColumn("__cut", cut).where((F.col("fdr") < most_fdr) & (F.col("logcpm") >= F.col("__cut"))).drop("__cut")


def _parts(x: np.ndarray, n: np.ndarray, k: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Log-likelihood of a logistic model of k of n, residual sum of squares of a linear model of means s / k, and both coefficients."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ ((n * p * (1 - p))[:, None] * x) + 1e-9 * np.eye(x.shape[1])
        step = np.clip(np.linalg.solve(h, x.T @ (k - n * p)), -3, 3)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-15, 1 - 1e-15)
    line = np.linalg.lstsq(x.T @ (k[:, None] * x), x.T @ s, rcond=1e-10)[0]
    return float((k * np.log(p) + (n - k) * np.log(1 - p)).sum()), float(q.sum() - line @ (x.T @ s)), beta, line


def hurdle_model(
    expr: DataFrame, cells: DataFrame, test: str, ref: str, batch: str | None = None, cap: int | None = None, least_cells: int = 250, least_sample: int = 10, any_share: float = 0.1, all_share: float = 0.2, seed: int = 0
) -> DataFrame:
    """gene, chi2, df, p, logit, logfc, fdr of a hurdle model of two conditions: detection (logistic) and log1p of the count
    where there is one (Gaussian), both ~ condition + batch, tested together by the likelihood ratio.

    Samples with fewer than least_sample cells go, then at most `cap` cells of each condition stay (by a seeded digest); with fewer
    than least_cells cells, or without both conditions, there is no row. Genes count that any_share of a condition's cells or
    all_share of all have. All that is fitted are counts and sums of each gene, condition and batch: zeros come from numbers of cells.
    """
    side = cells.where(F.col("condition").isin(test, ref)).select("cell_id", "sample", "condition", (F.coalesce(F.col(batch).cast("string"), F.lit("")) if batch else F.lit("")).alias("batch"))
    large = side.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") >= least_sample)
    side = side.join(large.select("sample"), "sample", "left_semi")
    if cap is not None:
        w = Window.partitionBy("condition").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell_id").cast("string"))), "cell_id")
        side = side.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap)
    groups = side.groupBy("condition", "batch").agg(F.count("*").alias("n")).orderBy("condition", "batch").collect()  # one row for each group
    size = {(r["condition"], r["batch"]): r["n"] for r in groups}
    schema = "gene string, chi2 double, df int, p double, logit double, logfc double"
    if sum(size.values()) < least_cells or {c for c, _ in size} != {test, ref}:
        return expr.sparkSession.createDataFrame([], schema + ", fdr double")
    keys = sorted(size)
    batches = sorted({b for _, b in keys})
    n = np.array([size[k] for k in keys], float)
    x0 = np.column_stack([np.ones(len(keys))] + [[float(b == k[1]) for k in keys] for b in batches[1:]])
    x1 = np.column_stack([[float(k[0] == test) for k in keys], x0])
    if np.linalg.matrix_rank(x1) < x1.shape[1]:
        return expr.sparkSession.createDataFrame([], schema + ", fdr double")
    value = F.log1p("count")
    here = expr.where("count > 0").join(side.select("cell_id", "condition", "batch"), "cell_id")
    sums = here.groupBy("gene", "condition", "batch").agg(F.count("*").cast("double").alias("k"), F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    each = sums.groupBy("gene").agg(F.collect_list(F.struct("condition", "batch", "k", "s", "q")).alias("g"))

    def kernel(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {k: i for i, k in enumerate(keys)}
        for part in batches_:
            out = []
            for gene, told in zip(part["gene"].to_pylist(), part["g"].to_pylist(), strict=True):
                k, s, q = np.zeros((3, len(keys)))
                for t in told:
                    i = at[t["condition"], t["batch"]]
                    k[i], s[i], q[i] = t["k"], t["s"], t["q"]
                shares = [k[x1[:, 0] == c].sum() / n[x1[:, 0] == c].sum() for c in (0, 1)]
                if max(shares) < any_share and k.sum() / n.sum() < all_share:
                    continue
                l1, r1, b1, m1 = _parts(x1, n, k, s, q)
                l0, r0, _, _ = _parts(x0, n, k, s, q)
                both = all(k[x1[:, 0] == c].sum() > 0 for c in (0, 1))
                told_apart = both and r1 > 1e-9 and k.sum() > np.linalg.matrix_rank(x1[k > 0])
                chi2 = max(0.0, 2 * (l1 - l0)) + (max(0.0, k.sum() * math.log(r0 / r1)) if told_apart else 0.0)
                df = 2 if told_apart else 1
                out.append((gene, chi2, df, dea._gamma_upper(df / 2, chi2 / 2), float(b1[0]), float(m1[0]) if told_apart else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["gene", "chi2", "df", "p", "logit", "logfc"])

    found = each.mapInArrow(kernel, schema).withColumn("__one", F.lit(1))
    return dea.benjamini_hochberg(found, "p", ["__one"], ["gene"]).drop("__one")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    done: dict[str, Column] = {c: F.round(c, places) for c in columns}
    return df.withColumns(done)
