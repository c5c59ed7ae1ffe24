"""Models per gene against slow, plain versions."""

import math

import numpy as np
import pytest

from spotloom.operators import models


def _counts(genes=40, n=12, seed=3, phi=0.1):
    rng = np.random.default_rng(seed)
    level = np.exp(rng.normal(4, 1, genes))
    size = rng.uniform(0.5, 2, n) * 1e4
    condition = np.array(["WT", "KO", "AGED"])[np.arange(n) % 3]
    batch = np.array(["x", "y"])[np.arange(n) // 3 % 2]
    effect = np.where((np.arange(genes) % 5 == 0)[:, None] & (condition == "KO"), 3.0, 1.0)
    mu = level[:, None] * effect * size / 1e4 * np.where(batch == "y", 1.3, 1.0)
    y = rng.poisson(rng.gamma(1 / phi, phi, mu.shape) * mu).astype(float)
    return y, size, condition, batch


def _newton(y, x, offset, phi):
    """One gene's fit by small damped Newton steps."""
    beta = np.linalg.lstsq(x, np.log(y + 0.5) - offset, rcond=None)[0]
    ll = lambda b: sum(math.lgamma(a + 1 / phi) - math.lgamma(1 / phi) - math.lgamma(a + 1) - math.log1p(phi * m) / phi + (a * math.log(phi * m / (1 + phi * m))) for a, m in zip(y, np.exp(x @ b + offset)))
    for _ in range(200):
        mu = np.exp(x @ beta + offset)
        h = x.T @ ((mu * (1 + phi * y) / (1 + phi * mu) ** 2)[:, None] * x)
        step = np.linalg.solve(h, x.T @ ((y - mu) / (1 + phi * mu)))
        t = 1.0
        while ll(beta + t * step) < ll(beta) - 1e-12 and t > 1e-8:
            t /= 2
        beta = beta + t * step
    mu = np.exp(x @ beta + offset)
    return beta, ll(beta), ll(beta) - 0.5 * math.log(np.linalg.det(x.T @ ((mu / (1 + phi * mu))[:, None] * x)))


def test_special_functions():
    for v in (0.01, 0.5, 1.0, 3.3, 50.0, 1e5):
        assert abs(float(models.lgamma(np.array(v))) - math.lgamma(v)) < 1e-9 * max(1, abs(math.lgamma(v)))
        h = 1e-4 * v
        assert abs(models.digamma(v) - (math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h)) < 1e-4 * max(1, abs(models.digamma(v)))
        assert abs(models.trigamma_inverse(models.trigamma(v)) / v - 1) < 1e-6
    assert abs(models.f_tail(4.964603, 1, 10) - 0.05) < 1e-6 and abs(models.f_tail(3.841459, 1, math.inf) - 0.05) < 1e-6
    assert abs(models.beta_tail(2, 3, 0.4) - 0.5248) < 1e-9


def test_count_models():
    y, size, condition, batch = _counts()
    x, levels = models.design(condition, batch)
    assert levels == ["AGED", "KO", "WT"] and x.shape == (12, 4)
    offset = np.log(size)
    curves = models.profiles(y, x, offset)
    for g in (0, 7, 21):
        for i in (4, 20, 30):
            assert abs(curves[g, i] - _newton(y[g], x, offset, 2.0 ** models.GRID[i])[2]) < 1e-5
    # The gene's own maximum, and one that is drawn to its neighbours, by a fine search.
    fine = np.arange(-8, 2, 0.02)
    for g in (3, 21):
        best = 2 ** fine[np.argmax([_newton(y[g], x, offset, 2.0**f)[2] for f in fine])]
        assert abs(math.log2(models.peaks(curves)[g] / best)) < 0.25
    level = np.log2((y.sum(axis=1) + 0.5) / size.sum() * 1e6)
    own, trend = models.dispersions(y, x, offset, level)
    order = np.argsort(level, kind="stable")
    for g in (0, 11, 39):
        r = int(np.flatnonzero(order == g)[0])
        first = min(max(r - 6, 0), 40 - 12)
        near = curves[order[first : first + 12]].mean(axis=0)
        assert np.isclose(trend[g], models.peaks(near[None])[0]) and np.isclose(own[g], models.peaks((curves[g] + 10 / 8 * near)[None])[0])
    assert np.median(np.abs(np.log2(own / 0.1))) < 1
    tested = models.contrasts(levels, "WT", 4)
    assert list(tested) == ["AGEDvsWT", "KOvsWT"] and models.contrasts(levels, None, 4)["KOvsothers"].tolist() == [-0.5, 1, -0.5, 0]
    lrt = models.count_tests(y, x, size, tested, "LRT")["KOvsWT"]
    plain = np.column_stack([np.ones(12), condition == "AGED", condition == "KO", batch == "y"]).astype(float)
    for g in (0, 5, 8, 33):
        beta, full, _ = _newton(y[g], plain, offset, own[g])
        _, less, _ = _newton(y[g], plain[:, [0, 1, 3]], offset, own[g])
        assert abs(lrt["logfc"][g] - beta[2] / math.log(2)) < 1e-5 and abs(lrt["stat"][g] - 2 * (full - less)) < 1e-5
        assert abs(lrt["p"][g] - math.erfc(math.sqrt(max(lrt["stat"][g], 0) / 2))) < 1e-9
    ql = models.count_tests(y, x, size, tested, "QL")["KOvsWT"]
    hit = np.arange(40) % 5 == 0
    for r in (lrt, ql):
        assert np.median(r["p"][hit]) < 1e-3 and (r["p"][~hit] < 0.01).mean() < 0.15 and np.abs(r["logfc"][hit] - math.log2(3)).mean() < 0.5
    # Quasi-likelihood: deviances by definition, drawn to their common value.
    mu = np.stack([np.exp(plain @ _newton(y[g], plain, offset, trend[g])[0] + offset) for g in range(40)])
    a = 1 / trend[:, None]
    dev = 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-9) / mu), 0) - (y + a) * np.log((y + a) / (mu + a))).sum(axis=1) / 8
    d0, s0 = models.prior_of_variances(dev, 8)
    post = dev * 0 + s0 if math.isinf(d0) else (d0 * s0 + 8 * dev) / (d0 + 8)
    for g in (0, 8):
        lr = 2 * (_newton(y[g], plain, offset, trend[g])[1] - _newton(y[g], plain[:, [0, 1, 3]], offset, trend[g])[1])
        assert abs(ql["stat"][g] - lr / post[g]) < 1e-4


def test_weighted_models():
    y, size, condition, batch = _counts(seed=9)
    x, levels = models.design(condition, None)
    got = models.linear_tests(y, x, size, models.contrasts(levels, "WT", 3))["KOvsWT"]
    v = np.log2((y + 0.5) / (size + 1) * 1e6)
    fit = np.stack([[row[condition == c].mean() for c in condition] for row in v])
    s = np.sqrt(((v - fit) ** 2).sum(axis=1) / 9)
    mean = v.mean(axis=1) + np.log2(size + 1).mean() - math.log2(1e6)

    def line(at):
        d = np.abs(mean - at)
        w = np.clip(1 - (d / (np.sort(d)[19] * 1.0000001)) ** 3, 0, None) ** 3
        a = np.linalg.solve(np.array([[w.sum(), (w * mean).sum()], [(w * mean).sum(), (w * mean**2).sum()]]), [(w * np.sqrt(s)).sum(), (w * mean * np.sqrt(s)).sum()])
        return a[0] + a[1] * at

    knots = np.sort(mean)
    trend = np.array([line(k) for k in knots])
    w = 1 / np.interp(fit + np.log2(size + 1) - math.log2(1e6), knots, trend) ** 4
    ko, wt = condition == "KO", condition == "WT"
    m = np.stack([(w * v)[:, condition == c].sum(axis=1) / w[:, condition == c].sum(axis=1) for c in ("AGED", "KO", "WT")])
    back = np.stack([m[levels.index(c)] for c in condition], axis=1)
    s2 = (w * (v - back) ** 2).sum(axis=1) / 9
    d0, s0 = models.prior_of_variances(s2, 9)
    post = s2 * 0 + s0 if math.isinf(d0) else (d0 * s0 + 9 * s2) / (d0 + 9)
    t = (m[1] - m[2]) / np.sqrt(post * (1 / w[:, ko].sum(axis=1) + 1 / w[:, wt].sum(axis=1)))
    assert np.allclose(got["logfc"], m[1] - m[2], atol=1e-8) and np.allclose(got["stat"], t, atol=1e-6)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(8)
    cells = [(i, f"s{i % 12}", ["WT", "KO", "AGED"][i % 3], ["T1", "T2"][i // 12 % 2], f"b{i % 12 // 3 % 2}", float(rng.uniform(50, 150))) for i in range(720)]
    rows = [(c[0], f"g{g:02d}", int(k)) for c in cells for g in range(25) if (k := rng.poisson(0.3 + 0.1 * g + (1.5 if g % 6 == 0 and c[2] == "KO" else 0)))]
    return (
        spark.createDataFrame(rows, "cell_id long, gene string, count long"),
        spark.createDataFrame(cells, "cell_id long, sample string, condition string, cell_type string, slide string, volume_final double"),
        rows,
        cells,
    )


def test_sample_tests(spark, tables):
    from spotloom.operators import dea

    expr, cells, rows, known = tables
    pb = dea.pseudobulk(expr, cells)
    for kind in ("LRT", "QL", "WLS"):
        got = models.sample_tests(pb, cells, "WT", kind, batch="slide").collect()
        assert {r["subset"] for r in got} == {"T1", "T2", "all"} and {r["test"] for r in got} == {"KOvsWT", "AGEDvsWT"}
        hits = {(r["subset"], r["gene"]) for r in got if r["test"] == "KOvsWT" and r["fdr"] < 0.05}
        assert {g for s, g in hits if s == "all"} >= {"g00", "g06", "g12"} and not any(r["fdr"] < 0.01 for r in got if r["test"] == "AGEDvsWT")
    # The same from a matrix.
    names = sorted({c[1] for c in known})
    of, size = {c[0]: c for c in known}, np.zeros(12)
    y = np.zeros((25, 12))
    for c in known:
        size[names.index(c[1])] += c[5]
    for c, g, k in rows:
        y[int(g[1:]), names.index(of[c][1])] += k
    factor = {r["sample"]: r["factor"] for r in models.trimmed_mean_factors(pb.where("subset = 'all'"), models.sample_sizes(pb, cells)).where("subset = 'all'").collect()}
    f = np.array([factor[s] for s in names])
    assert abs(np.log(f).sum()) < 1e-9
    quart = np.quantile(y / size, 0.75, axis=0)
    ref = min(range(12), key=lambda j: (round(abs(quart[j] - quart.mean()), 12), names[j]))
    want = np.ones(12)
    for j in range(12):
        ok = (y[:, j] > 0) & (y[:, ref] > 0)
        a, b = y[ok, j] / size[j], y[ok, ref] / size[ref]
        m, e = np.log2(a / b).round(9), ((np.log2(a) + np.log2(b)) / 2).round(9)
        v = 1 / y[ok, j] - 1 / size[j] + 1 / y[ok, ref] - 1 / size[ref]
        v = np.where(v > 0, v, 1 / y[ok, j] + 1 / y[ok, ref])
        rank = lambda z: np.array([(z < q).sum() + ((z == q).sum() + 1) / 2 for q in z])
        n = ok.sum()
        lm, la = math.floor(n * 0.3) + 1, math.floor(n * 0.05) + 1
        keep = (rank(m) >= lm) & (rank(m) <= n + 1 - lm) & (rank(e) >= la) & (rank(e) <= n + 1 - la)
        want[j] = 2 ** ((m[keep] / v[keep]).sum() / (1 / v[keep]).sum())
    assert np.allclose(f, want / np.exp(np.log(want).mean()), atol=1e-9)
    one = {r["gene"]: r for r in models.sample_tests(pb, cells, "WT", "LRT").where("subset = 'all' and test = 'KOvsWT'").collect()}
    condition = np.array([next(c[2] for c in known if c[1] == s) for s in names])
    x, levels = models.design(condition, None)
    direct = models.count_tests(y, x, size * f, models.contrasts(levels, "WT", 3), "LRT")["KOvsWT"]
    assert all(abs(one[f"g{g:02d}"]["stat"] - direct["stat"][g]) < 1e-6 for g in range(25))
    # Guards: condition and batch are one; too few samples.
    assert models.sample_tests(pb, cells, "WT", "LRT", batch="condition").count() == 0
    assert models.sample_tests(pb.where("sample in ('s0', 's1')"), cells, "WT", "LRT").count() == 0
    every = models.sample_tests(pb.where("subset = 'all'"), cells, None, "QL").collect()
    assert {r["test"] for r in every} == {"KOvsothers", "AGEDvsothers", "WTvsothers"}
    level = {t: np.quantile([r["logcpm"] for r in every if r["test"] == t], 0.5) for t in ("KOvsothers", "AGEDvsothers", "WTvsothers")}
    strong = models.strong(spark.createDataFrame(every)).collect()
    assert {(r["test"], r["gene"]) for r in strong} == {(r["test"], r["gene"]) for r in every if r["fdr"] < 1e-5 and r["logcpm"] >= level[r["test"]]}


def test_hurdle_model(spark, tables):
    expr, cells, rows, known = tables
    got = {r["gene"]: r for r in models.hurdle_model(expr, cells, "KO", "WT", batch="slide").collect()}
    here = [c for c in known if c[2] != "AGED"]
    count = {(c, g): k for c, g, k in rows}
    x = np.column_stack([[c[2] == "KO" for c in here], np.ones(len(here)), [c[4] == "b1" for c in here]]).astype(float)
    for g in ("g00", "g03", "g24"):
        v = np.array([count.get((c[0], g), 0) for c in here], float)
        seen = v > 0

        def logistic(x):
            b = np.zeros(x.shape[1])
            for _ in range(50):
                p = 1 / (1 + np.exp(-x @ b))
                b += np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x), x.T @ (seen - p))
            p = 1 / (1 + np.exp(-x @ b))
            return np.log(np.where(seen, p, 1 - p)).sum(), b

        rss = lambda x: np.linalg.lstsq(x[seen], np.log1p(v[seen]), rcond=None)
        r1, r0 = rss(x), rss(x[:, 1:])
        chi2 = 2 * (logistic(x)[0] - logistic(x[:, 1:])[0]) + seen.sum() * math.log(r0[1][0] / r1[1][0])
        assert abs(got[g]["chi2"] - chi2) < 1e-5 and abs(got[g]["logit"] - logistic(x)[1][0]) < 1e-5 and abs(got[g]["logfc"] - r1[0][0]) < 1e-6 and got[g]["df"] == 2
    assert models.hurdle_model(expr, cells, "KO", "WT", cap=100).count() == 0  # 200 cells are too few
    assert models.hurdle_model(expr, cells, "KO", "WT", cap=130).count() > 0
    assert models.hurdle_model(expr, cells, "KO", "WT", least_sample=61).count() == 0
    assert models.hurdle_model(expr, cells, "KO", "none").count() == 0
    rare = spark.createDataFrame([(c[0], "rare", 1) for c in here[:20]] + [(c[0], "often", 1) for c in here[:60]], "cell_id long, gene string, count long")
    assert [r["gene"] for r in models.hurdle_model(rare, cells, "KO", "WT").collect()] == ["often"]


def test_two_samples(spark):
    from spotloom.operators import dea

    rows = [("x", "KO", 1.0), ("x", "KO", 2.0), ("x", "KO", 4.0), ("x", "WT", 5.0), ("x", "WT", 7.0), ("y", "KO", 1.0), ("y", "WT", 1.0), ("z", "KO", 3.0), ("z", "KO", 3.0), ("z", "WT", 3.0), ("z", "WT", 3.0), ("w", "KO", None)]
    got = {r["k"]: r for r in dea.two_sample_tests(spark.createDataFrame(rows, "k string, c string, v double"), "v", "c", "KO", "WT", ["k"]).collect()}
    t = (7 / 3 - 6) / math.sqrt((2 * np.var([1, 2, 4], ddof=1) + np.var([5, 7], ddof=1)) / 3 * (1 / 3 + 1 / 2))
    assert abs(got["x"]["t"] - t) < 1e-12 and abs(got["x"]["delta"] - (7 / 3 - 6)) < 1e-12
    # Three degrees of freedom have a closed form.
    u = abs(t) / math.sqrt(3)
    assert abs(got["x"]["p"] - (1 - 2 / math.pi * (u / (1 + u * u) + math.atan(u)))) < 1e-12
    assert got["y"]["p"] is None and got["z"]["t"] is None and got["w"]["n_a"] == 0


def test_label_grid(spark):
    from spotloom.operators import raster

    p = spark.createDataFrame([(0.0, 0.0, "a"), (25.0, 0.0, "b"), (50.2, 25.0, "c"), (None, 1.0, "d")], "x double, y double, label string")
    assert {tuple(r) for r in raster.label_grid(p).collect()} == {(1, 0, "a"), (1, 1, "b"), (0, 2, "c")}
    with pytest.raises(ValueError):
        raster.label_grid(p.unionByName(p))
