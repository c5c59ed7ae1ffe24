"""Integration of batches against the same steps on one matrix, and components by Gram blocks against numpy."""

import numpy as np

from spotloom.operators import embed, integrate


def _data(seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (4, 6)) * 2
    kind, batch = rng.integers(0, 4, 400), rng.integers(0, 3, 400)
    return centre[kind] + rng.normal(0, 0.2, (400, 6)) + (rng.normal(0, 0.5, (3, 6)))[batch], kind, batch


def _harmonised(z, batch, ids, k, theta, sigma, ridge, rounds, steps, seed):
    import hashlib

    first = sorted(range(len(z)), key=lambda i: (hashlib.md5(f"{seed}:{ids[i]}".encode()).hexdigest(), ids[i]))[:k]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    y, b = unit(z[first]), batch.max() + 1
    phi = np.eye(b)[batch]
    share, cur, pull, told = phi.mean(axis=0), z.copy(), np.zeros((k, b)), []

    def soft():
        d = 2 * (1 - unit(cur) @ y.T)
        r = np.exp(-d / sigma) * np.exp(pull)[:, batch].T
        return r / r.sum(axis=1, keepdims=True), d

    for _ in range(rounds):
        for _ in range(steps):
            r, d = soft()
            held = r.T @ phi
            want = theta * np.log((held.sum(axis=1, keepdims=True) * share + 1) / (held + 1))
            told.append((r * d).sum() + sigma * (r * np.log(r)).sum() - sigma * (held * want).sum())
            y, pull = unit(r.T @ unit(cur)), (pull + want) / 2
        r, _ = soft()
        new = z.copy()
        for c in range(k):
            x = np.column_stack([np.ones(len(z)), phi])
            w = np.linalg.solve(x.T @ (r[:, c : c + 1] * x) + np.diag([0.0] + [ridge] * b), x.T @ (r[:, c : c + 1] * z))
            w[0] = 0
            new -= r[:, c : c + 1] * (x @ w)
        cur = new
    return cur, told


def test_integration(spark):
    z, kind, batch = _data()
    ids = list(range(1000, 1400))
    table = spark.createDataFrame([(ids[i], f"b{batch[i]}", z[i].tolist(), "x") for i in range(400)] + [(1, "b0", None, "x")], "vec_id long, slide string, embedding array<double>, b string")
    got, told = integrate.integrate(table.repartition(5), "slide", 4)
    at = {r["vec_id"]: np.array(r["vector"]) for r in got.collect()}
    want, objective = _harmonised(z, batch, ids, 4, 2.0, 0.1, 1.0, 3, 5, 1)
    assert set(at) == set(ids) and np.allclose(np.array([at[i] for i in ids]), want, atol=1e-6) and np.allclose(told, objective, rtol=1e-9)
    for s in range(0, 15, 5):
        assert told[s + 4] <= told[s] + 1e-9
    assert told[4] >= told[9] >= told[14]
    after = np.array([at[i] for i in ids])
    apart = lambda x: np.mean([np.linalg.norm(x[(kind == c) & (batch == p)].mean(axis=0) - x[kind == c].mean(axis=0)) for c in range(4) for p in range(3)])
    assert apart(after) < 0.2 * apart(z)
    assert integrate.integrate(table.limit(0), "slide", 4)[0].count() == 0


def test_components_of_all_cells(spark):
    rng = np.random.default_rng(5)
    x = rng.poisson(0.6, (60, 7)).astype(float)
    x[10] = 0
    rows = [(i, f"g{j}", float(x[i, j])) for i in range(60) for j in range(7) if x[i, j]]
    expr = spark.createDataFrame(rows, "cell_id long, gene string, count double").repartition(4)
    cells = spark.range(60).withColumnRenamed("id", "cell_id")
    scores, shares = embed.pca(expr, 60, 3, cells=cells)
    got = {r["cell_id"]: np.array(r["pc"]) for r in scores.collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, v = np.linalg.eigh(np.cov(z.T))
    want = z @ v[:, ::-1][:, :3]
    assert set(got) == set(range(60)) and np.allclose(np.abs(np.array([got[i] for i in range(60)])), np.abs(want), atol=1e-9)
    assert np.allclose(shares, w[::-1][:3] / w.sum())
