"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from conftest import SMALL

from spotloom.operators import dea
from spotloom.plans import registry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return "nan" if math.isnan(x) else float(f"{float(x):.8g}") + 0.0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9), (a, b)


def _matrix(rows, cells, value="count"):
    """Cells by genes, zeros included."""
    genes = sorted({r["gene"] for r in rows})
    x = np.zeros((len(cells), len(genes)))
    at, place = {c: i for i, c in enumerate(cells)}, {g: i for i, g in enumerate(genes)}
    for r in rows:
        x[at[r["cell_id"]], place[r["gene"]]] += r[value]
    return x


def _components(got, x, cells, k):
    """Scores are those of the leading eigenvectors of the correlation matrix, up to their sign."""
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :k]
    want = np.abs(z @ axes)
    assert {r["cell_id"] for r in got} <= set(cells) and got
    for r in got:
        assert np.allclose(np.abs(r["pc"]), want[cells.index(r["cell_id"])], atol=1e-5)


def test_pca_scores(spark):
    v = registry.Views(spark, SMALL)
    cells = sorted(r["cell_id"] for r in v.cells.select("cell_id").collect())
    _components(registry.QUERIES["pca_scores"](spark, SMALL).collect(), _matrix(v.expr.collect(), cells), cells, 5)


def test_pseudobulk_components(spark):
    v = registry.Views(spark, SMALL)
    pb = dea.pseudobulk(v.expr, v.cells).where("subset = 'all'").selectExpr("sample AS cell_id", "gene", "count")
    samples = sorted(r["cell_id"] for r in pb.select("cell_id").distinct().collect())
    _components(registry.QUERIES["pseudobulk_components"](spark, SMALL).collect(), _matrix(pb.collect(), samples), samples, 2)


@pytest.mark.parametrize("name", ["negative_binomial", "one_against_others"])
def test_count_models(spark, name):
    """One row for each gene; fold changes near those of the pooled shares, large ones with small p."""
    v = registry.Views(spark, SMALL)
    pb = dea.pseudobulk(v.expr, v.cells).where("subset = 'all'").collect()
    of = {r["sample"]: r["condition"] for r in v.cells.select("sample", "condition").distinct().collect()}
    others = ("WT",) if name == "negative_binomial" else ("WT", "AGED")
    share = {}
    for side in (("KO",), others):
        lib = sum(r["count"] for r in pb if of[r["sample"]] in side)
        for r in pb:
            if of[r["sample"]] in side:
                share[side, r["gene"]] = share.get((side, r["gene"]), 0) + r["count"] / lib
    got = {r["gene"]: r for r in registry.QUERIES[name](spark, SMALL).collect()}
    assert set(got) == {g for _, g in share}
    want = np.array([np.log2(share[("KO",), g] / share[others, g]) for g in got])
    logfc, p = (np.array([got[g][c] for g in got]) for c in ("logfc", "p"))
    assert np.corrcoef(want, logfc)[0, 1] > 0.9 and np.abs(want - logfc).mean() < 0.25
    assert ((p >= 0) & (p <= 1)).all() and np.corrcoef(np.abs(logfc), p)[0, 1] < -0.5


def test_integrated_vectors(spark):
    """Batches lie closer together than before, and no vector is lost."""
    v = registry.Views(spark, SMALL)
    before = {r["vec_id"]: np.array(r["embedding"], float) for r in v.embeddings.collect()}
    after = {r["vec_id"]: np.array(r["vector"]) for r in registry.QUERIES["integrated_vectors"](spark, SMALL).collect()}
    assert set(after) == set(before)
    spread = lambda x: np.var([np.mean([y for k, y in x.items() if k % 4 == b], axis=0) for b in range(4)], axis=0).sum()
    assert spread(after) < 0.2 * spread(before)


def test_neighbours_and_segments(spark):
    v = registry.Views(spark, SMALL)
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in v.embeddings.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    got = {}
    for r in registry.QUERIES["vector_neighbours"](spark, SMALL).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    for i in range(0, len(ids), 17):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [got[ids[i]][k] for k in range(1, 11)] == ids[np.argsort(d, kind="stable")[:10]].tolist()
    parts = registry.QUERIES["split_segments"](spark, SMALL).collect()
    seeds = {(r["y"] // 100, r["x"] // 100, r["cell_id"]) for r in v.cells.select("x", "y", "cell_id").collect()}
    where = {k: (r, c) for r, c, k in seeds}
    component = {(r["row"], r["col"]): r["component"] for r in parts}
    assert all(r["seed"] is None or component[where[r["seed"]]] == r["component"] for r in parts) and any(r["seed"] is not None for r in parts)


def test_every_query_is_checked():
    checked = {"likelihood_ratio_tests", "quasi_likelihood_tests", "precision_weighted_tests", "markers_by_models", "hurdle_with_covariate"} | {"graph_clusters", "pca_scores", "pseudobulk_components", "negative_binomial", "one_against_others", "integrated_vectors", "split_segments"}
    assert set(registry.QUERIES) - set(registry.ORACLES) == checked
