"""Sums over neighbourhoods: right results, and no shuffle of each pair of neighbours with its counts."""

import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotloom.operators import hoods
from spotloom.operators.tables import keep
from spotloom.plans import registry

_CELLS = "cell_id long, sample string, x double, y double, cell_type string"
_EXPR = "cell_id long, gene string, count long"
K, RADIUS = 4, 6.0


def _data():
    rng = random.Random(3)
    cells = [(i, rng.choice("st"), float(rng.randint(0, 9)) * 2, float(rng.randint(0, 9)) * 2, rng.choice(["A", "B", "C", None])) for i in range(300)]
    cells += [(1000 + i, "s", 4.0, 4.0, "AB"[i % 2]) for i in range(200)]  # one place
    cells += [(2000, "s", 500.0, 500.0, "A"), (2001, "s", None, 0.0, "A"), (2002, None, 4.0, 4.0, "B")]
    expr = [(c[0], g, rng.randint(0, 5)) for c in cells for g in rng.sample(["a1", "a2", "b1", "b2", "c1", "x", None], rng.randint(0, 4))]
    return cells, [*expr, (7777, "a1", 3), (2, "odd", None)]


def _near(cells):
    out = {}
    for i, s, x, y, _ in cells:
        d = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, t, a, b, _ in cells if j != i and s is not None and s == t and None not in (x, a))
        out[i] = [j for e, j in d if e <= RADIUS**2][:K]
    return out


def test_means_and_gradients_of_neighbours(spark):
    cells, expr = _data()
    near, at, held = _near(cells), {c[0]: c[2:4] for c in cells}, {}
    for i, g, n in expr:
        held.setdefault(i, []).append((g, n))
    means, gradients = {}, {}
    for i, js in near.items():
        for g in {g for j in js for g, _ in held.get(j, [])}:
            counts = [(j, n) for j in js for h, n in held.get(j, []) if h == g and n is not None]
            ways = [(n, at[j][0] - at[i][0], at[j][1] - at[i][1]) for j, n in counts]
            to = [sum(n * w[c] / math.hypot(*w) for n, *w in ways if any(w)) for c in (0, 1)]
            means[i, g] = sum(n for _, n in counts) / len(js) if counts else None
            gradients[i, g] = math.hypot(*to) / len(js) if counts else None
    df, ex = spark.createDataFrame(cells, _CELLS).repartition(3), spark.createDataFrame(expr, _EXPR).repartition(3)
    for f, want in ((hoods.neighbour_means, means), (hoods.neighbour_gradients, gradients)):
        rows = f(df, ex, K, RADIUS, ["sample"]).collect()
        got = {(r[0], r[1]): r[2] for r in rows}
        assert len(rows) == len(got) and got == {k: v if v is None else pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert None in means.values() and any(g is None for _, g in means)


def test_contamination_of_neighbours(spark):
    cells, expr = _data()
    near, kind, held = _near(cells), {c[0]: c[4] for c in cells}, {}
    for i, g, n in expr:
        if n:
            held.setdefault(i, {})[g] = n
    markers = [("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B"), ("b2", "A"), ("c1", "B"), ("x", None), (None, "A"), ("rare", "A")]
    sets = {}
    for g, t in markers:
        if g is not None and t is not None:
            sets.setdefault(t, set()).add(g)
    want = {}
    for i, js in near.items():
        total = {g: sum(held.get(j, {}).get(g, 0) for j in [i, *js]) for g in sets.get(kind[i], ())}
        for j in js:
            if kind[i] is not None and kind[j] is not None and kind[i] != kind[j]:
                for g, n in total.items():
                    if n and g not in sets.get(kind[j], ()):
                        want.setdefault((kind[i], kind[j]), []).append(held.get(j, {}).get(g, 0) / n)
    df, ex = spark.createDataFrame(cells, _CELLS).repartition(3), spark.createDataFrame(expr, _EXPR).repartition(3)
    rows = hoods.neighbour_contamination(df, ex, spark.createDataFrame(markers, "gene string, gene_set string"), K, RADIUS, ["sample"]).collect()
    assert {tuple(r[:3]): r[3] for r in rows} == {(*k, len(v)): pytest.approx(sum(v) / (len(v) + 1), abs=1e-6) for k, v in want.items()}
    assert ("A", "C") in want and ("C", "A") not in want
    none = hoods.neighbour_contamination(df, ex, spark.createDataFrame([], "gene string, gene_set string"), K, RADIUS, ["sample"])
    assert none.count() == 0


def test_rows_are_taken_in_pieces(monkeypatch):
    genes = pa.array([[["a", "b"], None], [], [["c"]], [["d"] * 30], [["e"], []]], pa.list_(pa.list_(pa.string())))
    b = pa.RecordBatch.from_arrays([genes, pa.array([[0, 1], [0], [0], [0] * 5, [2]])], ["genes", "at"])
    monkeypatch.setattr(hoods, "_AT_ONCE", 4)
    pieces = list(hoods._pieces(iter([b, b.slice(0, 0), b.slice(2)])))
    assert [r for p in pieces for r in p["genes"].to_pylist()] == b.column(0).to_pylist() + b.slice(2).column(0).to_pylist()
    assert len(pieces) >= 4


def _shuffles(spark):
    top = spark.sparkContext.getConf().get("spark.local.dir")
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(top) for f in fs if f.startswith("shuffle_")}


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """30,000 cells at one place, each with ten genes."""
    top = tmp_path_factory.mktemp("crowded")
    orders = spark.range(30_000).selectExpr("id * 1000 AS o_orderkey", "0L AS o_custkey", "concat(id % 5 + 1, if(id % 5 = 0, '-URGENT', '-X')) AS o_orderpriority", "1D AS o_totalprice")
    lines = spark.range(300_000).selectExpr("id DIV 10 * 1000 AS l_orderkey", "id % 10 * 7 + id DIV 10 % 7 AS l_partkey", "0L AS l_suppkey", "1 AS l_linenumber", "double(id % 50 + 1) AS l_quantity")
    orders.write.parquet(f"{top}/orders.parquet")
    lines.write.parquet(f"{top}/lineitem.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["neighbour_means", "neighbour_gradients", "neighbour_contamination"])
def test_neighbours_counts_are_not_shuffled_by_cell(spark, crowded, name):
    before = _shuffles(spark)
    registry.QUERIES[name](spark, crowded).write.format("noop").mode("overwrite").save()
    print(name, sum(n for f, n in _shuffles(spark).items() if f not in before))
    assert sum(n for f, n in _shuffles(spark).items() if f not in before) < 12e6


def test_shuffle_files_of_a_kept_table_go(spark):
    before = _shuffles(spark)
    kept = keep(spark.range(400_000).groupBy("id").agg(F.count("*").alias("n")), "counted")
    assert not _shuffles(spark).keys() - before.keys() and kept.agg(F.sum("n")).head()[0] == 400_000
