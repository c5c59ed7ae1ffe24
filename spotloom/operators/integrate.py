"""Integration of batches: soft clusters with a penalty on batches that keep apart, and ridge corrections for each cluster.

All a round needs of the vectors are sums for each cluster and batch (weights, weighted vectors); tasks make them from
batches of rows, the driver adds up clusters x batches x dimensions numbers, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.operators.tables import keep


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def memberships(z: np.ndarray, batch: np.ndarray, centres: np.ndarray, pull: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft memberships (rows, clusters) of vectors, and distances: exp(-distance / sigma) times the pull of each cluster on
    the row's batch, made to sum to 1."""
    d = 2 * (1 - _unit(z) @ centres.T)
    a = -d / sigma + pull[:, batch].T
    r = np.exp(a - a.max(axis=1, keepdims=True))
    return r / r.sum(axis=1, keepdims=True), d


def pulls(observed: np.ndarray, share: np.ndarray, theta: float) -> np.ndarray:
    """theta times log of expected over observed weight of each cluster (rows) and batch."""
    expected = observed.sum(axis=1, keepdims=True) * share
    return theta * np.log((expected + 1) / (observed + 1))


def corrections(weight: np.ndarray, total: np.ndarray, ridge: float) -> np.ndarray:
    """Offsets (clusters, batches, dimensions) of a ridge regression of the vectors on their batch within each cluster, from
    weights (clusters, batches) and weighted sums of vectors; the common level of a cluster is not penalised and stays."""
    k, b, d = total.shape
    out = np.zeros((k, b, d))
    for c in range(k):
        m = np.zeros((b + 1, b + 1))
        m[0, 0] = weight[c].sum()
        m[0, 1:] = m[1:, 0] = weight[c]
        m[1:, 1:] = np.diag(weight[c] + ridge)
        out[c] = np.linalg.solve(m, np.vstack([total[c].sum(axis=0), total[c]]))[1:]
    return out


def _sums(rows: DataFrame, kernel, size: int) -> np.ndarray:
    """Element-wise sum of the arrays that kernel(batch) makes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += kernel(batch)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size)), "x": pa.array(total)})

    out = np.zeros(size)
    for r in rows.mapInArrow(each, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = batch["z"].flatten().to_numpy().reshape(batch.num_rows, -1)
    return z, batch["cur"].flatten().to_numpy().reshape(batch.num_rows, -1), batch["b"].to_numpy()


def integrate(
    vectors: DataFrame, batch: str, clusters: int, value: str = "embedding", key: str = "vec_id", theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 3, steps: int = 5, seed: int = 1
) -> tuple[DataFrame, list[float]]:
    """key, batch, vector with the offsets of batches within soft clusters taken away, and the objective after each step.

    Clusters start from as many vectors, drawn by a seeded digest of their key. A step finds memberships by cosine with a
    pull of each cluster towards the batches it lacks (theta), half of it from the step before, and moves the centres; after `steps` steps every vector
    loses its clusters' offsets of its batch (from the vector as given, ridge regression), and `rounds` rounds are done. Null vectors have no
    row; a null batch is one of its own. Clusters and batches are few: their sums come to the driver.
    """
    known = vectors.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(batch).alias("name"), F.col(value).cast("array<double>").alias("z"))
    names = [r["name"] for r in known.select("name").distinct().orderBy(F.col("name").asc_nulls_first()).collect()]  # one row for each batch
    if not names:
        return known.select(F.col("k").alias(key), F.col("name").alias(batch), F.col("z").alias("vector")), []
    table = vectors.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"__n {known.schema['name'].dataType.simpleString()}, b int")
    rows = known.join(F.broadcast(table), known["name"].eqNullSafe(table["__n"])).select("k", "name", "b", "z", F.col("z").alias("cur"))
    rows = keep(rows, "batches")
    first = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("k").cast("string"))), "k").limit(clusters).select("z").collect()
    centres = _unit(np.array([r["z"] for r in first]))
    k, d, b = len(centres), centres.shape[1], len(names)
    size = {r["b"]: r["count"] for r in rows.groupBy("b").count().collect()}
    share = np.array([size.get(i, 0) for i in range(b)], float)
    share /= share.sum()
    pull, told = np.zeros((k, b)), []
    for _ in range(rounds):
        for _ in range(steps):

            def gather(part: pa.RecordBatch, centres=centres, pull=pull) -> np.ndarray:
                _, cur, at = _read(part)
                r, far = memberships(cur, at, centres, pull, sigma)
                held = np.zeros((k, b))
                np.add.at(held.T, at, r)
                cost = (r * far).sum() + sigma * (r * np.log(np.maximum(r, 1e-300))).sum()
                return np.concatenate([(r.T @ _unit(cur)).ravel(), held.ravel(), [cost]])

            s = _sums(rows, gather, k * d + k * b + 1)
            held = s[k * d : -1].reshape(k, b)
            # Half of the new pull and half of the old: all rows change at once, and would go from one side to the other.
            centres, pull, told = _unit(s[: k * d].reshape(k, d)), (pull + pulls(held, share, theta)) / 2, [*told, float(s[-1] - sigma * (held * pulls(held, share, theta)).sum())]

        def weigh(part: pa.RecordBatch, centres=centres, pull=pull) -> np.ndarray:
            z, cur, at = _read(part)
            r, _ = memberships(cur, at, centres, pull, sigma)
            held, total = np.zeros((b, k)), np.zeros((b, k, d))
            np.add.at(held, at, r)
            for i in np.unique(at):
                total[i] = r[at == i].T @ z[at == i]
            return np.concatenate([held.T.ravel(), total.transpose(1, 0, 2).ravel()])

        s = _sums(rows, weigh, k * b + k * b * d)
        offset = corrections(s[: k * b].reshape(k, b), s[k * b :].reshape(k, b, d), ridge)

        def correct(batches: Iterator[pa.RecordBatch], centres=centres, pull=pull, offset=offset) -> Iterator[pa.RecordBatch]:
            for part in batches:
                if not part.num_rows:
                    continue
                z, cur, at = _read(part)
                r, _ = memberships(cur, at, centres, pull, sigma)
                new = z - np.einsum("nk,nkd->nd", r, offset[:, at].transpose(1, 0, 2))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * d, pa.int32()), pa.array(new.ravel()))
                yield part.set_column(part.schema.get_field_index("cur"), "cur", listed)

        rows = keep(rows.mapInArrow(correct, rows.schema), "integrated")
    return rows.select(F.col("k").alias(key), F.col("name").alias(batch), F.col("cur").alias("vector")), told
