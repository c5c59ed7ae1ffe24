"""Principal components, silhouettes and exact neighbours of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators.tables import keep


def gram(expr: DataFrame, genes: list[str], value: str = "count") -> np.ndarray:
    """Sums over cells of the products of every two genes (in the order given) of expr(cell_id, gene, value).

    Cells are put together by one shuffle; a task multiplies blocks of whole cells and sends one genes x genes sum, of which
    only what is not zero. Genes are those of a panel, some hundreds or thousands.
    """
    at = expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, __i int")
    cells = expr.join(F.broadcast(at), "gene").groupBy("cell_id").agg(F.collect_list("__i").alias("i"), F.collect_list(F.col(value).cast("double")).alias("x"))
    n = len(genes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        step = max(1, (1 << 24) // max(1, n))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                block = np.zeros((part.num_rows, n))
                row = np.repeat(np.arange(part.num_rows), part["i"].value_lengths().to_numpy())
                np.add.at(block, (row, part["i"].flatten().to_numpy()), part["x"].flatten().to_numpy())
                total += block.T @ block
        a, b = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "x": pa.array(total[a, b])})

    out = np.zeros((n, n))
    for r in cells.select("i", "x").mapInArrow(kernel, "a long, b long, x double").groupBy("a", "b").agg(F.sum("x").alias("x")).collect():
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["x"]
    return out


def pca(expr: DataFrame, n_cells: int, k: int, value: str = "count", cells: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """cell_id, pc (array of k scores) and the share of variance of each component, of z-scored genes.

    Products of genes are summed by blocks of cells (see gram()); only that matrix comes to the driver. With cells(cell_id) a
    cell without counts has the scores of zeros; without it, no row.
    """
    m = expr.groupBy("gene").agg((F.sum(value) / n_cells).alias("m"), F.sum(F.col(value) * F.col(value)).cast("double").alias("q")).orderBy("gene").collect()
    genes = [r["gene"] for r in m]
    mean = np.array([float(r["m"]) for r in m])
    sd = np.sqrt(np.maximum((np.array([r["q"] for r in m]) - n_cells * mean**2) / max(1, n_cells - 1), 0))
    sd[sd == 0] = 1
    c = (gram(expr, genes, value) - n_cells * np.outer(mean, mean)) / max(1, n_cells - 1) / np.outer(sd, sd)
    w, v = np.linalg.eigh(c)
    v = v[:, ::-1][:, :k]
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    base = -(mean / sd) @ v
    load = expr.sparkSession.createDataFrame([(g, (v[i] / sd[i]).tolist()) for i, g in enumerate(genes)], "gene string, load array<double>")
    terms = [F.sum(F.col(value) * F.get("load", F.lit(j))) + float(base[j]) for j in range(v.shape[1])]
    scores = expr.join(F.broadcast(load), "gene").groupBy("cell_id").agg(F.array(*terms).alias("pc"))  # one row for each gene is sent
    if cells is not None:
        none = F.array(*[F.lit(float(x)) for x in base])
        scores = cells.select("cell_id").distinct().join(scores, "cell_id", "left").select("cell_id", F.coalesce("pc", none).alias("pc"))
    return scores, (w[::-1][:k] / w.sum()).tolist()


def _rows_at_once(numbers: int) -> int:
    """Rows whose differences from vectors of as many numbers take 16 MB, one at least."""
    return max(1, (1 << 21) // max(1, numbers))


def silhouette(vectors: DataFrame, n: int = 10_000, value: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """cells, silhouette: mean over n rows, the first by a digest of their key, by exact distances among them.

    The sample is the statistic's own limit: it is quadratic. Its n rows go to all tasks, which take some of them each.
    """
    typed = vectors.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(value).cast("array<double>").alias("v"))
    sample = keep(typed.orderBy(F.md5(F.col("k").cast("string")), "k").limit(n), "silhouette")
    rows = sample.toPandas()
    names, group = np.unique(rows["l"].to_numpy(), return_inverse=True)
    shared = vectors.sparkSession.sparkContext.broadcast((np.vstack(rows["v"]) if len(rows) else np.zeros((0, 0)), names, group))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, names, group = shared.value
        size = np.bincount(group, minlength=len(names))
        belongs = np.zeros((len(x), len(names)))
        belongs[np.arange(len(x)), group] = 1
        for batch in batches:
            step = _rows_at_once(x.size)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                v = part["v"].flatten().to_numpy().reshape(part.num_rows, -1)
                own = np.searchsorted(names, part["l"].to_numpy(zero_copy_only=False))
                sums = np.sqrt(np.maximum(((v[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0)) @ belongs
                at = np.arange(len(v))
                a = sums[at, own] / np.maximum(size[own] - 1, 1)
                other = np.where(np.arange(len(names)) == own[:, None], np.inf, sums / size)
                b = other.min(axis=1)
                alone = (size[own] < 2) | ~np.isfinite(b)
                s = np.where(alone, 0.0, (b - a) / np.where(alone, 1.0, np.maximum(a, b)))
                yield pa.RecordBatch.from_pydict({"s": pa.array(s)})

    return sample.repartition(64, "k").mapInArrow(each, "s double").agg(F.count("*").alias("cells"), F.round(F.avg("s"), 6).alias("silhouette"))


def _k_nearest(x: np.ndarray, kx: np.ndarray, y: np.ndarray, ky: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """src, dst, d2: the k nearest of y to each of x, ties by key, no vector of its own key and none at no finite distance.

    Products of matrices tell which can be among them; the distances of those are computed again from the differences.
    """
    out = [(kx[:0], ky[:0], np.zeros(0))]
    step = max(1, (1 << 21) // max(1, len(y)))
    qx, qy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    rough = bool(np.isfinite(qx).all() and np.isfinite(qy).all())
    piece = max(1, (1 << 21) // max(1, x.shape[1]))
    for s in range(0, len(x) if len(y) else 0, step):
        part, keys = x[s : s + step], kx[s : s + step]
        other = keys[:, None] != ky[None, :]
        if rough:
            d = qx[s : s + step, None] + qy[None, :] - 2 * (part @ y.T)
            d[~other] = np.inf
            slack = 2e-9 * (qx[s : s + step] + qy.max())
            farthest = np.partition(d, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1] + slack
            i, j = np.nonzero((d <= farthest[:, None]) & other)
        else:
            i, j = np.nonzero(other)
        exact = np.concatenate([((part[i[t : t + piece]] - y[j[t : t + piece]]) ** 2).sum(axis=1) for t in range(0, len(i), piece)] or [np.zeros(0)])
        yes = np.isfinite(exact)
        i, j, exact = i[yes], j[yes], exact[yes]
        order = np.lexsort((ky[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        n = np.bincount(i, minlength=len(part))
        first = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) < k
        out.append((keys[i[first]], ky[j[first]], exact[first]))
    src, dst, d2 = map(np.concatenate, zip(*out, strict=True))
    return src, dst, d2


def k_nearest_vectors(vectors: DataFrame, k: int, value: str = "embedding", key: str = "vec_id", block: int = 16384) -> DataFrame:
    """src, dst, rank: the k nearest other vectors of each (Euclidean, ties by key), exactly.

    Blocks of vectors meet in pairs of blocks, each pair in a task of its own, and keep k candidates for each row; work and
    rows dealt grow with the square, and with the square by `block`, of the number of vectors: for samples of cells, not for whole cohorts.
    """
    rows = keep(vectors.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("array<double>").alias("v")), "knn")
    count = rows.count()
    n = max(1, -(-count // block), min(6, -(-count // 1024)))  # some pairs of blocks for smaller tables as well
    at = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    left = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("own", "other", "k", "v", F.lit(False).alias("right"))
    right = at.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.col("first").alias("own"), F.col("own").alias("other"), "k", "v", F.lit(True).alias("right"))

    def nearest(table: pa.Table) -> pa.Table:
        keys, side = table["k"].to_numpy(), table["right"].to_numpy(zero_copy_only=False)
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        return pa.table(dict(zip(("src", "dst", "d2"), _k_nearest(x[~side], keys[~side], x[side], keys[side], k), strict=True)))

    met = left.unionByName(right).groupBy("own", "other").applyInArrow(nearest, "src long, dst long, d2 double")
    w = Window.partitionBy("src").orderBy("d2", "dst")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "rank")
