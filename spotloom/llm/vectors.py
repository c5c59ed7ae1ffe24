"""Near-duplicate embeddings by tiled comparison in order of principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.llm.links import by_group, components, connected, tiled
from spotloom.llm.shared import save

#: Cosines this near to the threshold are computed again from the vectors as they are given, up to powers of two.
_MARGIN = 1e-9


def usable(v: Column) -> Column:
    """Whether a vector can be compared: not null, no component null or not finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(v: np.ndarray) -> np.ndarray:
    """v times the power of two that brings its largest component below 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes (columns) by falling second moment of the unit vectors; each task sends one dim x dim matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch["v"]))
                total += u.T @ u
        row, col = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_pydict({"row": pa.array(row), "col": pa.array(col), "x": pa.array(total.ravel())})

    cells = vectors.select("v").mapInArrow(moments, "row long, col long, x double").groupBy("row", "col").agg(F.sum("x").alias("x")).collect()
    m = np.zeros((dim, dim))
    for c in cells:
        m[c["row"], c["col"]] = c["x"]
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


def _pairs_above(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, threshold: float, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b (unit vectors in the order of the axes) whose cosine reaches the threshold.

    The leading dimensions come first; what the rest can add is bounded by the product of the suffix norms, which stands
    as one more column of the product. Only pairs that can still reach the threshold are carried on.
    """
    tail = lambda m, k: np.sqrt((m[:, k:] ** 2).sum(axis=1))
    headed = lambda m: np.column_stack([m[:, :lead], tail(m, lead)])
    hb, found_i, found_j = headed(b).T.copy(), [], []
    for s in range(0, len(a), 512):
        part = a[s : s + 512]
        possible = headed(part) @ hb >= threshold - _MARGIN
        if possible.mean() > 0.05:
            cos = part @ b.T
            i, j = np.nonzero(cos >= threshold - _MARGIN)
            c = cos[i, j]
        else:
            i, j = np.nonzero(possible)
            c, k = np.einsum("nd,nd->n", part[i, :lead], b[j, :lead]), lead
            while k < a.shape[1] and len(i):
                end = min(2 * k, a.shape[1])
                c = c + np.einsum("nd,nd->n", part[i, k:end], b[j, k:end])
                on = c + tail(part, end)[i] * tail(b, end)[j] >= threshold - _MARGIN
                i, j, c, k = i[on], j[on], c[on], end
        i = i + s
        near = np.flatnonzero(np.abs(c - threshold) <= _MARGIN)
        ok = c >= threshold
        for n in near:
            x, y = _scaled(xa[i[n]]), _scaled(xb[j[n]])
            ok[n] = float(x @ y) / float(np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold
        found_i.append(i[ok])
        found_j.append(j[ok])
    return np.concatenate(found_i), np.concatenate(found_j)


def _dealt(axes: np.ndarray, width: float, reach: float, count: int) -> object:
    """A mapInArrow function that deals vectors (rep, c, dim, v) to cells of the leading `count` axes: dim, cell, upper, rep, c, v.

    Each vector is in its own cell, and a visitor (upper) in every later cell, in the order of their numbers, that lies no
    farther than `reach` from it. Two vectors no farther apart meet once: in their own cell, or in that of the later one.
    """
    radix = int(2 / width) + 3

    def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, gap, cell, later = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        for k in range(min(count, x.shape[1])):
            at = x[row, k] + 1
            own = np.floor(at / width)
            parts = []
            for step, near in ((0, np.zeros(len(at))), (-1, at - own * width), (1, (own + 1) * width - at)):
                on = np.flatnonzero((gap + near * near <= reach * reach) & (later if step < 0 else True))
                parts.append((row[on], gap[on] + near[on] ** 2, cell[on] * radix + own[on].astype(np.int64) + 1 + step, later[on] | (step > 0)))
            row, gap, cell, later = (np.concatenate(c) for c in zip(*parts, strict=True))
        return row, cell, later

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                dims = part["dim"].to_numpy()
                for dim in np.unique(dims).tolist():
                    some = part.take(pa.array(np.flatnonzero(dims == dim)))
                    u = _unit(_matrix(some["v"]))
                    row, cell, later = places(u @ axes if dim == len(axes) else u)
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": some["dim"].take(rows),
                            "cell": pa.array(cell),
                            "upper": pa.array(later),
                            "rep": some["rep"].take(rows),
                            "c": some["c"].take(rows),
                            "v": some["v"].take(rows),
                        }
                    )

    return each


def _compare(axes: np.ndarray, threshold: float, lead: int) -> object:
    """A kernel for rows dim, cell, ta, tb, tile, upper, rep, c, v -> for each vector with links: rep, links, a vector it is connected with."""

    def settle(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, ...]] = []
        rep, c = batch["rep"].to_numpy(), batch["c"].to_numpy()
        tile, ta = batch["tile"].to_numpy(), batch["ta"].to_numpy()
        tb, upper = batch["tb"].to_numpy(), batch["upper"].to_numpy(zero_copy_only=False)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x = _matrix(batch["v"].slice(lo, hi - lo))
            u = _unit(x)
            if u.shape[1] == len(axes):
                u = u @ axes
            left = np.flatnonzero(tile[lo:hi] == ta[lo])
            right = np.flatnonzero(tile[lo:hi] == tb[lo])
            if not len(left) or not len(right):
                continue
            i, j = _pairs_above(u[left], u[right], x[left], x[right], threshold, lead)
            i, j = left[i], right[j]
            # Two visitors meet elsewhere; a pair within one tile counts once.
            on = ~(upper[lo + i] & upper[lo + j]) & ((i < j) if ta[lo] == tb[lo] else True)
            i, j = i[on], j[on]
            links = np.zeros(hi - lo, np.int64)
            np.add.at(links, i, c[lo + j])
            np.add.at(links, j, c[lo + i])
            label = connected(hi - lo, i, j)
            some = np.flatnonzero(links)
            out.append((rep[lo + some], links[some], rep[lo + label[some]]))
        z = np.zeros(0, np.int64)
        cols = [np.concatenate(x) for x in zip(*out, (z, z, z), strict=False)] if out else [z, z, z]
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in zip(("rep", "links", "root"), cols, strict=True)})

    return by_group(["dim", "cell", "ta", "tb"], settle, chunk=1)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, lead: int = 16, per_tile: int = 16384) -> DataFrame:
    """Links between vectors with cosine >= threshold, in double precision, and their components.

    Identical vectors form one class and are compared once. Classes are dealt to cells along the leading principal axes,
    twice as wide as two linked unit vectors can lie apart; a vector also visits the later cells that a link of its own
    can reach. The number of axes grows with the logarithm of the number of classes, so that cells stay small, and the
    rows dealt with the number of classes; cells beyond per_tile rows are compared tile by tile. What cannot be avoided
    grows with the square: comparisons of different vectors that all lie close together.

    vectors has vec_id and embedding. Returns vec_id, n_links (other rows linked directly), component_id (least vec_id
    reachable, itself included), kept (vec_id = component_id); one row for each row. Vectors that are null, zero, or
    hold null or non-finite components link with nothing; so do rows without vec_id (component_id null, kept true).
    Vectors of different lengths never link; those of the commonest length are turned to their principal axes, others
    are compared as they are. Rows that share a vec_id are one vector with several places.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).withColumn("ok", usable(v) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    rows = rows.withColumn("key", F.xxhash64("embedding"))
    classes = save(
        rows.where("ok").groupBy("key", "embedding", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c")).withColumnRenamed("embedding", "v"), "vec-classes"
    )
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").head()
    dim = common["dim"] if common else 1
    axes = principal_axes(classes.where(F.col("dim") == dim), dim)
    reach = float(np.sqrt(2 - 2 * threshold) + 1e-9)
    count = int(np.clip(3 + np.ceil(np.log2(max(1, common["count"] if common else 1) / (1 << 17)) / 2), 3, 12))
    dealt = classes.select("rep", "c", "dim", "v").mapInArrow(_dealt(axes, max(2 * reach, 1e-3), reach, count), f"dim int, cell long, upper boolean, rep long, c long, v {classes.schema['v'].dataType.simpleString()}")
    grouped = save(dealt, "vec-dealt")
    sizes = grouped.groupBy("dim", "cell").agg(F.count("*").alias("members"), F.min("upper").alias("empty")).where("not empty").drop("empty")
    together = grouped.join(save(sizes, "vec-sizes"), ["dim", "cell"])
    dealt = tiled(together, F.col("members"), F.col("rep"), per_tile).drop("members")
    keys = ["dim", "cell", "ta", "tb"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(axes, threshold, lead), "rep long, links long, root long")
    found = save(found, "vec-links")
    counts = save(found.groupBy(F.col("rep").alias("cr")).agg(F.sum("links").alias("links")), "vec-counts")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select(F.col("key").alias("k"), F.col("v").alias("kv"), "rep", "c")
    named = named.join(counts, F.col("rep") == F.col("cr"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = save(named.select("k", "kv", F.coalesce("component", "rep").alias("component"), (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "vec-named")
    joined = rows.join(named, (F.col("key") == F.col("k")) & (F.col("embedding") == F.col("kv")) & F.col("ok"), "left")
    out = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
