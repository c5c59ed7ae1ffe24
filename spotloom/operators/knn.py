"""Nearest vectors by an index: trees of coarse cells, exact search within a cell, then neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.operators.tables import keep

_PAIRS = "src long, dst long, d2 double"


def coarse_cells(rows: DataFrame, most: int, seed: int, fan: int = 16) -> DataFrame:
    """rows(k, v) with cell: cells of at most about `most` rows, each split by the nearest of `fan` of its own rows until it is small.

    All rows pass once for each level, of which there are as many as the logarithm of the rows; pivots are drawn by a seeded
    digest, about four times `fan` for each cell that is still large. A cell of equal vectors is split by digest.
    """
    current = keep(rows.withColumn("cell", F.lit("")), "cells")
    for level in range(64):
        large = current.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = keep(large, "large-cells")
        if large.isEmpty():
            break
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "k"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * 4 * fan / F.col("n")
        drawn = current.join(large, "cell").where(draw).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("p"))
        pivots = keep(drawn.select("cell", F.slice(F.array_distinct(F.transform("p", lambda p: p["v"])), 1, fan).alias("pivots")), "pivots")
        apart = lambda p: F.aggregate(F.zip_with("v", p, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
        nearest = F.array_min(F.transform("pivots", lambda p, i: F.struct(apart(p).alias("d"), i.alias("i"))))["i"]
        by_digest = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), "k"), F.lit(fan)).cast("int")
        moved = current.join(pivots, "cell", "left")
        own = F.when(F.size("pivots") > 1, nearest).otherwise(by_digest)
        current = keep(moved.select("k", "v", F.when(F.col("pivots").isNull(), F.col("cell")).otherwise(F.concat("cell", F.hex(own), F.lit("."))).alias("cell")), "cells")
    return current


def _within(cells: DataFrame, k: int) -> DataFrame:
    """src, dst, d2: the k nearest others of each row in its own cell."""

    def nearest(table: pa.Table) -> pa.Table:
        keys = table["k"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)[order]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, (1 << 22) // max(1, x.size))
        for s in range(0, len(keys), step):
            d = ((x[s : s + step, None, :] - x[None, :, :]) ** 2).sum(axis=2)
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, best, axis=1)
            ok = np.isfinite(near)
            out.append((np.repeat(keys[s : s + step], ok.sum(axis=1)), keys[best][ok], near[ok]))
        return pa.table(dict(zip(("src", "dst", "d2"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return cells.select("cell", "k", "v").groupBy("cell").applyInArrow(nearest, _PAIRS)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """src, near: the k nearest (d2, dst) of each src among its candidates."""
    once = pairs.groupBy("src", "dst").agg(F.min("d2").alias("d2"))
    return once.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "dst"))), 1, k).alias("near"))


def _friends(near: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Better candidates among the neighbours, and the k nearest that have it as a neighbour, of each vector."""
    each = near.select("src", F.explode("near").alias("e")).select("src", "e.dst", "e.d2")
    back = each.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy("d2", "src"))).where(F.col("r") <= k)
    around = each.select(F.col("src").alias("at"), F.col("dst").alias("k")).unionByName(back.select(F.col("dst").alias("at"), F.col("src").alias("k"))).distinct()
    farthest = near.select(F.col("src").alias("k"), F.when(F.size("near") < k, float("inf")).otherwise(F.element_at("near", -1)["d2"]).alias("worst"))
    known = rows.join(farthest, "k", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
    groups = around.join(known, "k").groupBy("at").agg(F.collect_list(F.struct("k", "worst", "v")).alias("g"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch["g"]
            size, flat = groups.value_lengths().to_numpy(zero_copy_only=False), groups.flatten()
            if not len(flat):
                continue
            keys, worst = flat.field("k").to_numpy(), flat.field("worst").to_numpy()
            x = flat.field("v").flatten().to_numpy().reshape(len(keys), -1)
            first = np.concatenate([[0], np.cumsum(size)])
            step = max(1, (1 << 22) // max(1, int(size.max()) ** 2 * 8))
            for s in range(0, len(size), step):
                part = size[s : s + step]
                width = int(part.max())
                at = np.minimum(first[s : s + len(part), None] + np.arange(width), len(keys) - 1)
                real = np.arange(width) < part[:, None]
                y = x[at]
                q = (y * y).sum(axis=2)
                # Rough distances tell which pairs can count; those are computed again from the differences.
                d = q[:, :, None] + q[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
                slack = 1e-9 * (q[:, :, None] + q[:, None, :])
                hit = (d - slack < worst[at][:, :, None]) & real[:, :, None] & real[:, None, :] & (at[:, :, None] != at[:, None, :])
                b, i, j = np.nonzero(hit)
                i, j = at[b, i], at[b, j]
                exact = ((x[i] - x[j]) ** 2).sum(axis=1)
                yes = exact < worst[i]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i][yes]), pa.array(keys[j][yes]), pa.array(exact[yes])], ["src", "dst", "d2"])

    return groups.select("g").mapInArrow(kernel, _PAIRS)


def indexed_neighbours(vectors: DataFrame, k: int, value: str = "embedding", key: str = "vec_id", trees: int = 3, most: int = 1024, rounds: int = 3, seed: int = 1) -> DataFrame:
    """src, dst, rank, distance: about the k nearest other vectors of each (Euclidean, ties by key).

    Every vector stands in one cell of each of `trees` indexes and is compared with all of that cell; `rounds` times it then
    meets the neighbours of its neighbours. Work and rows dealt grow with the number of vectors. Tables of at most `most`
    vectors are searched exactly; embed.k_nearest_vectors is the exact way for samples of any size. Null vectors have no
    row; all others must have one length and finite components; keys are distinct.
    """
    rows = keep(vectors.where(F.col(value).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(value).cast("array<double>").alias("v")), "vectors")
    small = rows.limit(most + 1).count() <= most
    found = [_within(coarse_cells(rows, most, seed + 1000 * t), k) for t in range(1 if small else trees)]
    near = keep(_best(reduce(DataFrame.unionByName, found), k), "near")
    for _ in range(0 if small else rounds):
        old = near.select("src", F.explode("near").alias("e")).select("src", "e.dst", "e.d2")
        near = keep(_best(old.unionByName(_friends(near, rows, k)), k), "near")
    out = near.select("src", F.posexplode("near").alias("rank", "e"))
    return out.select("src", "e.dst", (F.col("rank") + 1).alias("rank"), F.sqrt("e.d2").alias("distance"))
