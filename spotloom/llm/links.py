"""Groups cut into tiles, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.llm.shared import drop_saved, save


def tiled(items: DataFrame, size: Column, item: Column, per_tile: int) -> DataFrame:
    """Deal the items of a group of `size` into tiles of about `per_tile`, and repeat each for every pair of tiles that
    its own is part of: columns tile (its own), ta <= tb (the pair). Any two items of a group meet in a pair of tiles;
    a group that fits one tile has one pair, (0, 0).
    """
    tiles = F.ceil(size / per_tile).cast("int")
    return (
        items.withColumn("tiles", tiles)
        .withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), item), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("ta", F.least("tile", "other").cast("int"))
        .withColumn("tb", F.greatest("tile", "other").cast("int"))
        .drop("tiles", "other")
    )


def by_group(keys: list[str], settle: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], chunk: int = 4 << 20) -> Callable:
    """A mapInArrow function for rows sorted by keys: settle(batch, bounds of its groups) gets whole groups, about
    `chunk` bytes of them."""

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            x = table[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < chunk:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            b = bounds(table)
            if len(b) > 2:
                yield settle(table.slice(0, int(b[-2])).combine_chunks().to_batches()[0], b[:-1])
                table = table.slice(int(b[-2])).combine_chunks()
            held, size = table.to_batches(), 0
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield settle(table.to_batches()[0], bounds(table))

    return each


def forest(linked: np.ndarray) -> np.ndarray:
    """For a square matrix of links, the least row number that each row is connected with."""
    n = len(linked)
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        least = np.where(reach, label[None, :], n).min(axis=1)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links i - j, the least node that each node is connected with."""
    label = np.arange(n)
    while len(i):
        least, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b), as node, component (the least node reachable); nodes without links are absent.

    Each round every node takes the least label around it, then the label of its label, until none changes: the number
    of rounds grows with the logarithm of a component's diameter. All state stays in tables.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = save(both.distinct(), "links-edges")
    labels = save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "links-labels")
    while True:
        told = edges.join(labels, edges.a == labels.node).select(F.col("b").alias("node"), "label")
        near = save(told.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "links-near")
        to = near.select(F.col("node").alias("at"), F.col("label").alias("further"))
        old = labels.select(F.col("node").alias("was"), F.col("label").alias("before"))
        far = near.join(to, near.label == to["at"]).join(old, near.node == old.was)
        new = save(far.select("node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("before")).alias("changed")), "links-labels")
        changed = new.where("changed").limit(1).count()
        drop_saved(near, labels)
        labels = new.drop("changed")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
