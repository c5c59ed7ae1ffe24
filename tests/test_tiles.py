"""Label grids by tiles against brute force on whole images."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.operators import tiles


def _image(seed, shape=(23, 31), labels=3, blank=0.25):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, labels, (shape[0] // 3 + 2, shape[1] // 3 + 2))
    img = np.kron(coarse, np.ones((3, 3), int))[: shape[0], : shape[1]] + 1
    noise = rng.random(shape) < 0.15
    img[noise] = rng.integers(1, labels + 1, noise.sum())
    img[rng.random(shape) < blank] = 0
    return img


def _table(spark, img, shift=(0, 0)):
    rows = [(int(r) + shift[0], int(c) + shift[1], int(img[r, c])) for r, c in zip(*np.nonzero(img))]
    return spark.createDataFrame(rows, "row long, col long, label int")


def _flood(mask, eight=False):
    """Number of its component for each pixel of a mask, in the order of their least pixels; -1 outside."""
    out, n = np.full(mask.shape, -1), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    for r, c in zip(*np.nonzero(mask)):
        if out[r, c] < 0:
            todo = [(r, c)]
            out[r, c] = n
            while todo:
                y, x = todo.pop()
                for a, b in steps:
                    v, w = y + a, x + b
                    if 0 <= v < mask.shape[0] and 0 <= w < mask.shape[1] and mask[v, w] and out[v, w] < 0:
                        out[v, w] = n
                        todo.append((v, w))
            n += 1
    return out


@pytest.mark.parametrize(("eight", "size"), [(False, 5), (True, 4), (False, 64)])
def test_components_and_outlines(spark, eight, size):
    img, shift = _image(1), (-7, 40)
    parts = tiles.components(_table(spark, img, shift), eight, size)
    at = parts.select("row", "col", "label", "component", tiles.pixel_row(F.col("component")).alias("r"), tiles.pixel_col(F.col("component")).alias("c")).collect()
    got = {(x["row"] - shift[0], x["col"] - shift[1]): (x["r"] - shift[0], x["c"] - shift[1]) for x in at}
    want = {}
    for label in (1, 2, 3):
        of = _flood(img == label, eight)
        for k in range(of.max() + 1):
            members = list(zip(*map(lambda v: v.tolist(), np.nonzero(of == k))))
            want |= dict.fromkeys(members, min(members))
    assert got == want
    rings = tiles.outlines(parts, eight, size).collect()
    count, area = collections.Counter(want.values()), collections.Counter()
    name = {x["component"]: (x["r"] - shift[0], x["c"] - shift[1]) for x in at}
    for r in rings:
        n = len(r["xs"])
        x, y = np.array(r["xs"]), np.array(r["ys"])
        dx, dy = np.roll(x, -1) - x, np.roll(y, -1) - y
        assert n >= 4 and ((dx == 0) ^ (dy == 0)).all() and ((dx == 0) != (np.roll(dx, 1) == 0)).all()  # corners only
        assert r["area"] == (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2 and r["hole"] == (r["area"] < 0)
        area[name[r["component"]]] += r["area"]
    assert area == count
    for own, n in collections.Counter(name[r["component"]] for r in rings).items():
        mask = np.zeros((img.shape[0] + 2, img.shape[1] + 2), bool)
        for r, c in (k for k, v in want.items() if v == own):
            mask[r + 1, c + 1] = True
        assert n == _flood(~mask, not eight).max() + 1  # the outside and the holes
    assert {r["component"] for r in rings if r["ring"] == 0 and not r["hole"]} == set(name)


def _specks(img, least):
    kept = np.zeros_like(img)
    for label in np.unique(img[img > 0]):
        of = _flood(img == label)
        for k in range(of.max() + 1):
            if (of == k).sum() >= least:
                kept[of == k] = label
    out = {(r, c): int(kept[r, c]) for r, c in zip(*np.nonzero(kept))}
    for label in sorted(np.unique(kept[kept > 0]), reverse=True):
        of = _flood(kept != label)
        for k in range(of.max() + 1):
            if (of == k).sum() < least:
                for r, c in zip(*np.nonzero(of == k)):
                    out[r, c] = min(out.get((r, c), 99), int(label))
    return {(int(r), int(c)): v for (r, c), v in out.items()}


@pytest.mark.parametrize(("seed", "least", "size"), [(2, 4, 6), (3, 9, 64)])
def test_specks(spark, seed, least, size):
    img = _image(seed)
    img[0, 0] = img[-1, -1] = 1  # the image's corners are pixels of it
    got = {(r["row"], r["col"]): r["label"] for r in tiles.without_specks(_table(spark, img), least, size).collect()}
    assert got == _specks(img, least)


def _holes(img, most):
    best = {}
    for label in np.unique(img[img > 0]):
        of = _flood(img != label)
        for k in range(of.max() + 1):
            hole = of == k
            r, c = np.nonzero(hole)
            if hole.sum() > most or r.min() == 0 or c.min() == 0 or r.max() == img.shape[0] - 1 or c.max() == img.shape[1] - 1:
                continue
            rim = np.zeros_like(hole)
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    rim[r + a, c + b] = True
            values, n = np.unique(img[rim & ~hole & (img > 0)], return_counts=True)
            if values[np.argmax(n)] == label:
                for p in zip(r.tolist(), c.tolist()):
                    best[p] = min(best.get(p, (0, 0)), (-len(r), int(label)))
    out = {(int(r), int(c)): int(img[r, c]) for r, c in zip(*np.nonzero(img))}
    return out | {p: v[1] for p, v in best.items()}


@pytest.mark.parametrize(("seed", "most", "size"), [(4, 6, 7), (5, 60, 64)])
def test_holes(spark, seed, most, size):
    img = _image(seed, labels=2, blank=0.1)
    img[4:13, 5:16] = 1
    img[6:11, 7:14] = 2
    img[8, 9:11] = 1  # a hole within a hole
    img[9, 11] = 0
    img[0, 0] = img[-1, -1] = 1
    got = {(r["row"], r["col"]): r["label"] for r in tiles.relabel_holes(_table(spark, img), most, size).collect()}
    assert got == _holes(img, most)


@pytest.mark.parametrize("size", [5, 64])
def test_growth(spark, size):
    img = _image(6, labels=2, blank=0.3)
    rng = np.random.default_rng(0)
    nuclei = [(100 + i, int(rng.integers(0, img.shape[0])), int(rng.integers(0, img.shape[1]))) for i in range(25)] + [(3, 2, 2), (9, 2, 2)]
    parts = tiles.components(_table(spark, img), size=size)
    seeds = spark.createDataFrame(nuclei, "seed long, row long, col long")
    got = {(r["row"], r["col"]): (r["steps"], r["seed"]) for r in tiles.grown(parts, seeds, size).collect()}
    want, todo = {}, collections.deque()
    for s, r, c in sorted(nuclei):
        if img[r, c] and (r, c) not in want:
            want[r, c] = (0, s)
    front = dict(want)
    while front:
        new = {}
        for (r, c), (d, s) in front.items():
            for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                p = (r + a, c + b)
                if 0 <= p[0] < img.shape[0] and 0 <= p[1] < img.shape[1] and img[p] == img[r, c] and p not in want:
                    new[p] = min(new.get(p, (d + 1, s)), (d + 1, s))
        want |= new
        front = new
    assert {k: v for k, v in got.items() if v[1] is not None} == want and len(got) == (img > 0).sum()
    cells = tiles.split_cells(_table(spark, img), spark.createDataFrame([(s, c + 0.5, r + 0.5) for s, r, c in nuclei], "seed long, x double, y double"), 1.0, size=size).collect()
    assert sum(r["pixels"] for r in cells) == (img > 0).sum() and sum(r["n_nuclei"] for r in cells) == len({s for _, s in want.values()})
    with pytest.raises(ValueError):
        tiles.split_cells(_table(spark, img), spark.createDataFrame([(1, 1e6, 1.0), (2, 1.0, 1.0), (3, -1e6, 0.0)], "seed long, x double, y double"), 1.0, size=size)


def test_nothing(spark):
    none = _table(spark, np.zeros((2, 2), int))
    parts = tiles.components(none)
    assert parts.count() == 0 and tiles.outlines(parts).count() == 0 and tiles.without_specks(none, 3).count() == 0 and tiles.relabel_holes(none, 3).count() == 0
    assert tiles.grown(parts, none.withColumnRenamed("label", "seed")).count() == 0
