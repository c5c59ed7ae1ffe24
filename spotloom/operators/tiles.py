"""Label grids by tiles: components, enclosed regions, outlines and seeded growth.

A tile is worked through by itself in one Arrow kernel; only what crosses its border goes on to joins. A component is
named by the number of its least pixel (row, then column), see pixel().
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spotloom.operators.tables import keep

#: Pixels along the side of a tile.
SIZE = 512
_SHIFT = 1 << 30
_FOUR, _EIGHT = ((0, 1), (1, 0)), ((0, 1), (1, 0), (1, 1), (1, -1))


def pixel(row: Column, col: Column) -> Column:
    """The number of a pixel; numbers ascend by row, then by column. Rows and columns lie within 2 ** 30 of 0."""
    return F.shiftleft(row.cast("long"), 31) + col.cast("long") + _SHIFT


def pixel_row(n: Column) -> Column:
    return F.shiftright(n, 31)


def pixel_col(n: Column) -> Column:
    return n - F.shiftleft(F.shiftright(n, 31), 31) - _SHIFT


def _tile(row: str, col: str, size: int) -> list[Column]:
    return [F.floor(F.col(row) / size).alias("__tr"), F.floor(F.col(col) / size).alias("__tc")]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 the least one that edges a - b lead to: hooking to the lesser root, then jumping to roots."""
    p = np.arange(n)
    while True:
        ra, rb = p[a], p[b]
        open_ = ra != rb
        if not open_.any():
            return p
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(q := p[p], p):
            p = q


def _codes(column: pa.ChunkedArray, nulls_join: bool) -> np.ndarray:
    """Equal values as equal numbers; nulls as -1, or each by a number of its own below that."""
    c = column.combine_chunks().dictionary_encode().indices
    out = c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if not nulls_join:
        out[out < 0] = -2 - np.arange(int((out < 0).sum()))
    return out


def components(grid: DataFrame, eight: bool = False, size: int = SIZE, nulls_join: bool = False) -> DataFrame:
    """grid(row, col, label, ...) with component: neighbours (4 or 8) of one label belong together; a pixel without label is
    alone or, with nulls_join, belongs to its neighbours without one. Each pixel stands once.

    Tiles label their pixels, pairs of labels that meet across a border go to label rounds, whose number grows with the
    logarithm of the tiles that a component crosses, and each tile's labels are looked up in their result.
    """
    from spotloom.operators import graph

    known = keep(grid.withColumns({"__tr": _tile("row", "col", size)[0], "__tc": _tile("row", "col", size)[1]}), "tile-pixels")
    schema = StructType([*known.schema.fields, StructField("__part", LongType())])

    def kernel(table: pa.Table) -> pa.Table:
        row, col, code = table["row"].to_numpy().astype(np.int64), table["col"].to_numpy().astype(np.int64), _codes(table["label"], nulls_join)
        at = np.full((size + 2, size + 2), -1)
        r, c = row - row.min() // size * size + 1, col - col.min() // size * size + 1
        order = np.lexsort((col, row))
        place = np.empty(len(row), np.int64)
        place[order] = np.arange(len(row))
        at[r, c] = place
        code, a, b = code[order], [], []
        for dr, dc in _EIGHT if eight else _FOUR:
            other = at[r + dr, c + dc]
            ok = other >= 0
            x, y = place[ok], other[ok]
            same = code[x] == code[y]
            a.append(x[same])
            b.append(y[same])
        least = order[least_labels(len(row), np.concatenate(a), np.concatenate(b))][place]
        number = (row[least] << 31) + col[least] + _SHIFT
        return table.append_column("__part", pa.array(number))

    parts = keep(known.groupBy("__tr", "__tc").applyInArrow(kernel, schema), "tile-parts")
    rim = (F.pmod("row", F.lit(size)).isin(0, size - 1)) | (F.pmod("col", F.lit(size)).isin(0, size - 1))
    edge = parts.where(rim).select("row", "col", "label", "__part", "__tr", "__tc")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (_EIGHT if eight else _FOUR)])
    out = edge.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), F.col("label").alias("__l"), F.col("__part").alias("a"), F.col("__tr").alias("__or"), F.col("__tc").alias("__oc"))
    met = out.join(edge, ["row", "col"]).where((F.col("__l").eqNullSafe(F.col("label")) if nulls_join else F.col("__l") == F.col("label")) & ((F.col("__or") != F.col("__tr")) | (F.col("__oc") != F.col("__tc"))))
    pairs = keep(met.select("a", F.col("__part").alias("b")).distinct(), "tile-pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    joined = graph.components(nodes, pairs).select(F.col("node").alias("__part"), F.col("component").alias("__of"))
    # At most a tile's pixels have one label of it, so that no key is common.
    return parts.join(joined, "__part", "left").select(*grid.columns, F.coalesce("__of", "__part").alias("component"))


def filled(grid: DataFrame, size: int = SIZE) -> DataFrame:
    """row, col, label of every pixel of the image (the box of grid's pixels): null where grid has none. Rows are made tile by tile."""
    box = grid.agg(*[f(c).cast("long").alias(f"{k}{c}") for c in ("row", "col") for k, f in (("lo_", F.min), ("hi_", F.max))]).where("lo_row is not null")
    cuts = lambda c: F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / size), F.floor(F.col(f"hi_{c}") / size)))
    every = box.withColumn("__tr", cuts("row")).withColumn("__tc", cuts("col")).repartition("__tr", "__tc")
    span = lambda c, t: F.explode(F.sequence(F.greatest(F.col(f"lo_{c}"), F.col(t) * size), F.least(F.col(f"hi_{c}"), F.col(t) * size + size - 1)))
    every = every.withColumn("row", span("row", "__tr")).withColumn("col", span("col", "__tc")).select("row", "col")
    return every.join(grid.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "label"), ["row", "col"], "left")


def regions(grid: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the whole image: pixels(row, col, label, component), regions(component, label, pixels, rim: whether one of its pixels
    is on the image's rim) and touching(a, b: neighbours of four, in both directions). Pixels without label are the
    background, whose parts are regions with a null label."""
    pixels = keep(components(filled(grid, size), size=size, nulls_join=True), "regions")
    box = pixels.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))  # one row
    rim = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    known = pixels.crossJoin(F.broadcast(box)).groupBy("component").agg(F.first("label").alias("label"), F.count("*").alias("pixels"), F.bool_or(rim).alias("rim"))
    tr, tc = _tile("row", "col", size)
    # A tile sees its own pixels and the first row and column behind it, so that every pair of neighbours meets once.
    ahead = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = pixels.select("row", "col", "component", tr, tc).withColumn("s", F.explode(ahead))
    seen = seen.where((F.col("s.a") == 0) | (F.pmod("row", F.lit(size)) == 0)).where((F.col("s.b") == 0) | (F.pmod("col", F.lit(size)) == 0))
    seen = seen.select("row", "col", "component", (F.col("__tr") - F.col("s.a")).alias("__tr"), (F.col("__tc") - F.col("s.b")).alias("__tc"))

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        row, col = table["row"].to_numpy() - key[0].as_py() * size, table["col"].to_numpy() - key[1].as_py() * size
        names, code = np.unique(table["component"].to_numpy(), return_inverse=True)
        at = np.full((size + 1, size + 1), -1)
        at[row, col] = code
        pairs = np.concatenate([np.stack([x.ravel(), y.ravel()]) for x, y in ((at[:size, :size], at[:size, 1:]), (at[:size, :size], at[1:, :size]))], axis=1)
        pairs = pairs[:, (pairs[0] != pairs[1]) & (pairs >= 0).all(axis=0)]
        pairs = np.unique(np.concatenate([pairs, pairs[::-1]], axis=1), axis=1)
        return pa.table({"a": names[pairs[0]], "b": names[pairs[1]]})

    touching = seen.groupBy("__tr", "__tc").applyInArrow(kernel, "a long, b long").distinct()
    return pixels, keep(known, "region-sizes"), keep(touching, "touching")


def enclosed(known: DataFrame, touching: DataFrame, most: int, at_rim: bool) -> DataFrame:
    """component, of, hole: the regions of every set of at most `most` neighbouring pixels that are not of label `of` while
    all around them are (and, unless at_rim, none on the image's rim). hole is the least region of the set.

    Such a set consists of small regions. A region is asked for the labels around the small regions that it hangs together
    with, not for all labels, and never by pixel; sets of one label are components of regions, cut where a larger region of another label touches them.
    """
    from spotloom.operators import graph

    small = known.where(F.col("pixels") <= most)
    tell = lambda d, s: d.select(F.col("component").alias(s), F.col("label").alias(f"l{s}"), F.col("pixels").alias(f"n{s}"))
    side = keep(touching.join(tell(small, "a"), "a").join(tell(known, "b"), "b"), "sides")
    inner = side.where(F.col("nb") <= most).select("a", "b")
    cluster = keep(graph.components(small.select(F.col("component").alias("node")), inner), "clusters")
    around = side.select("a", F.col("lb").alias("of")).unionByName(small.select(F.col("component").alias("a"), F.col("label").alias("of"))).where("of is not null")
    around = around.join(cluster.withColumnRenamed("node", "a"), "a").select("component", "of").distinct()
    asked = cluster.join(around, "component").select(F.col("node").alias("a"), "of")
    own = small.select(F.col("component").alias("a"), F.col("label").alias("la"), "pixels", "rim")
    asked = keep(asked.join(own, "a").where(~F.col("la").eqNullSafe(F.col("of"))), "asked")
    spoiled = side.where(F.col("nb") > most).select("a", F.col("lb").alias("__l")).join(asked.select("a", "of"), "a").where(~F.col("__l").eqNullSafe(F.col("of"))).select("a", "of").distinct().withColumn("bad", F.lit(True))
    node = lambda c: F.struct("of", F.col(c).alias("c"))
    ends = inner.join(asked.select("a", "of"), "a").join(asked.select(F.col("a").alias("b"), F.col("of").alias("__o")), "b").where("of = __o")
    found = graph.components(asked.select(F.struct("of", F.col("a").alias("c")).alias("node")), ends.select(node("a").alias("a"), node("b").alias("b")))
    found = found.select(F.col("node.c").alias("a"), F.col("node.of").alias("of"), F.col("component.c").alias("hole"))
    each = keep(found.join(asked.select("a", "of", "pixels", "rim"), ["a", "of"]).join(spoiled, ["a", "of"], "left"), "holes")
    spoil = F.coalesce("bad", F.lit(False)) if at_rim else F.coalesce("bad", F.lit(False)) | F.col("rim")
    good = each.groupBy("of", "hole").agg(F.sum("pixels").alias("n"), F.bool_or(spoil).alias("bad")).where(~F.col("bad") & (F.col("n") <= most))
    return each.join(good.select("of", "hole"), ["of", "hole"]).select(F.col("a").alias("component"), "of", "hole")


def without_specks(grid: DataFrame, least: int, size: int = SIZE) -> DataFrame:
    """row, col, label of grid(row, col, label): segments below `least` pixels go, and holes below that, which lie within
    one label, are filled with it.

    Segments and holes join four neighbours. A hole of a label is a set of neighbouring pixels of the image (the box of grid's
    pixels) that are not the label's own; it may lie on the image's rim. Where two labels claim a pixel, the smaller one has it.
    """
    box = grid.agg(*[f(c).alias(f"{k}{c}") for c in ("row", "col") for k, f in (("lo_", F.min), ("hi_", F.max))]).where("lo_row is not null")
    first = keep(components(grid, size=size), "specks")
    large = first.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = keep(first.join(large, "component").select("row", "col", "label"), "kept")
    # The image stays as large as it was: its corners stand for it.
    label = grid.schema["label"].dataType
    corner = lambda r, c: box.select(F.col(r).alias("row"), F.col(c).alias("col"), F.lit(None).cast(label).alias("label"))
    corners = corner("lo_row", "lo_col").unionByName(corner("hi_row", "hi_col"))
    framed = kept.unionByName(corners.select(*kept.columns)).groupBy("row", "col").agg(F.max("label").alias("label"))
    pixels, known, touching = regions(framed, size)
    holes = pixels.select("row", "col", "component").join(enclosed(known, touching, least - 1, True).select("component", "of"), "component").select("row", "col", F.col("of").alias("label"))
    both = kept.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "label").unionByName(holes)
    return both.groupBy("row", "col").agg(F.min("label").alias("label"))


def relabel_holes(grid: DataFrame, most: int, size: int = SIZE) -> DataFrame:
    """row, col, label of grid: holes of at most `most` pixels take the label that encloses them where that is also the most
    frequent one (least among equals) of the labelled pixels around the hole, of eight neighbours, each counted once.

    A hole of a label is a set of four-neighbouring pixels, of other labels or none, that does not reach the image's rim. All holes
    are judged on the input at once; a pixel in holes of several labels takes the label of the largest hole, the least label
    among equals.
    """
    pixels, known, touching = regions(grid, size)
    at = keep(enclosed(known, touching, most, False), "enclosed")
    inside = keep(pixels.select("row", "col", "component").join(at, "component").select("row", "col", "of", "hole"), "hole-pixels")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    rim = inside.withColumn("s", F.explode(steps)).select("of", "hole", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col")).distinct()
    rim = rim.join(inside, ["of", "hole", "row", "col"], "left_anti").join(pixels.where("label is not null").select("row", "col", "label"), ["row", "col"])
    votes = rim.groupBy("of", "hole", "label").agg(F.count("*").alias("n")).groupBy("of", "hole").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("v"))
    won = votes.where(F.col("v.label") == F.col("of")).select("of", "hole")
    sized = inside.join(won, ["of", "hole"]).join(inside.groupBy("of", "hole").agg(F.count("*").alias("n")), ["of", "hole"])
    new = sized.groupBy("row", "col").agg(F.min(F.struct((-F.col("n")).alias("n"), "of")).alias("m")).select("row", "col", F.col("m.of").alias("__new"))
    out = pixels.select("row", "col", "label").join(new, ["row", "col"], "left")
    return out.select("row", "col", F.coalesce("__new", "label").alias("label")).where("label is not null")


# Sides of a pixel: 0 top, 1 right, 2 bottom, 3 left, walked with the pixel on the right hand. Steps to the pixel beyond
# the side, to the one ahead, and to the one ahead and beyond; and where the side begins.
_BEYOND = ((-1, 0), (0, 1), (1, 0), (0, -1))
_AHEAD = ((0, 1), (1, 0), (0, -1), (-1, 0))
_BEGIN = ((0, 0), (0, 1), (1, 1), (1, 0))


def _ranked(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last item and distance to it of each item of lists given by the next item (-1 at the end), by doubling."""
    n = len(nxt)
    jump, last, far = np.append(np.where(nxt < 0, n, nxt), n), np.arange(n + 1), np.zeros(n + 1, np.int64)
    on = jump < n
    far[on] = 1
    last[on] = jump[on]
    while (jump < n).any():
        on = np.flatnonzero(jump < n)
        to = jump[on]
        last[on], far[on], jump[on] = last[to], far[on] + far[to], jump[to]
    return last[:n], far[:n]


def _chains(table: pa.Table, tr: int, tc: int, size: int, eight: bool) -> pa.Table:
    """Sides of a tile's pixels in the order in which outlines pass them: one row for each stretch within the tile."""
    row, col = table["row"].to_numpy() - tr * size + 1, table["col"].to_numpy() - tc * size + 1
    names, code = np.unique(table["component"].to_numpy(), return_inverse=True)
    at = np.full((size + 2, size + 2), -1)
    at[row, col] = code
    r, c = (x + 1 for x in np.nonzero(at[1:-1, 1:-1] >= 0))
    own, sides = at[r, c], []
    for d in range(4):
        open_ = at[r + _BEYOND[d][0], c + _BEYOND[d][1]] != own
        y, x, o = r[open_], c[open_], own[open_]
        ay, ax = y + _AHEAD[d][0], x + _AHEAD[d][1]
        by, bx = ay + _BEYOND[d][0], ax + _BEYOND[d][1]
        ahead, beyond = at[ay, ax] == o, at[by, bx] == o
        left = beyond & (ahead | eight)
        right = ~left & ~ahead
        ny, nx = np.where(left, by, np.where(right, y, ay)), np.where(left, bx, np.where(right, x, ax))
        nd = np.where(left, (d + 3) % 4, np.where(right, (d + 1) % 4, d))
        sides.append(np.stack([y, x, np.full(len(y), d), ny, nx, nd, o]))
    y, x, d, ny, nx, nd, o = np.concatenate(sides, axis=1)
    local = lambda y, x, d: (y * (size + 2) + x) * 4 + d
    number = lambda y, x, d: (((y + tr * size - 1) << 31) + x + tc * size - 1 + _SHIFT) * 4 + d
    key = local(y, x, d)
    order = np.argsort(key)
    y, x, d, ny, nx, nd, o, key = (v[order] for v in (y, x, d, ny, nx, nd, o, key))
    stays = (ny >= 1) & (ny <= size) & (nx >= 1) & (nx <= size)
    nxt = np.where(stays, np.searchsorted(key, local(ny, nx, nd)), -1)
    # Outlines that never leave the tile are cut at their least side.
    n = len(key)
    least, jump = np.arange(n), np.where(nxt < 0, np.arange(n), nxt)
    ends = nxt < 0
    open_ = ends.copy()
    for _ in range(max(1, int(n).bit_length())):
        least, open_ = np.minimum(least, least[jump]), open_ | open_[jump]
        jump = jump[jump]
    cut = ~open_ & (nxt >= 0) & (nxt == least)
    nxt = np.where(cut, -1, nxt)
    last, far = _ranked(nxt)
    order = np.lexsort((-far, last))
    heads = np.append(True, last[order][1:] != last[order][:-1]) if n else np.zeros(0, bool)
    turn = heads.copy()
    turn[1:] |= d[order][1:] != d[order][:-1]
    begin = np.array(_BEGIN)
    vy, vx = y[order] + begin[d[order], 0] + tr * size - 1, x[order] + begin[d[order], 1] + tc * size - 1
    first = np.flatnonzero(heads)
    tail = last[order][first]
    points = np.flatnonzero(turn)
    offsets = np.append(np.searchsorted(points, first), len(points)).astype(np.int32)
    listed = lambda v: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[points].astype(np.int64)))
    h = order[first]
    return pa.table({"head": number(y[h], x[h], d[h]), "next": number(ny[tail], nx[tail], nd[tail]), "component": names[o[h]] if n else np.zeros(0, np.int64), "ys": listed(vy), "xs": listed(vx)})


def outlines(parts: DataFrame, eight: bool = False, size: int = SIZE) -> DataFrame:
    """component, ring (0 the outer one), hole, xs, ys, area of components(row, col, component): the corners of each ring,
    outer rings with positive and holes with negative area, from the corner of the least pixel that they pass on.

    Where four sides meet, a ring of four-neighbouring components turns around its own pixel, one of eight-neighbouring ones
    goes over to the pixel across. Stretches within a tile are joined there; across tiles, rings are found and their
    stretches numbered by pointer doubling, in as many rounds as the logarithm of the tiles that a ring passes.
    """
    tr, tc = _tile("row", "col", size)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    seen = parts.select("row", "col", "component", tr, tc).withColumn("s", F.explode(around))
    low = lambda c: F.pmod(c, F.lit(size)) == 0
    high = lambda c: F.pmod(c, F.lit(size)) == size - 1
    for c, s in (("row", "s.a"), ("col", "s.b")):
        seen = seen.where((F.col(s) == 0) | ((F.col(s) == -1) & low(c)) | ((F.col(s) == 1) & high(c)))
    seen = seen.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "component", (F.col("__tr") + F.col("s.a")).alias("__tr"), (F.col("__tc") + F.col("s.b")).alias("__tc"))
    kernel = lambda key, table: _chains(table, key[0].as_py(), key[1].as_py(), size, eight)
    chains = keep(seen.groupBy("__tr", "__tc").applyInArrow(kernel, "head long, next long, component long, ys array<long>, xs array<long>"), "chains")
    closed = chains.where("head = next").select("component", F.col("head").alias("ring"), F.lit(0).cast("long").alias("left"), "xs", "ys")
    open_ = chains.where("head <> next")
    # Ring of each stretch: the least head on it.
    cur = keep(open_.select("head", F.col("next").alias("jump"), F.least("head", "next").alias("least")), "rings")
    while not cur.isEmpty():
        to = cur.select(F.col("head").alias("jump"), F.col("jump").alias("__j"), F.col("least").alias("__l"))
        new = cur.join(to, "jump").select("head", F.col("__j").alias("jump"), F.least("least", "__l").alias("least"), (F.col("__l") < F.col("least")).alias("moved"))
        new = keep(new, "rings")
        moved = new.where("moved").limit(1).count()
        cur = new.drop("moved")
        if not moved:
            break
    # Stretches to come up to the ring's end, which lies before its least head.
    start = open_.select("head", "next").join(cur.select("head", F.col("least").alias("ring")), "head")
    pos = keep(start.select("head", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("jump"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("long").alias("left")), "ranks")
    while pos.where("jump is not null").limit(1).count():
        to = pos.select(F.col("head").alias("jump"), F.col("jump").alias("__j"), F.col("left").alias("__n"))
        pos = keep(pos.join(to, "jump", "left").select("head", "ring", F.col("__j").alias("jump"), (F.col("left") + F.coalesce("__n", F.lit(0))).alias("left")), "ranks")
    crossing = open_.join(pos.select("head", "ring", "left"), "head").select("component", "ring", "left", "xs", "ys")
    each = closed.unionByName(crossing).groupBy("component", "ring").agg(F.sort_array(F.collect_list(F.struct("left", "xs", "ys")), asc=False).alias("p"))
    each = each.select("component", "ring", F.flatten(F.col("p.xs")).alias("xs"), F.flatten(F.col("p.ys")).alias("ys"))
    n = F.size("xs")
    get = lambda c, i: F.get(c, F.pmod(i, n).cast("int"))
    turns = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~(((get("xs", i - 1) == get("xs", i)) & (get("xs", i) == get("xs", i + 1))) | ((get("ys", i - 1) == get("ys", i)) & (get("ys", i) == get("ys", i + 1)))))
    at = lambda c: F.transform("t", lambda i: F.get(c, i).cast("double")).alias(c)
    each = each.withColumn("t", turns).select("component", "ring", at("xs"), at("ys"))
    from pyspark.sql import Window

    from spotloom.functions import geometry

    out = each.withColumn("area", geometry.signed_area(F.col("xs"), F.col("ys"))).withColumn("hole", F.col("area") < 0)
    order = Window.partitionBy("component").orderBy("hole", "ring")
    return out.withColumn("ring", F.row_number().over(order) - 1).select("component", "ring", "hole", "xs", "ys", "area")


def grown(parts: DataFrame, seeds: DataFrame, size: int = SIZE) -> DataFrame:
    """row, col, label, component, seed, steps of parts(row, col, label, component) and seeds(row, col, seed: whole numbers): within a
    component each pixel takes the seed that is fewest steps (of four neighbours) away, the least among equals; null without a seed.

    Every tile is searched to the end from its seeds and from what its neighbours reached on their side of its border; rounds
    go on while a border still brings a tile something nearer, so they grow with the tiles that a path crosses. Tiles
    that nothing new reaches are left as they are.
    """
    tr, tc = _tile("row", "col", size)
    far = 1 << 60
    at = seeds.groupBy("row", "col").agg(F.min("seed").cast("long").alias("seed"))
    base = parts.select("row", "col", "label", "component").join(at, ["row", "col"], "left")
    base = base.withColumn("steps", F.when(F.col("seed").isNotNull(), F.lit(0).cast("long"))).withColumns({"__tr": tr, "__tc": tc})
    base = base.select("__tr", "__tc", "row", "col", "label", "component", "seed", "steps")
    schema = base.schema

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        r, c = (table[k].to_numpy().astype(np.int64) - key[i].as_py() * size + 1 for i, k in enumerate(("row", "col")))
        code = np.unique(table["component"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        at, steps, seed = np.full((size + 2, size + 2), -1), np.full((size + 2, size + 2), far), np.full((size + 2, size + 2), far)
        at[r, c] = code
        had = table["seed"].is_valid().to_numpy()
        steps[r[had], c[had]], seed[r[had], c[had]] = table["steps"].to_numpy()[had], table["seed"].to_numpy()[had]
        # Breadth first: all pixels of one distance at a time, from the nearest on.
        d, top = 0, int(steps[steps < far].max()) if had.any() else -1
        while d <= top:
            y, x = np.nonzero(steps == d) if d == 0 or (steps == d).any() else (np.zeros(0, int), np.zeros(0, int))
            for dr, dc in _BEYOND:
                ny, nx = y + dr, x + dc
                ok = (at[ny, nx] == at[y, x]) & ((steps[ny, nx] > d + 1) | ((steps[ny, nx] == d + 1) & (seed[ny, nx] > seed[y, x])))
                ny, nx, s = ny[ok], nx[ok], seed[y[ok], x[ok]]
                newer = steps[ny, nx] > d + 1
                seed[ny[newer], nx[newer]] = far
                steps[ny, nx] = d + 1
                np.minimum.at(seed, (ny, nx), s)
                top = max(top, d + 1) if len(ny) else top
            d += 1
        s, t = seed[r, c], steps[r, c]
        out = table.set_column(table.schema.get_field_index("seed"), "seed", pa.array(s, mask=s == far))
        return out.set_column(out.schema.get_field_index("steps"), "steps", pa.array(t, mask=t == far))

    state = keep(base.groupBy("__tr", "__tc").applyInArrow(kernel, schema), "grown")
    rim = (F.pmod("row", F.lit(size)).isin(0, size - 1)) | (F.pmod("col", F.lit(size)).isin(0, size - 1))
    way = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _BEYOND])
    while True:
        edge = state.where(rim)
        told = edge.where("seed is not null").withColumn("s", F.explode(way)).select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), "component", F.struct((F.col("steps") + 1).alias("steps"), "seed").alias("m"))
        best = told.groupBy("row", "col", "component").agg(F.min("m").alias("m"))
        near = edge.join(best, ["row", "col", "component"]).where(F.col("steps").isNull() | (F.struct("steps", "seed") > F.col("m")))
        near = keep(near.select("__tr", "__tc", "row", "col", F.col("m.steps").alias("__t"), F.col("m.seed").alias("__s")), "nearer")
        if near.isEmpty():
            break
        tiles = near.select("__tr", "__tc").distinct().withColumn("__on", F.lit(True))
        told = state.join(near.drop("__tr", "__tc"), ["row", "col"], "left").join(tiles, ["__tr", "__tc"], "left")
        fresh = told.where("__on").withColumns({"steps": F.coalesce("__t", "steps"), "seed": F.coalesce("__s", "seed")}).select(*state.columns)
        rest = told.where("__on is null").select(*state.columns)
        state = keep(fresh.groupBy("__tr", "__tc").applyInArrow(kernel, schema).unionByName(rest), "grown")
    return state.select("row", "col", "label", "component", "seed", "steps")


def split_by_seeds(parts: DataFrame, seeds: DataFrame, size: int = SIZE) -> DataFrame:
    """row, col, label, component, seed of grown(): see there."""
    return grown(parts, seeds, size).drop("steps")


def split_cells(grid: DataFrame, nuclei: DataFrame, pitch: float, offset: tuple[float, float] = (0.0, 0.0), frame: float = 0.5, size: int = SIZE) -> DataFrame:
    """cell, seed, label, n_nuclei, pixels, area: segments of grid(row, col, label) split by nuclei(seed, x, y).

    A nucleus counts where its pixel is in the image and has a label; a segment without one stays whole, with n_nuclei 0
    and a null seed. Of several nuclei on one pixel the least has it. cell is the least pixel. Where less than `frame` of the nuclei lie in
    the image (the box of grid's pixels), frames of reference differ and a ValueError is raised.
    """
    at = keep(nuclei.select("seed", F.floor((F.col("y") - offset[1]) / pitch).alias("row"), F.floor((F.col("x") - offset[0]) / pitch).alias("col")), "nuclei")
    box = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))  # one row
    told = at.crossJoin(F.broadcast(box)).agg(F.count("*").alias("n"), F.count_if(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).alias("k")).head()
    if told["n"] and told["k"] < frame * told["n"]:
        raise ValueError(f"only {told['k']} of {told['n']} nuclei lie in the image: their frames of reference differ")
    out = grown(components(grid, size=size), at, size)
    cells = out.groupBy("component", "seed").agg(F.first("label").alias("label"), F.min(pixel(F.col("row"), F.col("col"))).alias("cell"), F.count("*").alias("pixels"))
    return cells.select("cell", "seed", "label", F.col("seed").isNotNull().cast("int").alias("n_nuclei"), "pixels", (F.col("pixels") * pitch * pitch).alias("area"))


