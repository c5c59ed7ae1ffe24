"""Connected components of edges, and what is built on them: label-grid segments, dissolved regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions import geometry
from spotloom.operators.tables import keep


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of nodes(node) and edges(a, b).

    Each round takes the least label around a node, then that label's own label; the rounds grow with the logarithm of
    a component's diameter.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(nodes.select("node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        told = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "component")
        near = keep(told.unionByName(labels).groupBy("node").agg(F.min("component").alias("component")), "near")
        up = near.select(F.col("node").alias("at"), F.col("component").alias("further"))
        far = near.join(up, near.component == up["at"]).select("node", F.least("component", "further").alias("component"))
        new = keep(far, "labels")
        moved = new.join(labels.select(F.col("node").alias("was"), F.col("component").alias("old")), new.node == F.col("was")).where("component <> old").limit(1).count()
        labels = new
        if not moved:
            return labels


def grid_components(grid: DataFrame, eight: bool = False, size: int = 512) -> DataFrame:
    """grid(row, col, label, ...) with component, the least (row, col) of its own: neighbours (4 or 8) of one label belong
    together. Worked out by tiles, see tiles.components()."""
    from spotloom.operators import tiles

    named = tiles.components(grid, eight, size)
    least = F.struct(*[f(F.col("component")).cast(grid.schema[c].dataType).alias(c) for c, f in (("row", tiles.pixel_row), ("col", tiles.pixel_col))])
    return named.withColumn("component", least)


def segments(parts: DataFrame, size: float) -> DataFrame:
    """component, label, pixels, area of grid_components()."""
    return parts.groupBy("component", "label").agg(F.count("*").alias("pixels"), (F.count("*") * size * size).alias("area"))


def relabel_islands(parts: DataFrame, least: int) -> DataFrame:
    """row, col, label: components below `least` pixels take the label most frequent around them (least among equals).

    All islands are judged on the input at once; the order of labels plays no part. Islands without neighbours stay.
    """
    small = parts.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") < least)
    on = parts.join(small, "component", "left")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    around = on.where("k is not null").withColumn("s", F.explode(steps)).select("component", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    seen = around.join(parts.select("row", "col", F.col("label").alias("next"), F.col("component").alias("other")), ["row", "col"]).where("component <> other")
    votes = seen.groupBy("component", "next").agg(F.count("*").alias("n"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "next"))).where("r = 1").select("component", "next")
    return on.join(best, "component", "left").select("row", "col", F.coalesce("next", "label").alias("label"))


def dissolved(regions: DataFrame, gap: float, min_area: float = 0.0, tile: float = 500.0) -> DataFrame:
    """regions(sample, label, idx, xs, ys) with group: parts of one sample and label whose boxes lie within 2 * gap. Groups
    whose parts have less than min_area together go. Parts meet by the tiles that their boxes, wider by gap, touch."""
    r = regions.withColumns({"node": F.struct("sample", "label", "idx"), "x0": F.array_min("xs"), "x1": F.array_max("xs"), "y0": F.array_min("ys"), "y1": F.array_max("ys")})
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - gap) / tile), F.floor((F.col(hi) + gap) / tile)))
    dealt = r.select("sample", "label", "idx", "node", "x0", "x1", "y0", "y1").withColumn("tx", span("x0", "x1")).withColumn("ty", span("y0", "y1"))
    a, b = dealt.alias("a"), dealt.alias("b")
    near = (F.col("a.x0") <= F.col("b.x1") + 2 * gap) & (F.col("b.x0") <= F.col("a.x1") + 2 * gap) & (F.col("a.y0") <= F.col("b.y1") + 2 * gap) & (F.col("b.y0") <= F.col("a.y1") + 2 * gap)
    same = (F.col("a.sample") == F.col("b.sample")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty"))
    edges = a.join(b, same & near & (F.col("a.idx") < F.col("b.idx"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    found = components(r.select("node"), edges).select("node", F.col("component.idx").alias("group"))
    out = r.join(found, "node").drop("node", "x0", "x1", "y0", "y1")
    if min_area <= 0:
        return out
    keys = ["sample", "label", "group"]
    large = out.groupBy(*keys).agg(F.sum(geometry.area(F.col("xs"), F.col("ys"))).alias("__a")).where(F.col("__a") >= min_area).select(*keys)
    return out.join(large, keys, "left_semi")
