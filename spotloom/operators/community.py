"""Communities of a weighted graph by multi-level modularity clustering with refinement; all state is in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spotloom.operators.tables import keep


def _moves(node: Column, turn: int, seed: int) -> Column:
    """Half of all nodes, another one each turn."""
    return F.pmod(F.xxhash64(node, F.lit(turn), F.lit(seed)), F.lit(2)) == 0


def _links(state: DataFrame, edges: DataFrame, group: str, movers: Column) -> DataFrame:
    """a, group, link: weight of the edges from each mover to each group around it."""
    told = edges.where(movers & (F.col("a") != F.col("b")))
    at = state.select(F.col("node").alias("b"), F.col(group).alias("to"))
    return told.join(at, "b").groupBy("a", "to").agg(F.sum("w").alias("link"))


def _met(state: DataFrame, edges: DataFrame, movers: Column) -> DataFrame:
    """state with its community's own_tot and own_members, once for each community that a mover is linked to (to, tot, members,
    and link, the weight of its edges there), once with nulls where there is none.

    Communities' sums go along with the labels that edges look up, so that each edge is dealt twice: by its far end and by its mover.
    """
    size = state.groupBy("comm").agg(F.sum("k").alias("own_tot"), F.count("*").alias("own_members"))
    known = state.join(size, "comm")
    far = known.select(F.col("node").alias("b"), F.col("comm").alias("to"), F.col("own_tot").alias("tot"), F.col("own_members").alias("members"))
    told = edges.where(movers & (F.col("a") != F.col("b"))).join(far, "b").select(F.col("a").alias("node"), "to", "tot", "members", "w").repartition("node")
    link = told.groupBy("node", "to").agg(F.sum("w").alias("link"), F.first("tot").alias("tot"), F.first("members").alias("members"))
    return known.join(link, "node", "left")


def _moved(state: DataFrame, edges: DataFrame, m2: int, resolution: float, turn: int, seed: int) -> DataFrame:
    """state after one turn: each node of one half goes to the community around it that gains most, the least among equals.

    Gains are exact sums of whole numbers, so that reruns agree. A node alone goes to another node alone only where that
    has the lesser label, so that two never change places.
    """
    met = _met(state.drop("moved"), edges, _moves(F.col("a"), turn, seed))
    here = F.col("to") == F.col("comm")
    gain = F.col("link") * F.lit(float(m2)) - F.lit(float(resolution)) * F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0))
    rule = F.col("to").isNotNull() & (here | (F.col("own_members") > 1) | (F.col("members") > 1) | (F.col("to") < F.col("comm")))
    best = met.groupBy("node").agg(
        F.first("k").alias("k"),
        F.first("comm").alias("comm"),
        F.max(F.when(rule, F.struct(gain.alias("gain"), (-F.col("to")).alias("to")))).alias("best"),
        F.max(F.when(here, gain)).alias("stay"),
        F.first((F.lit(-float(resolution)) * F.col("k") * (F.col("own_tot") - F.col("k")))).alias("alone"),
    )
    goes = F.col("best.gain") > F.coalesce("stay", "alone")
    out = best.select("node", "k", "comm", F.when(goes, -F.col("best.to")).alias("next"))
    return out.select("node", "k", F.coalesce("next", "comm").alias("comm"), (F.col("next").isNotNull() & (F.col("next") != F.col("comm"))).alias("moved"))


def _refined(state: DataFrame, edges: DataFrame, m2: int, resolution: float, seed: int, turns: int = 3) -> DataFrame:
    """state with sub: parts of each community, built from single nodes, each of which joins, once, a part of its own
    community that it is linked to, gains by, and whose first node stays this turn. So every part is connected.

    Only nodes that are well linked to the rest of their community join.
    """
    inner = edges.where(F.col("a") != F.col("b"))
    at = state.select("node", "comm")
    inner = inner.join(at.withColumnsRenamed({"node": "a", "comm": "ca"}), "a").join(at.withColumnsRenamed({"node": "b", "comm": "cb"}), "b")
    inner = keep(inner.where("ca = cb").select("a", "b", "w"), "inner")
    whole = state.groupBy("comm").agg(F.sum("k").alias("whole"))
    tied = inner.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("tied"))
    well = F.coalesce("tied", F.lit(0)) * F.lit(float(m2)) >= F.lit(float(resolution)) * F.col("k") * (F.col("whole") - F.col("k"))
    cur = keep(state.join(whole, "comm").join(tied, "node", "left").select("node", "k", "comm", F.col("node").alias("sub"), well.alias("well")), "parts")
    for turn in range(turns):
        part = cur.groupBy("sub").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
        link = _links(cur, inner, "sub", _moves(F.col("a"), turn, seed + 7))
        known = cur.join(part, "sub").where(F.col("well") & (F.col("members") == 1)).select(F.col("node").alias("a"), "k")
        met = link.join(known, "a").join(part.withColumnRenamed("sub", "to"), "to")
        stays = (F.col("members") > 1) | ~_moves(F.col("to"), turn, seed + 7)
        gain = F.col("link") * F.lit(float(m2)) - F.lit(float(resolution)) * F.col("k") * F.col("tot")
        best = met.where(stays & (F.col("to") != F.col("a"))).groupBy("a").agg(F.max(F.struct(gain.alias("gain"), (-F.col("to")).alias("to"))).alias("best"))
        best = best.where("best.gain > 0").select(F.col("a").alias("node"), (-F.col("best.to")).alias("next"))
        cur = keep(cur.join(best, "node", "left").select("node", "k", "comm", F.coalesce("next", "sub").alias("sub"), "well"), "parts")
    return cur


def modularity(edges: DataFrame, state: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of state(node, comm) on edges(a, b, w), which hold each edge in both directions."""
    at = state.select("node", "comm")
    both = edges.join(at.withColumnsRenamed({"node": "a", "comm": "ca"}), "a").join(at.withColumnsRenamed({"node": "b", "comm": "cb"}), "b")
    by = both.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0)).alias("i"), F.sum("w").alias("t"))
    r = by.agg(F.sum("i").alias("i"), F.sum("t").alias("t"), F.sum(F.col("t").cast("double") * F.col("t")).alias("q")).head()  # one row
    return (r["i"] / r["t"] - resolution * r["q"] / r["t"] ** 2) if r["t"] else 0.0


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, turns: int = 8, levels: int = 6, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """node, community (its least node) of nodes(node) and undirected edges(a, b, w), and the modularity after each level.

    Weights are whole numbers above zero (scale others), edges between the same two nodes add up. On each level nodes move
    in turns of halves to the community that gains most, communities are refined into connected parts, and the parts
    become the nodes of the next level, which starts from their communities; it ends when no part joins another. Nodes without edges are communities of
    their own. Neither nodes nor edges come to the driver: it gets a count and a sum for each turn and level.
    """
    both = edges.select("a", "b", "w").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    graph = keep(both.groupBy("a", "b").agg(F.sum("w").cast("long").alias("w")), "graph")
    m2 = graph.agg(F.sum("w")).head()[0] or 0
    every = keep(nodes.select(F.col("node").cast("long").alias("node")).distinct(), "nodes")
    label = every.select("node", F.col("node").alias("comm"))
    if not m2:
        return label.withColumnRenamed("comm", "community"), []
    degree = graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    state = keep(degree.select("node", "k", F.col("node").alias("comm"), F.lit(False).alias("moved")), "state")
    chain, told = every.select("node", F.col("node").alias("at")), []
    for level in range(levels):
        idle = 0
        for turn in range(turns):
            seen = Observation()  # counts where the state is written, without another pass
            state = keep(_moved(state, graph, m2, resolution, turn + 100 * level, seed).observe(seen, F.count_if("moved").alias("moved")), "state")
            idle = 0 if seen.get["moved"] else idle + 1
            if idle == 2:
                break
        parts = _refined(state, graph, m2, resolution, seed + level)
        names = parts.select(F.col("node").alias("at"), "sub", "comm")
        chain = keep(chain.join(names, "at", "left").select("node", F.coalesce("sub", "at").alias("at"), F.coalesce("comm", "at").alias("comm")), "chain")
        label = chain.select("node", "comm")
        chain = chain.select("node", "at")
        up = names.select("at", "sub")
        coarse = graph.join(up.withColumnsRenamed({"at": "a", "sub": "sa"}), "a").join(up.withColumnsRenamed({"at": "b", "sub": "sb"}), "b")
        graph = keep(coarse.groupBy(F.col("sa").alias("a"), F.col("sb").alias("b")).agg(F.sum("w").alias("w")), "graph")
        before = state
        state = keep(parts.groupBy(F.col("sub").alias("node")).agg(F.sum("k").alias("k"), F.first("comm").alias("comm"), F.lit(False).alias("moved")), "state")
        told.append(modularity(graph, state, resolution))  # the same on the parts as on the nodes
        if state.count() == before.count():
            break
    least = label.groupBy("comm").agg(F.min("node").alias("community"))
    return label.join(least, "comm").select("node", "community"), told


def neighbour_graph(neighbours: DataFrame) -> DataFrame:
    """a, b, w of neighbours(src, dst): w counts the directions in which the two are neighbours."""
    ends = neighbours.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return ends.groupBy("a", "b").agg(F.count("*").alias("w"))
