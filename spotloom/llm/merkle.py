"""Merkle manifest of a table: roots by checkpoints every few levels, proofs by building the levels between again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.llm.shared import drop_saved, save

#: Levels from one stored level to the next; an aligned subtree has at most 2 ** STEP stored nodes below it.
STEP = 6
#: Name of the tree over all trees.
_TOP = "\0top"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of columns: each `-` where it is null, else its UTF-8 byte count, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def raise_levels(nodes: list[str], whole: bool, step: int = STEP) -> list[list[str]]:
    """The levels above nodes, themselves first: until one is left, or, in a tree that goes on beside them, step levels up,
    where a last one alone becomes its own hash."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= step:
        below = levels[-1]
        levels.append([_h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """Of node `at` of the lowest level, for each level up to the one below the highest: `<` or `>` (it stands left or
    right of the path) and the other node of the path's run; empty where the run has no other."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append(("<" if at & 1 else ">") + nodes[other] if other < len(nodes) else "")
        at >>= 1
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its path give."""
    for s in path:
        leaf = _h(leaf) if not s else _h(s[1:], leaf) if s[0] == "<" else _h(leaf, s[1:])
    return leaf


def numbered(leaves: DataFrame, order: list[Column | str]) -> DataFrame:
    """leaves(tree, ...) with at (from 0, in the order given) and n (rows) within each tree.

    One shuffle by ranges of (tree, order), so that a large tree is dealt to many tasks; a row's number is its place in its
    range and the rows of its tree in the ranges before, of which one row for each tree and range is kept. `__salt` deals rows that
    are equal in all of the order.
    """
    salted = leaves.withColumn("__salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange("tree", *order, "__salt").sortWithinPartitions("tree", *order, "__salt").drop("__salt")
    placed = save(dealt.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)), "merkle-rows")
    from pyspark.sql import Window

    runs = placed.groupBy("tree", "__part").agg(F.count("*").alias("__k"), F.min("__row").alias("__first"))
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__k").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = save(runs.select("tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__k").over(by).alias("n")), "merkle-runs")
    return placed.join(runs, ["tree", "__part"]).withColumn("at", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


def checkpoints(nodes: DataFrame, step: int = STEP) -> list[DataFrame]:
    """Stored levels of trees of nodes(tree, at, n, node, ...), the lowest first, each a table of aligned subtrees: tree,
    block (its number), n (nodes of the tree on this level), nodes (array of structs of node and further columns), top.

    A subtree of 2 ** step nodes at most meets in one task and only its top goes on; the levels between are not kept.
    """
    spark, out = nodes.sparkSession, []
    current = nodes
    while True:
        rest = [c for c in current.columns if c not in ("tree", "n", "at")]
        grouped = current.groupBy("tree", F.shiftright("at", step).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", *rest))).alias("nodes"))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = zip(batch["n"].to_pylist(), batch["nodes"].to_pylist(), strict=True)
                tops = [raise_levels([x["node"] for x in each], n <= 1 << step, step)[-1][0] for n, each in told]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, "top"])

        level = save(grouped.mapInArrow(kernel, grouped.withColumn("top", F.lit("")).schema), "merkle-level")
        out.append(level)
        above = level.where(F.col("n") > 1 << step)
        if above.isEmpty():
            return out
        up = F.shiftright(F.col("n") + ((1 << step) - 1), step)
        current = above.select("tree", F.col("block").alias("at"), up.alias("n"), F.col("top").alias("node"))


def _paths(level: DataFrame, above: DataFrame, step: int) -> DataFrame:
    """tree, at, path of all nodes of a stored level, from the paths(tree, block, path) of its subtrees' tops."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                levels = raise_levels([x["node"] for x in row["nodes"]], row["n"] <= 1 << step, step)
                paths = [siblings(levels, k) + row["path"] for k in range(len(row["nodes"]))]
                yield pa.RecordBatch.from_pydict({"tree": [row["tree"]] * len(paths), "at": [x["at"] for x in row["nodes"]], "path": paths})

    return level.join(above, ["tree", "block"]).select("tree", "n", "nodes", "path").mapInArrow(kernel, "tree string, at long, path array<string>")


def _top_paths(levels: list[DataFrame], step: int, start: DataFrame) -> DataFrame:
    """tree, block, path of the lowest level's subtrees, where start(tree, path) are the paths of the trees' roots."""
    paths = None
    for i in range(len(levels) - 1, -1, -1):
        ends = levels[i].where(F.col("n") <= 1 << step).select("tree", "block").join(start, "tree")
        above = ends if paths is None else ends.unionByName(paths.select("tree", F.col("at").alias("block"), "path"))
        if i == 0:
            return above
        paths = save(_paths(levels[i], above, step), "merkle-paths")
    raise ValueError("no level")


def manifest(rows: DataFrame, leaf: Column, tree: Column, order: list[str], carry: list[str], tampered: Column | None = None, step: int = STEP) -> DataFrame:
    """carry, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Rows of one `tree` value are leaves in the order of `order` (nulls first, then by leaf); on each level every two
    consecutive nodes, or a last one alone, become their hash, until one is left, the subroot. Subroots in the order
    of tree (null first, then by bytes) give the root in the same way. proof_sha256 hashes the siblings on the path to
    the root; folded_root is what `tampered` (a leaf in place of the own one, null for none) or the leaf itself and
    those siblings give. A tree of one row is that row's leaf; equal rows are leaves of their own; an empty table gives no rows.

    Kept are the leaves and every `step`-th level. Proofs start at the root and go down from stored level to stored level:
    each aligned subtree builds its levels again from its stored nodes, adds their siblings to the path above, and drops them.
    """
    keep, order = [f"__c{i}" for i in range(len(carry))], list(order)
    name = F.when(tree.isNull(), "").otherwise(F.concat(F.lit("="), tree.cast("string")))
    changed = F.lit(None).cast("string") if tampered is None else tampered
    sort = [f"__o{i}" for i in range(len(order))]
    named = [F.col(c).alias(k) for c, k in zip([*order, *carry], [*sort, *keep], strict=True)]
    leaves = rows.select(name.alias("tree"), *named, leaf.alias("node"), changed.alias("changed"))
    order_by = [F.col(c).asc_nulls_first() for c in sort] + [F.col("node")]
    levels = checkpoints(numbered(leaves, order_by).select("tree", "at", "n", "node", "changed", *keep), step)
    roots = levels[0].where(F.col("n") <= 1 << step)
    for level in levels[1:]:
        roots = roots.select("tree", "top").unionByName(level.where(F.col("n") <= 1 << step).select("tree", "top"))
    roots = save(roots.select("tree", F.col("top").alias("subroot")), "merkle-roots")
    # The tree over all trees is one more of the same kind.
    tops = numbered(roots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("node")), [F.col("of")])
    top_levels = checkpoints(tops.select("tree", "at", "n", "node", "of"), step)
    last = top_levels[-1].select("top").head()  # one value: the root
    root = last["top"] if last is not None else None
    begin = rows.sparkSession.createDataFrame([(_TOP, [])], "tree string, path array<string>")
    joined = top_levels[0].join(_top_paths(top_levels, step, begin), ["tree", "block"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                built = raise_levels([x["node"] for x in row["nodes"]], row["n"] <= 1 << step, step)
                paths = [siblings(built, k) + row["path"] for k in range(len(row["nodes"]))]
                yield pa.RecordBatch.from_pydict({"tree": [x["of"] for x in row["nodes"]], "path": paths})

    starts = save(joined.select("n", "nodes", "path").mapInArrow(ends, "tree string, path array<string>"), "merkle-starts")
    above = _top_paths(levels, step, starts).join(roots, "tree")
    out = rows.select(*carry).schema
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        out = out.add(c, "string")
    out = out.add("verified", "boolean")

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = batch["nodes"]
            flat, bounds = inner.flatten(), inner.value_lengths().to_pylist()
            node, change = (flat.field(c).to_pylist() for c in ("node", "changed"))
            at, told = 0, []
            for size, n, path, subroot in zip(bounds, *(batch[c].to_pylist() for c in ("n", "path", "subroot")), strict=True):
                built = raise_levels(node[at : at + size], n <= 1 << step, step)
                for k in range(size):
                    full = siblings(built, k) + path
                    folded = fold(change[at + k] or node[at + k], full)
                    told.append((node[at + k], subroot, root, _h(*[s[1:] for s in full]), folded, folded == root))
                at += size
            cols = list(zip(*told, strict=True)) or [()] * 6
            names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            made = [pa.array(c, pa.bool_() if c_name == "verified" else pa.string()) for c, c_name in zip(cols, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in keep], *made], [*carry, *names])

    result = save(levels[0].join(above, ["tree", "block"]).select("n", "nodes", "path", "subroot").mapInArrow(proofs, out), "merkle-proofs")
    drop_saved(*levels, *top_levels, roots, starts)
    return result


def documents_manifest(docs: DataFrame) -> DataFrame:
    """manifest() of documents by lang, with every row tampered with (n_chars + 1) whose doc_id has a crc32 that 7 divides.

    A null n_chars stays null, so that its row verifies; a null doc_id is never tampered with.
    """
    fields = lambda n: digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(chosen, fields(F.col("n_chars") + 1))
    return manifest(docs, fields(F.col("n_chars")), F.col("lang"), ["doc_id"], ["doc_id"], tampered)
