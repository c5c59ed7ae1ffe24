"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.llm.shared import save

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 3
#: Fingerprints of 128 bits at most this far apart agree in one of 8 blocks up to 3 bits.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Most benchmark shingles that are sent to all executors; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Most keys of documents (16 bytes each) that are sent to all executors to pick these documents out; more go by a merge.
BROADCAST_KEYS = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingled(rows: DataFrame, k: int) -> DataFrame:
    """rows with words, as sh: a hash for each k words in a row."""

    def hashes(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    # As a variable of transform() the words are split once, not once for each place.
    return rows.withColumn("sh", F.get(F.transform(F.array("words"), hashes), F.lit(0))).drop("words")


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m (number of shingles), f1, f2: SimHash of 128 bits of sh, in which each shingle counts as often as it occurs."""
    each = rows.select(*keys, F.size("sh").alias("m"), F.explode("sh").alias("h")).withColumn("g", F.xxhash64("h", F.lit(1)))
    lanes = (1 << 32) + 1
    sums = [F.sum(F.shiftright(x, j).bitwiseAND(F.lit(lanes))).alias(f"{x}{j}") for x in ("h", "g") for j in range(32)]
    summed = each.groupBy(*keys, "m").agg(*sums)

    def bits(x: str) -> Column:
        low = [F.when(F.col(f"{x}{j}").bitwiseAND((1 << 32) - 1) * 2 > F.col("m"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
        high = [F.when(F.shiftright(f"{x}{j}", 32) * 2 > F.col("m"), F.shiftleft(F.lit(1).cast("long"), 32 + j)).otherwise(F.lit(0)) for j in range(32)]
        return reduce(lambda a, b: a.bitwiseOR(b), [c.cast("long") for c in low + high])

    return summed.select(*keys, "m", bits("h").alias("f1"), bits("g").alias("f2"))


def _blocks() -> Column:
    """(number, value) of each block of 16 bits."""
    cut = [F.shiftrightunsigned(f, BLOCK_BITS * b).bitwiseAND((1 << BLOCK_BITS) - 1) for f in ("f1", "f2") for b in range(BLOCKS // 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), c.cast("int").alias("value")) for i, c in enumerate(cut)])


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode("sh").alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("c"))


def _only(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose (doc_id, v) is (left_semi) or is not (left_anti) among keys (of, ov), without a shuffle while there are few."""
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(keys.hint("broadcast" if few else "merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("of")) & (F.col("v") == F.col("ov")), how)


def _matches(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    """Matches with items of at least k words (or, for k < 5, of exactly k words), by k-word shingles."""
    spark = docs.sparkSession
    items = save(_shingled(items, k).where(F.size("sh") > 0), "leak-items")
    known = save(items.select(F.explode("sh").alias("h")).distinct(), "leak-shingles")
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    sizes = [r["m"] for r in items.select(F.size("sh").alias("m")).distinct().orderBy("m").collect()]  # lengths of items
    if not sizes:
        return spark.createDataFrame([], "doc_id long, v long, start int, n_shingles int, item_id long, similarity double")
    shingled = _shingled(docs, k)

    # Where a document has any shingle of the benchmark. A window that has none is like no item, so no window is lost.
    hits = shingled.select("doc_id", "v", F.size("sh").alias("n"), F.posexplode("sh").alias("pos", "h")).join(known, "h", "left_semi")
    places = hits.groupBy("doc_id", "v", "n").agg(F.sort_array(F.collect_list("pos")).alias("at"))  # no longer than the document
    # For each item length m, windows that begin at such a place and hold as many as a similar one must; those between
    # two places hold no more than the one that begins at the next. Near the end, the last window of a document.
    # A document of n < m shingles is one window, of which (n + m) * percent / (100 + percent) suffice.
    suffice = lambda m: F.ceil((F.least(m, "n") + m) * (1.0 * percent / (100 + percent)) - F.lit(1e-9)).cast("int")
    sized = places.withColumn("m", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda m: F.size("at") >= suffice(m))))
    needed = suffice(F.col("m"))
    from_hit = F.filter(
        F.col("at"),
        lambda p, i: (p + F.col("m") <= F.col("n")) & (F.coalesce(F.get("at", i + needed - 1), F.col("n") + F.col("m")) < p + F.col("m")),
    )
    tail = F.greatest(F.col("n") - F.col("m"), F.lit(0))
    in_tail = F.size(F.filter("at", lambda p: p >= tail)) >= needed
    starts = F.array_distinct(F.concat(from_hit, F.when(in_tail, F.array(tail)).otherwise(F.array().cast("array<int>"))))
    windows = sized.select("doc_id", "v", F.explode(starts).alias("start"), F.least("m", "n").alias("len"))
    lists = save(windows.groupBy(F.col("doc_id").alias("of"), F.col("v").alias("ov")).agg(F.collect_set(F.struct("start", "len")).alias("w")), "leak-windows")

    # Texts are looked at a second time only where windows were found.
    again = _shingled(_only(docs, lists.select("of", "ov"), "left_semi"), k)
    there = again.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("v") == F.col("ov"))).select("doc_id", "v", "sh", F.explode("w").alias("w"))
    there = there.select("doc_id", "v", "w.start", F.slice("sh", F.col("w.start") + 1, F.col("w.len")).alias("sh"))
    placed = save(there.withColumn("a", F.xxhash64("sh")).withColumn("b", F.xxhash64(F.lit("b"), "sh")), "leak-placed")
    # Windows with equal contents are compared once, however many documents hold them.
    contents = save(placed.groupBy("a", "b").agg(F.first("sh").alias("sh")), "leak-contents")

    masks = F.lit([x for x in range(1 << BLOCK_BITS) if x.bit_count() <= BLOCK_RADIUS])
    marks = _fingerprints(contents, ["a", "b"])
    of_items = _fingerprints(items, ["item_id"]).select("item_id", F.col("m").alias("im"), F.col("f1").alias("i1"), F.col("f2").alias("i2"), F.explode(_blocks()).alias("x"))
    of_items = of_items.select("item_id", "im", "i1", "i2", "x.block", F.col("x.value").alias("own"), F.explode(masks).alias("mask")).withColumn(
        "value", F.col("own").bitwiseXOR(F.col("mask"))
    )
    marks = marks.select("a", "b", "m", "f1", "f2", F.explode(_blocks()).alias("x")).select("a", "b", "m", "f1", "f2", "x.block", "x.value")
    apart = F.bit_count(F.col("f1").bitwiseXOR(F.col("i1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("i2")))
    # 5,576 rows for each item: never broadcast, though their source is small.
    near = marks.join(of_items.drop("own", "mask").hint("merge"), ["block", "value"]).where(apart <= RADIUS)
    near = save(near.select("a", "b", "m", "item_id", "im").distinct(), "leak-near")

    both = near.join(_counted(contents, ["a", "b"]), ["a", "b"]).join(_counted(items, ["item_id"]).withColumnRenamed("c", "ic"), ["item_id", "h"])
    shared = both.groupBy("a", "b", "m", "item_id", "im").agg(F.sum(F.least("c", "ic")).alias("both"))
    union = F.col("m") + F.col("im") - F.col("both")
    same = shared.where(100 * F.col("both") >= percent * union).select("a", "b", "item_id", (F.col("both") / union).alias("similarity"))
    found = placed.select("doc_id", "v", "start", F.size("sh").alias("n_shingles"), "a", "b").join(save(same, "leak-same"), ["a", "b"])
    return found.select("doc_id", "v", "start", "n_shingles", "item_id", "similarity")


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """Windows of documents that are like an item of the benchmark.

    A window has as many shingles as the item (or the whole document, if that is shorter). Its similarity is the weighted
    Jaccard similarity of the k-word shingles, each counting as often as it occurs; from `percent` on it is a match.
    Windows and items get SimHash fingerprints of 128 bits; a multi-index of 8 blocks finds every pair at most 31 bits
    apart, and exact similarities decide. A pair of similarity 0.8 lies 19 bits apart on average, and beyond 31 about
    twice in a thousand; at 0.85 a few times in a hundred thousand. Items of fewer than k words have one shingle, of all their words.

    Returns doc_id, v (a digest of the text), start (first word), n_shingles, item_id, similarity. Shingles are told by
    64-bit hashes of their words. Items without words match nothing; null texts count as empty; repeated rows, and rows
    without doc_id, are told by their text; empty tables give none; other columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long"), words(F.col("text")).alias("words"), F.xxhash64("text").alias("v"))
    items = save(benchmark.select(F.col("item_id").cast("long"), words(F.col("text")).alias("words")), "leak-words")
    n = F.size("words")
    short = [r["n"] for r in items.select(n.alias("n")).where((n > 0) & (n < k)).distinct().orderBy("n").collect()]
    parts = [_matches(texts, items.where(n >= k), k, percent)] + [_matches(texts, items.where(n == s), s, percent) for s in short]
    return reduce(DataFrame.unionByName, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, v, items (ids of the items that a document holds, ascending), similarity (the highest): documents with any."""
    found = matches(docs, benchmark, percent, k).groupBy("doc_id", "v")
    return save(found.agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity")), "leak-documents")


def report(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, contaminated, items, similarity for each row of docs (no items and null without a match)."""
    found = contaminated(docs, benchmark, percent, k).select(F.col("doc_id").alias("of"), F.col("v").alias("ov"), "items", "similarity")
    here = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("v"))
    joined = here.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("v") == F.col("ov")), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """Rows of docs, with all columns, that hold no item."""
    found = contaminated(docs, benchmark, percent, k).select(F.col("doc_id").alias("of"), F.col("v").alias("ov"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("v"))
    return _only(keyed, found, "left_anti").select("row.*")
