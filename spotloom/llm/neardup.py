"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm import textcols
from spotloom.llm.links import by_group, components, connected, forest, tiled
from spotloom.llm.shared import drop_saved, save

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
_seeds = np.random.default_rng(20240229).integers(1, 1 << 63, (2, REGISTERS), dtype=np.uint64)
_FACTORS, _OFFSETS = _seeds[0] | np.uint64(1), _seeds[1]


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each row, alike in any chunk, and the first of each row.

    A-Z count as lower case; a row with fewer than k words has one shingle of all its words, without words it has none.
    """
    raw = textcols.lower_ascii(raw)
    starts, ends, firsts = textcols.words(raw, offsets)
    prefix = textcols.PrefixHash(textcols.PrefixHash(raw).of(starts, ends))
    n = np.diff(firsts)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at, row = textcols.ranges(firsts[:-1], count)
    h = prefix.of(at, np.minimum(at + k, firsts[row + 1]))
    bounds = np.append(0, np.cumsum(count)).tolist()
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        h[i:j].sort()  # rows stand one after the other; all 64 bits stay, whatever the chunk
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return textcols.mix(h), np.searchsorted(row, np.arange(len(n) + 1))


def registers(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of rows that have shingles: the leading zeros of the least 32-bit hash (5 bits) and the
    bits that follow (10)."""
    out = np.empty((len(firsts) - 1, REGISTERS), np.uint16)
    for j in range(REGISTERS):
        v = ((h * _FACTORS[j] + _OFFSETS[j]) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum.reduceat(v, firsts[:-1]).astype(np.float64)
        zeros = 32 - np.frexp(least)[1]  # frexp: least = f * 2**e with f in [0.5, 1)
        zeros[least == 0] = 31
        zeros = np.minimum(zeros, 31)
        mantissa = np.floor((np.ldexp(least, zeros - 31) - 1) * (1 << MANTISSA_BITS)).clip(0, (1 << MANTISSA_BITS) - 1)
        out[:, j] = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    return out


def chance(n: np.ndarray) -> np.ndarray:
    """Share of registers in which two different sets of about n shingles agree by chance."""
    level = np.arange(32.0)
    p = (1 - 2.0 ** -(level + 1)) ** n[:, None] - (1 - 2.0**-level) ** n[:, None]
    return (p * p).sum(axis=1) * 2.0**-MANTISSA_BITS


def estimate(agree: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, corrected for agreement by chance."""
    e = chance(n)
    return (agree - e) / (1 - e)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, v (a digest of the text), n (distinct shingles), set_a, set_b (a fingerprint of the set), sketch (registers; null without shingles)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcols.chunks(batch):
                h, firsts = shingle_hashes(*textcols.utf8(part["text"]), k)
                n = np.diff(firsts)
                some = np.flatnonzero(n)
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sketches: list[bytes | None] = [None] * len(n)
                if len(some):
                    bounds = np.append(firsts[some], len(h))
                    a[some] = np.add.reduceat(h, bounds[:-1])
                    b[some] = np.add.reduceat(textcols.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds[:-1])
                    for i, r in zip(some.tolist(), registers(h, bounds), strict=True):
                        sketches[i] = r.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "v": part["v"],
                        "n": pa.array(n),
                        "set_a": pa.array(a.view(np.int64)),
                        "set_b": pa.array(b.view(np.int64)),
                        "sketch": pa.array(sketches, pa.binary()),
                    }
                )

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("v"))
    return keyed.mapInArrow(each, "doc_id long, v long, n long, set_a long, set_b long, sketch binary")


def _close(threshold: float) -> object:
    """A kernel for members of buckets: rows band, bucket, ta, tb, rep, n, sketch -> a forest of close pairs (a, b)."""
    # Five standard deviations below the threshold: a pair that is similar enough falls below once in millions.
    least = threshold - 5 * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def settle(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        rep, n = batch["rep"].to_numpy(), batch["n"].to_numpy().astype(float)
        _, off, data = batch["sketch"].buffers()
        first = np.frombuffer(off, np.int32)[batch["sketch"].offset]
        regs = np.frombuffer(data, np.uint16, batch.num_rows * REGISTERS, first).reshape(-1, REGISTERS)
        out_a, out_b = [], []
        two = np.flatnonzero(np.diff(bounds) == 2)  # most buckets
        x, y = bounds[two], bounds[two] + 1
        ok = estimate((regs[x] == regs[y]).mean(axis=1), np.sqrt(n[x] * n[y])) >= least
        out_a.append(rep[x[ok]])
        out_b.append(rep[y[ok]])
        for i in np.flatnonzero(np.diff(bounds) > 2):
            g = slice(bounds[i], bounds[i + 1])
            r, m = regs[g], n[g]
            agree = np.zeros((len(m), len(m)), np.uint16)
            for j in range(REGISTERS):
                agree += r[:, j][:, None] == r[:, j][None, :]
            e = chance(m)
            e = np.sqrt(e[:, None] * e[None, :])
            root = forest((agree / REGISTERS - e) / (1 - e) >= least)
            moved = np.flatnonzero(root != np.arange(len(m)))
            out_a.append(rep[g][root[moved]])
            out_b.append(rep[g][moved])
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})

    return by_group(["bucket", "ta", "tb"], settle)


def _sets(percent: int, slice_rows: int = 1024, most: int = 1 << 21) -> object:
    """A mapInArrow function for rows group, tile, right, rep, sub, shingles, sorted by group, tile and right.

    In each tile of a group every row on the right is compared with all on the left: links of those whose sets are similar
    and whose `sub` differs come out, as a spanning forest (a, b). Rows on the right are taken as they come, so only a
    tile's left side is held.
    """

    def hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, off, data = part["shingles"].buffers()
        bounds = np.frombuffer(off, np.int32)[part["shingles"].offset :][: part.num_rows + 1].astype(np.int64) // 8
        n = np.diff(bounds)
        return np.frombuffer(data, np.uint64)[bounds[0] : bounds[-1]], np.repeat(np.arange(len(n)), n), n

    def compare(left: tuple, part: pa.RecordBatch) -> pa.RecordBatch:
        known, owner, n_left, rep_left, sub_left = left
        h, row, n = hashes(part)
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        both = np.zeros((part.num_rows, len(n_left)), np.int64)
        # Shared shingles are counted a few million at a time, however alike the sets are.
        shared = np.concatenate([[0], np.cumsum(hi - lo)])
        ends, i = np.cumsum(n), 0
        while i < part.num_rows:
            begin = ends[i] - n[i]
            j = max(i + 1, int(np.searchsorted(shared[ends], shared[begin] + most, "right")))
            some = slice(begin, ends[j - 1])
            at, of = textcols.ranges(lo[some], (hi - lo)[some])
            both[i:j] = np.bincount((row[some][of] - i) * len(n_left) + owner[at], minlength=(j - i) * len(n_left)).reshape(j - i, -1)
            i = j
        sub = part["sub"].to_numpy()
        ok = (100 * both >= percent * (n[:, None] + n_left[None, :] - both)) & (both > 0) & (sub[:, None] != sub_left[None, :])
        i, j = np.nonzero(ok)
        rep = np.concatenate([rep_left, part["rep"].to_numpy()])
        label = connected(len(rep), i + len(rep_left), j)
        moved = np.flatnonzero(label != np.arange(len(rep)))
        return pa.RecordBatch.from_pydict({"a": pa.array(rep[label[moved]]), "b": pa.array(rep[moved])})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, left = None, [], None
        for batch in batches:
            group, tile, right = (batch[c].to_numpy(zero_copy_only=False) for c in ("group", "tile", "right"))
            new = np.flatnonzero((group[1:] != group[:-1]) | (tile[1:] != tile[:-1]) | (right[1:] != right[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if key != (group[lo], tile[lo]):
                    key, held, left = (group[lo], tile[lo]), [], None
                part = batch.slice(lo, hi - lo)
                if not right[lo]:
                    held.append(part)
                    continue
                if left is None and held:
                    one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    h, owner, n = hashes(one)
                    order = np.argsort(h)
                    left = (h[order], owner[order], n, one["rep"].to_numpy(), one["sub"].to_numpy())
                if left is not None:
                    for k in range(0, part.num_rows, slice_rows):
                        yield compare(left, part.slice(k, slice_rows))

    return each


def _shingles(texts: DataFrame, k: int) -> DataFrame:
    """rep and shingles (hashes of the distinct shingles, as bytes) of rep, text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcols.chunks(batch):
                h, firsts = shingle_hashes(*textcols.utf8(part["text"]), k)
                bounds = pa.py_buffer((firsts * 8).astype(np.int32))
                yield pa.RecordBatch.from_pydict({"rep": part["rep"], "shingles": pa.Array.from_buffers(pa.binary(), part.num_rows, [None, bounds, pa.py_buffer(h)])})

    return texts.mapInArrow(each, "rep long, shingles binary")


_PAIR = "a long, b long"


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 3, bucket_tile: int = 1024, group_tile: int = 256, with_digest: bool = False) -> DataFrame:
    """Components of documents whose sets of k-word shingles have 100 * intersection >= percent * union.

    1. Each document gets the HyperMinHash registers of its set. Documents with one set become one class, named by its
       least doc_id.
    2. Classes that agree in a band of registers share a bucket. Within a bucket, pairs whose corrected estimate is not
       clearly below the threshold join a group (buckets of any size are dealt into tiles, whose pairs are compared in
       separate tasks; a task gives a spanning forest, not all pairs).
    3. Each member of a group is compared, on full sets, with the least one that it was close to. What this links falls
       into parts. If a group has several, those that are not in its largest part are compared with all the rest, tile by
       tile; members of one part are not compared again. The components of all links are found.

    Sets are told by 64-bit hashes of their shingles. A pair at 85 % misses all 24 bands once in 1.3 million. The work of
    step 3 grows with the members of a group times those outside its largest part, never with exact copies.

    Returns doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id), and on request v (a
    digest of the text); one row for each row of docs. Documents without words are linked with nothing. Rows that share
    a doc_id are one document with several texts. A row without doc_id takes no part: its component_id is null and kept
    is true.
    """
    sketched = save(sketch(docs, k), "near-sketches")
    known = sketched.where("doc_id is not null and n > 0")
    least = known.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m"))
    classes = save(least.select("set_a", "set_b", F.col("m.doc_id").alias("rep"), "m.n", "m.sketch"), "near-classes")

    width = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    bands = classes.select("rep", "sketch", band.alias("band"))
    bands = bands.select("rep", F.xxhash64("band", F.expr(f"substring(sketch, band * {width} + 1, {width})")).alias("bucket"))
    full = save(bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "near-buckets")
    # Both sides of these joins grow with the input: neither is ever sent whole. Sketches follow only where buckets are shared.
    shared = save(bands.join(full.hint("merge"), "bucket"), "near-shared")
    met = shared.join(classes.select("rep", "n", "sketch").hint("merge"), "rep")
    met = tiled(met, F.col("members"), F.col("rep"), bucket_tile).drop("members", "tile")
    keys = ["bucket", "ta", "tb"]
    close = save(met.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(_close(percent / 100), _PAIR), "near-close")
    groups = save(components(close).select(F.col("node").alias("rep"), F.col("component").alias("group")), "near-groups")

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(groups.select("rep").hint("merge"), "rep", "left_semi")
    sets = save(_shingles(texts, k), "near-sets")
    order = ["group", "tile", "right"]
    kernel = lambda rows: rows.repartition("group", "tile").sortWithinPartitions(*order).mapInArrow(_sets(percent), _PAIR)
    # Stars: each member on the right of the least one it was close to. A star's members are dealt to many tiles, so the
    # one in its middle is repeated for each of them, and no more often.
    arms = close.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("group")).where("rep <> group")
    tiles = 64
    arms = arms.select("rep", "group", F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int").alias("tile"), F.lit(True).alias("right"))
    arms = save(arms, "near-arms")
    middles = arms.select(F.col("group").alias("rep"), "group", "tile", F.lit(False).alias("right")).distinct()
    stars = arms.unionByName(middles).join(sets.hint("merge"), "rep").select(*order, "rep", F.when(F.col("right"), 1).otherwise(0).cast("long").alias("sub"), "shingles")
    first = save(kernel(stars), "near-stars")

    parts = components(first).select(F.col("node").alias("at"), F.col("component").alias("sub"))
    member = save(groups.join(parts, F.col("rep") == F.col("at"), "left").select("rep", "group", F.coalesce("sub", "rep").alias("sub")), "near-parts")
    sized = member.groupBy("group", "sub").agg(F.count("*").alias("n"))
    largest = sized.groupBy("group").agg(F.max(F.struct("n", (-F.col("sub")).alias("low"))).alias("m"), F.sum("n").alias("members"), F.count("*").alias("subs"))
    # Both members of a group of two have met.
    several = largest.where("subs > 1 and members > 2").select("group", (-F.col("m.low")).alias("main"), F.ceil((F.col("members") - F.col("m.n")) / group_tile).cast("int").alias("tiles"))
    still = save(member.join(save(several, "near-open"), "group"), "near-open-members")
    left = still.where("sub <> main").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("right", F.lit(False))
    right = still.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("right", F.lit(True))
    rest = left.select(*order, "rep", "sub").unionByName(right.select(*order, "rep", "sub")).join(sets.hint("merge"), "rep").select(*order, "rep", "sub", "shingles")
    links = save(first.unionByName(kernel(rest)), "near-links")
    drop_saved(sets)
    found = components(links).select(F.col("node").alias("rep"), "component")

    named = save(classes.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "rep").join(found, "rep", "left"), "near-named")
    here = sketched.join(named.hint("merge"), (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & F.col("doc_id").isNotNull() & (F.col("n") > 0), "left")
    own = here.select("doc_id", *["v"] * with_digest, F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
