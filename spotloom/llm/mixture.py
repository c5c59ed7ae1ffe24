"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.llm.shared import save

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """Targets of sources(source, source_size): `share` of all sizes by weight, none above max_epochs times its size.

    Sources by code point, null last, take the weights in turn. What a capped source leaves is shared by weight among
    the others until none is above its cap. In order of cap by weight the capped sources come first, so one pass of
    running sums finds the level at which the rest fills up. The table holds one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, on = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cycle = F.array(*map(F.lit, weights))
    return (
        sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(on))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("fill", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("fill")))
        .select("source", "source_size", "weight", "target")
    )


def _digest(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id")))


def _cuts(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, seed: int = 17, levels: int = 2
) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size and digest of docs; of each source (of): source_size, target, whole epochs, and the last and filling digest taken once more."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _digest(seed).alias("digest"))
    sized = save(sized, "mix-sizes")
    sources = save(water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs), "mix-targets")
    sources = sources.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int").alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # The narrow range of digests in which each source's rest is reached, and what is left at its start.
    cut = sources.select("of", "rest", F.lit("").alias("head"))
    for level in range(levels):
        width = 3 * (level + 1)
        part = sized.join(cut, F.col("source").eqNullSafe(F.col("of")) & F.col("digest").startswith(F.col("head")))
        sums = part.groupBy("of", "rest", F.substring("digest", 1, width).alias("range")).agg(F.sum("size").alias("sum"))
        run = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("sum").over(run))
        # The first range that goes beyond the rest; sources whose rest is 0 or not exceeded have their cut at the end.
        cut = save(
            sums.where(F.col("upto") > F.col("rest"))
            .groupBy("of")
            .agg(F.min(F.struct("range", (F.col("rest") - F.col("upto") + F.col("sum")).alias("rest"))).alias("m"))
            .select("of", F.col("m.rest").alias("rest"), F.col("m.range").alias("head")),
            f"mix-cut{level}",
        )
    order = Window.partitionBy("source").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = (
        sized.join(cut, F.col("source").eqNullSafe(F.col("of")) & F.col("digest").startswith(F.col("head")))
        .withColumn("upto", F.sum("size").over(order))
        .where(F.col("upto") <= F.col("rest"))
        .groupBy(F.col("source").alias("at"))
        .agg(F.max("digest").alias("last"), F.max("upto").alias("got"))
    )
    begun = save(
        sources.join(cut.select(F.col("of").alias("at"), "head", F.col("rest").alias("within")), F.col("of").eqNullSafe(F.col("at")), "left")
        .drop("at")
        .join(at_cut, F.col("of").eqNullSafe(F.col("at")), "left")
        .select(
            "of",
            "source_size",
            "target",
            "whole",
            # Digests up to `last` are taken once more; if none at the cut is, those before its range.
            F.when(F.col("rest") > 0, F.coalesce("last", "head", F.lit("g"))).otherwise("").alias("last"),
            F.coalesce(F.col("within") - F.coalesce("got", F.lit(0)), F.lit(0.0)).alias("gap"),
        ),
        "mix-begun",
    )
    miss = F.abs(F.col("size") - F.col("gap"))
    filler = (
        sized.join(begun.where(F.col("gap") > 0), F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("digest") > F.col("last")) & (miss < F.col("gap")))
        .groupBy(F.col("source").alias("at"))
        .agg(F.min(F.struct(miss.alias("miss"), "digest")).getField("digest").alias("filler"))
    )
    ends = save(begun.join(filler, F.col("of").eqNullSafe(F.col("at")), "left").drop("at", "gap"), "mix-ends")
    return sized, ends


def _repeats(digest: Column) -> Column:
    """How often a row joined to its source's cuts is taken."""
    return F.col("whole") + ((digest <= F.col("last")) | (digest == F.coalesce("filler", F.lit("")))).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_epochs: float = 3.0, seed: int = 17, levels: int = 2) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, size, source, source_size, target, repeats, taken (= size * repeats). A source's target is as many
    whole epochs as fit, plus documents in the order of their seeded digest until the rest is reached, and
    one more whose size comes nearest to what is then left. The cut is found by sums over 4096 ranges of the digest, `levels` times in
    turn, so that only documents of one narrow range are ordered, however large a source is.

    A null text has size 0; a null source is a source of its own; an empty table gives none. Repeated rows are
    documents of their own; those of one doc_id share a digest and are ordered by size.
    """
    sized, ends = _cuts(docs, weights, share, max_epochs, seed, levels)
    return (
        sized.join(ends, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("repeats", _repeats(F.col("digest")))
        .select("doc_id", "size", "source", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The documents of the mix, each row as often as mix() takes it: repeats are found on the row itself, not by doc_id."""
    _, ends = _cuts(docs, seed=seed, **options)
    row = docs.select(F.struct(*docs.columns).alias("row"), "source", _digest(seed).alias("digest"))
    joined = row.join(ends, F.col("source").eqNullSafe(F.col("of"))).withColumn("repeats", _repeats(F.col("digest"))).where("repeats > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), "repeats"))).select("row.*")
