"""Names and labels: methods, cell types, factors, samples, regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def display_name(method: Column, replacements: list[tuple[str, str]]) -> Column:
    """Literal replacements, in order."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), replacements, method)


def has_prefix(method: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [method.startswith(p) for p in prefixes], F.lit(False))


# Last words of the taxonomy's names that mark neurons.
NEURONS = ["Gaba", "Glut", "Gly-Gaba", "Dopa-Gaba", "Hist-Gaba", "Gaba-Glut", "Dopa", "Glut-Sero", "Gaba-Chol", "Chol", "Glut-Chol", "Glyc-Gaba"]


def normal_label(label: Column, names: dict[str, str], neurons: list[str] | None = None) -> Column:
    """The last word of a taxonomy name: with 'Neurons-' before it where it is one of `neurons`; of a name that ends in NN all
    words before that; in any case without leading digits. Then by a dictionary; null stays null."""
    tokens = F.split(F.trim(label), r"\s+")
    last = F.element_at(tokens, -1)
    plain = lambda c: F.regexp_replace(c, r"^\d+\s*", "")
    short = F.when(last == "NN", plain(F.regexp_replace(F.trim(label), " NN$", ""))).when(last.isin(*(NEURONS if neurons is None else neurons)), F.concat(F.lit("Neurons-"), last)).otherwise(plain(last))
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), short), short) if pairs else short


def two_hop(df: DataFrame, key: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """df with label: first(key, mid), then the first entry of second(mid, labels), else mid itself."""
    return df.join(first, key, "left").join(second, "mid", "left").withColumn("label", F.coalesce(F.get("labels", F.lit(0)), F.col("mid"))).drop("labels", "mid")


def sample_name(cohort: Column, slide: Column, region: Column) -> Column:
    """{cohort}_s{slide}_r{region}, null unless all are there."""
    return F.when(cohort.isNotNull() & slide.isNotNull() & region.isNotNull(), F.concat(cohort, F.lit("_s"), slide, F.lit("_r"), region))


def condition_name(genotype: Column, age: Column) -> Column:
    """{genotype}_{age}; the genotype alone where no age is there, null without genotype."""
    return F.when(genotype.isNotNull(), F.concat_ws("_", genotype, age.cast("string")))


def cohort_samples(meta: DataFrame, cohort: str, excluded: DataFrame, extra: DataFrame) -> DataFrame:
    """Samples of a cohort without the excluded ones, and fixed further ones."""
    return meta.where(F.col("cohort") == cohort).select("sample").join(excluded, "sample", "left_anti").unionByName(extra.select("sample")).distinct()


def subset_regions(cells: DataFrame, column: str, wanted: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Cells of the regions of an alias or a comma list; all cells when none of them is present."""
    names = aliases.get(wanted, [x.strip() for x in wanted.split(",")])
    hit = cells.where(F.col(column).isin(*names))
    return hit if hit.limit(1).count() else cells


def columns_like(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.select([c for c in df.columns if any(p in c for p in parts)])


def crop(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points in a box; polygons whose box meets it."""
    if "x" in df.columns:
        return df.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return df.where((F.array_max("xs") >= x0) & (F.array_min("xs") <= x1) & (F.array_max("ys") >= y0) & (F.array_min("ys") <= y1))


def quantised(pixels: DataFrame, x0: float, y0: float, block: int = 2000) -> DataFrame:
    """BLOCK, X, Y in hundredths from an origin, blocks of 2000, sorted within partitions by block and Y. Ranges go on
    over Y and X, as most points may lie in one block."""
    x, y = F.bround("x", 1), F.bround("y", 1)
    out = pixels.withColumns({"BLOCK": (((x - x0) / block).cast("int") * block), "X": F.greatest(((x - x0) * 100).cast("int"), F.lit(0)), "Y": F.greatest(((y - y0) * 100).cast("int"), F.lit(0))})
    return out.repartitionByRange("BLOCK", "Y", "X").sortWithinPartitions("BLOCK", "Y")


def add_runner_pairs(methods: DataFrame) -> DataFrame:
    """Each method with the one before it by name."""
    from pyspark.sql import Window

    return methods.select("method").distinct().withColumn("prior", F.lag("method").over(Window.orderBy("method"))).where("prior is not null")  # a few dozen names
