"""Line dedup by a tree of log templates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.llm.shared import save

_BLANK = r"[\x20\x09-\x0D]"
FIELD = "<*>"


def masked(line: Column) -> Column:
    """A line with single blanks, in which each token that holds a digit has become a variable field."""
    plain = F.trim(F.regexp_replace(line, f"{_BLANK}+", " "))
    return F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", FIELD)


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """One row for each line that is not blank: doc_id, v (a digest of the text), pos, line (masked), key, leaf, size.

    Saved once, by columns: later steps read numbers only, and the masked text of few lines.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    each = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("v"), F.posexplode(split).alias("pos", "raw"))
    each = each.select("doc_id", "v", "pos", masked(F.col("raw")).alias("line")).where("line <> ''")
    told = each.withColumn("tokens", F.split("line", " "))
    leaf = F.xxhash64(F.size("tokens"), *[F.get("tokens", F.lit(i)) for i in range(depth)])
    told = told.select("doc_id", "v", "pos", "line", F.xxhash64("line").alias("key"), leaf.alias("leaf"), F.size("tokens").alias("size"))
    return save(told, "lines-masked")


def _recurring(lines: DataFrame, min_docs: int, depth: int, min_fixed: float) -> DataFrame:
    """Keys of lines whose template recurs, with the number of documents: key, docs."""
    # Documents first, then lines: repeated rows and a line's repeats in one document fall together.
    once = lines.groupBy("key", "leaf", "size", "doc_id", "v").agg(F.lit(1).alias("one"))
    known = save(once.groupBy("key", "leaf", "size").agg(F.count("*").alias("docs")), "lines-distinct")
    # A template of several lines needs a leaf with several that hold so many documents; most leaves have one line.
    leaves = known.where(F.col("size") > depth).groupBy("leaf").agg(F.count("*").alias("members"), F.sum("docs").alias("all"))
    leaves = save(leaves.where((F.col("members") > 1) & (F.col("all") >= min_docs)).select("leaf"), "lines-leaves")
    wanted = save(known.where(F.col("size") > depth).join(leaves, "leaf").select("key", "leaf", "docs"), "lines-wanted")
    # Tables of keys grow with the corpus: the lines meet them by a merge at every size.
    texts = lines.select("key", "line").join(wanted.select("key").hint("merge"), "key", "left_semi").distinct()
    open_rows = save(texts.join(wanted, "key").select("key", "leaf", "docs", F.split("line", " ").alias("tokens")), "lines-open")
    spread = open_rows.select("key", "leaf", "docs", F.posexplode("tokens").alias("pos", "token"))
    fixed = save(spread.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).drop("n"), "lines-fixed")
    shaped = (
        spread.join(fixed.withColumn("stays", F.lit(True)), ["leaf", "pos", "token"], "left")
        .groupBy("key", "leaf", "docs")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("stays"), F.col("token")).otherwise(FIELD).alias("token")))).alias("t"),
            F.avg(F.when(F.col("stays") & (F.col("token") != FIELD), 1.0).otherwise(0.0)).alias("share"),
        )
        .where(F.col("share") >= min_fixed)
    )
    shaped = save(shaped.select("key", "docs", F.xxhash64("leaf", F.col("t.token")).alias("template")), "lines-shaped")
    # Sums count a document again for each of its lines of a template: they bound the number of documents, which is then
    # counted where no single line has enough of them.
    several = shaped.groupBy("template").agg(F.sum("docs").alias("all"), F.max("docs").alias("most"))
    several = save(several.where(F.col("all") >= min_docs), "lines-several")
    strong = several.where(F.col("most") >= min_docs).select("template", F.col("most").alias("docs"))
    asked = save(shaped.join(several.where(F.col("most") < min_docs), "template").select("key", "template"), "lines-asked")
    met = lines.select("key", "doc_id", "v").join(asked.hint("merge"), "key").select("template", "doc_id", "v").distinct()
    counted = met.groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    by_template = shaped.select("key", "template").join(save(strong.unionByName(counted), "lines-counted"), "template").select("key", "docs")
    alone = known.where(F.col("docs") >= min_docs).select("key", "docs")
    return save(alone.unionByName(by_template).groupBy("key").agg(F.max("docs").alias("docs")), "lines-recurring")


def recurring_lines(docs: DataFrame, min_docs: int = 10, depth: int = 2, min_fixed: float = 0.6) -> DataFrame:
    """Masked lines whose template recurs in at least min_docs documents: columns key (hash of the masked line), docs.

    The tree has a fixed depth: the number of tokens, then the `depth` leading tokens lead to a leaf. A masked line weighs
    as much as it has documents. In a leaf, a token whose lines weigh less than min_docs at its place becomes a variable
    field. If at least `min_fixed` of a line's tokens stay, what results is its template; else, and for lines of no more
    than `depth` tokens, the line is its own template. A template recurs if at least min_docs documents hold a line of it.

    Documents are told apart by doc_id and a digest of the text: repeated rows, and repeats within one document, count
    once. Lines are counted before they meet, so a line's number of copies never gathers in one task.
    """
    return _recurring(_lines(docs, depth), min_docs, depth, min_fixed)


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, depth: int = 2, min_fixed: float = 0.6) -> DataFrame:
    """Rows of docs without the lines whose template recurs: doc_id, n_lines, n_dropped, kept (the lines left, joined).

    Lines end at "\\n"; blank lines always stay. A null text is one blank line. Rows are told apart by doc_id (null is an
    id of its own) and a digest of the text, so repeated rows each come out; documents count towards a template once
    each. An empty table gives none; other columns of docs are not looked at.
    """
    masked_lines = _lines(docs, depth)
    gone = _recurring(masked_lines, min_docs, depth, min_fixed).select("key")
    hit = masked_lines.select("doc_id", "v", "pos", "key").join(gone.hint("merge"), "key")
    lists = save(hit.groupBy(F.col("doc_id").alias("of"), F.col("v").alias("ov")).agg(F.sort_array(F.collect_set("pos")).alias("dropped")), "lines-dropped")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("v"))
    joined = rows.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("v") == F.col("ov")), "left")
    text = F.coalesce("text", F.lit(""))
    # The lines between two that go, as slices: the work grows with the lines, not with lines times those that go.
    none = F.array().cast("array<int>")
    cut = joined.select("doc_id", "text", F.split(text, "\n").alias("lines"), F.coalesce("dropped", none).alias("dropped"))
    ends = F.concat("dropped", F.array(F.size("lines")))
    between = F.transform(ends, lambda end, i: F.struct((F.coalesce(F.get("dropped", i - 1), F.lit(-1)) + 1).alias("from"), end.alias("to")))
    kept = F.array_join(F.flatten(F.transform(between, lambda b: F.slice("lines", b["from"] + 1, b["to"] - b["from"]))), "\n")
    return cut.select("doc_id", F.size("lines").alias("n_lines"), F.size("dropped").alias("n_dropped"), F.when(F.size("dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"))
