"""Cross-entropy difference: how much better a target language model predicts a text than a background model does.

Both models are word-bigram models with Witten-Bell interpolation down to words. Their counts are tables that Spark
shuffles: texts become chunks of word numbers, chunks tell their pairs (packed, by ranges of pairs) to the tables of
counts, and the tables answer each chunk. What is gathered grows with the different pairs of the corpus; only totals by
word number, of which there are as many as the vocabulary has, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm import textcols
from spotloom.llm.shared import drop_saved, save

#: Both models share one vocabulary: classes of lower-case words by hash; 0 stands before a text's first word.
VOCABULARY = 1 << 16
#: Words of a chunk (besides one text that is longer), and words for each range of pairs, up to so many ranges.
CHUNK_WORDS, RANGE_WORDS, MOST_RANGES = 1 << 19, 1 << 21, 1 << 12

_SPREAD = np.uint32(2654435761)  # odd, so a pair can be told from its spread number
_GATHER = np.uint32(pow(2654435761, -1, 1 << 32))
_STATS = ("n_context", "n_kinds", "n_word", "t_context", "t_kinds", "t_word")
_CHUNKS = "chunk long, doc_id array<long>, hit array<boolean>, size array<long>, words binary, n long"
_PAIRS = "part int, chunk long, pairs binary, n binary, t binary"


def word_numbers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word (1 to VOCABULARY - 1), and the first word of each text. A-Z count as lower case."""
    raw = textcols.lower_ascii(raw)
    starts, ends, firsts = textcols.words(raw, offsets)
    h = textcols.PrefixHash(raw).of(starts, ends)
    return (1 + (h >> np.uint64(32)) % np.uint64(VOCABULARY - 1)).astype(np.uint16), firsts


def _packed(x: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold the largest."""
    top = int(x.max()) if len(x) else 0
    return x.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{max(1, len(data) // max(1, n))}").astype(np.int64)


def _spread_pairs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spread number of each word's pair with the one before it in its text."""
    before = np.zeros(len(words), np.uint32)
    before[1:] = words[:-1]
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[firsts] = 0
    return (before * np.uint32(VOCABULARY) + words) * _SPREAD


def _chunks(docs: DataFrame, target: DataFrame) -> DataFrame:
    chosen = target.select(F.col("doc_id").cast("long").alias("of"), F.lit(True).alias("hit")).distinct()
    # The target grows with the corpus: it is joined by a merge at every size.
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(chosen.hint("merge"), F.col("doc_id") == F.col("of"), "left")

    most = CHUNK_WORDS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, number = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal held, count, number
            docs_of, hits, sizes, words = (pa.concat_arrays(x) if k < 2 else np.concatenate(x) for k, x in enumerate(zip(*held, strict=True)))
            out = {"chunk": [number], "doc_id": [docs_of], "hit": [hits], "size": [sizes], "words": [words.astype("<u2").tobytes()], "n": [len(words)]}
            held, count, number = [], 0, number + 1
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int64())
        for batch in batches:
            for part in textcols.chunks(batch):
                words, firsts = word_numbers(*textcols.utf8(part["text"]))
                held.append((part["doc_id"], part["hit"].fill_null(False), np.diff(firsts), words))
                count += len(words)
                if count >= most:
                    yield flush()
        if held:
            yield flush()

    return save(marked.select("doc_id", "text", "hit").mapInArrow(cut, _CHUNKS), "lm-chunks")


def _pairs(chunks: DataFrame, bits: int) -> DataFrame:
    """The different pairs of each chunk with their counts in all texts (n) and in those of the target (t), by ranges.

    They are told again where they are needed again: that takes less than a table of them."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, sizes = np.frombuffer(batch["words"][i].as_buffer(), "<u2"), batch["size"][i].values.to_numpy()
                pairs = _spread_pairs(words, sizes)
                known, n = np.unique(pairs, return_counts=True)
                hit = batch["hit"][i].values.to_numpy(zero_copy_only=False)
                of_target, m = np.unique(pairs[np.repeat(hit, sizes)], return_counts=True)
                t = np.zeros(len(known), np.int64)
                t[np.searchsorted(known, of_target)] = m
                at = np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).tolist() + [len(known)]
                rows = [(p, a, b) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([p for p, _, _ in rows], pa.int32()),
                        "chunk": pa.array([batch["chunk"][i].as_py()] * len(rows), pa.int64()),
                        "pairs": pa.array([known[a:b].tobytes() for _, a, b in rows], pa.binary()),
                        "n": pa.array([_packed(n[a:b]) for _, a, b in rows], pa.binary()),
                        "t": pa.array([_packed(t[a:b]) for _, a, b in rows], pa.binary()),
                    }
                )

    return chunks.mapInArrow(tell, _PAIRS)


def _counts(pairs: DataFrame) -> DataFrame:
    """One row for each range of pairs: all its different pairs and their counts. A range's rows are added up one by one."""

    def add(rows: list[tuple]) -> tuple:
        known, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        sums = [np.zeros(len(known), np.int64) for _ in range(2)]
        for k in (1, 2):
            np.add.at(sums[k - 1], at, np.concatenate([r[k] for r in rows]))
        return known, *sums

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def row() -> pa.RecordBatch:
            known, n, t = add(held)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "chunk": pa.array([-1], pa.int64()), "pairs": [known.tobytes()], "n": [_packed(n)], "t": [_packed(t)]}
            )

        for batch in batches:
            for i in range(batch.num_rows):
                if batch["part"][i].as_py() != part:
                    if held:
                        yield row()
                    part, held, size = batch["part"][i].as_py(), [], 0
                known = np.frombuffer(batch["pairs"][i].as_buffer(), "<u4")
                held.append((known, _unpacked(batch["n"][i].as_py(), len(known)), _unpacked(batch["t"][i].as_py(), len(known))))
                size += len(known)
                if size > max(1 << 20, 2 * len(held[0][0])):
                    held = [add(held)]
                    size = len(held[0][0])
        if held:
            yield row()

    return save(pairs.repartition("part").sortWithinPartitions("part").mapInArrow(total, _PAIRS), "lm-counts")


def _totals(counts: DataFrame) -> np.ndarray:
    """Of each word number, in both models: how often it comes before a word, how many different words follow it, and how
    often it occurs. VOCABULARY rows, whatever the corpus."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((VOCABULARY, len(_STATS)), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                key = np.frombuffer(batch["pairs"][i].as_buffer(), "<u4") * _GATHER
                before, word = (key // np.uint32(VOCABULARY)).astype(np.int64), (key % np.uint32(VOCABULARY)).astype(np.int64)
                for k, c in ((0, "n"), (3, "t")):
                    c = _unpacked(batch[c][i].as_py(), len(key))
                    for j, (x, w) in enumerate(((before, c), (before, c > 0), (word, c))):
                        out[:, k + j] += np.bincount(x, w, VOCABULARY).astype(np.int64)
        some = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_pydict({"word": pa.array(some), **{c: pa.array(out[some, k]) for k, c in enumerate(_STATS)}})

    each = counts.mapInArrow(sums, "word long, " + ", ".join(f"{c} long" for c in _STATS))
    rows = each.groupBy("word").agg(*[F.sum(c).alias(c) for c in _STATS]).toPandas()
    out = np.zeros((VOCABULARY, len(_STATS)), np.int64)
    out[rows["word"].to_numpy()] = rows[list(_STATS)].to_numpy()
    return out


def _answers(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """For each row of pairs the counts of its pairs in the whole corpus, in the same order."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = n = t = None
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch["pairs"][i].as_buffer(), "<u4")
                if batch["chunk"][i].as_py() < 0:  # the row of counts comes before those it answers
                    known, n, t = own, _unpacked(batch["n"][i].as_py(), len(own)), _unpacked(batch["t"][i].as_py(), len(own))
                    continue
                at = np.searchsorted(known, own)
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": batch["chunk"].slice(i, 1),
                        "part": batch["part"].slice(i, 1),
                        "size": pa.array([len(own)]),
                        "all": pa.array([_packed(n[at])], pa.binary()),
                        "target": pa.array([_packed(t[at])], pa.binary()),
                    }
                )

    none = F.lit(None).cast("binary")
    both = pairs.select("part", "chunk", "pairs", none.alias("n"), none.alias("t")).unionByName(counts)
    dealt = both.repartition("part").sortWithinPartitions("part", "chunk")
    return save(dealt.mapInArrow(answer, "chunk long, part int, size long, all binary, target binary"), "lm-answers")


def _runs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that share key and doc (ascending): for each word the number of its run, each run's length and first word."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    length = np.diff(np.append(first, len(k)))
    of = np.empty(len(k), np.int64)
    of[order] = np.repeat(np.arange(len(first)), length)
    return of, length, order[first]


def losses(words: np.ndarray, sizes: np.ndarray, hit: np.ndarray, every: np.ndarray, target: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss in bits of each word under the target and the background model, each without the counts of the word's own text.

    every, target: corpus counts of the chunk's different pairs in their order; totals: see _totals().
    """
    pairs = _spread_pairs(words, sizes)
    before = ((pairs * _GATHER) // np.uint32(VOCABULARY)).astype(np.int64)
    words = words.astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    different = np.unique(pairs)
    pair, pair_n, pair_first = _runs(pairs, doc)
    context, context_n, _ = _runs(before, doc)
    word, word_n, _ = _runs(words, doc)
    out = []
    for counts, stats, inside in ((target, totals[:, 3:], hit[doc]), (every, totals[:, :3], np.ones(len(words), bool))):
        own = inside.astype(np.int64)
        count = counts[np.searchsorted(different, pairs)]
        only = (count[pair_first] == pair_n) & inside[pair_first]  # pairs that no other text has
        only = np.bincount(context[pair_first], only, len(context_n)).astype(np.int64)[context]
        c = count - own * pair_n[pair]
        n_context = stats[before, 0] - own * context_n[context]
        kinds = stats[before, 1] - only
        n_word = stats[words, 2] - own * word_n[word]
        single = (n_word + 1) / (stats[:, 2].sum() - own * sizes[doc] + VOCABULARY - 1)
        seen = n_context + kinds
        out.append(-np.log2(np.where(seen > 0, (c + kinds * single) / np.maximum(seen, 1), single)))
    return out[0], out[1]


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference (mean bits a word) for each row of docs.

    The background model is fitted on all docs, the target model on those whose doc_id is in target: the same kind of
    model with the same smoothing over one vocabulary, so their losses can be compared word by word. No text is scored by
    its own counts: they are left out of both models. A word's probability is that of Witten and Bell behind the word
    before it, (count + kinds * p) / (contexts + kinds), with p = (count + 1) / (words + VOCABULARY - 1) of the word alone.

    A negative difference means that a text is closer to the target. Null texts, and texts without words, have no
    tokens and null losses; with no target rows the target model is uniform; repeated rows are texts of their own and
    hence known from each other; rows without doc_id are never in the target. An empty table gives none.
    """
    chunks = _chunks(docs, target)
    n = chunks.agg(F.sum("n")).head()[0] or 0
    bits = min(max(0, -(-n // RANGE_WORDS) - 1).bit_length(), MOST_RANGES.bit_length() - 1)
    pairs = _pairs(chunks, bits)
    counts = _counts(pairs)
    totals = docs.sparkSession.sparkContext.broadcast(_totals(counts))
    answers = _answers(pairs, counts)
    drop_saved(counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, every, of_target = None, [], []

        def scored() -> pa.RecordBatch:
            batch, i = chunk
            sizes = batch["size"][i].values.to_numpy()
            firsts = np.cumsum(sizes) - sizes
            words, hit = np.frombuffer(batch["words"][i].as_buffer(), "<u2"), batch["hit"][i].values.to_numpy(zero_copy_only=False)
            none, mean = sizes == 0, []
            counted = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (every, of_target)]
            for x in losses(words, sizes, hit, *counted, totals.value):
                m = np.zeros(len(sizes))
                if len(x):
                    m[~none] = np.add.reduceat(x, firsts[~none]) / sizes[~none]
                mean.append(m)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"][i].values,
                    "n_tokens": pa.array(sizes),
                    "target_loss": pa.array(mean[0], mask=none),
                    "background_loss": pa.array(mean[1], mask=none),
                    "difference": pa.array(mean[0] - mean[1], mask=none),
                }
            )

        for batch in batches:
            for i in range(batch.num_rows):
                if batch["part"][i].as_py() < 0:  # a chunk comes before the answers to it
                    if chunk:
                        yield scored()
                    chunk, every, of_target = (batch, i), [], []
                    continue
                size = batch["n"][i].as_py()
                every.append(_unpacked(batch["all"][i].as_py(), size))
                of_target.append(_unpacked(batch["target"][i].as_py(), size))
        if chunk:
            yield scored()

    none = F.lit(None).cast("binary")
    asked = chunks.select("chunk", F.lit(-1).alias("part"), "doc_id", "hit", "size", "words", "n", none.alias("all"), none.alias("target"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "array<long>"), ("hit", "array<boolean>"), ("size", "array<long>"), ("words", "binary"))]
    told = answers.select("chunk", "part", *empty, F.col("size").alias("n"), "all", "target")
    dealt = asked.unionByName(told).repartition("chunk").sortWithinPartitions("chunk", "part")
    out = save(dealt.mapInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"), "lm-scores")
    drop_saved(chunks, answers)
    return out
