"""Windows that occur more than once in a corpus: repeated byte strings and repeated word sequences.

Both operators first cut each document into runs of windows that share an anchor (the least gram hash in the window).
Equal windows have equal anchors, so only runs whose anchor occurs again can hold a repeated window. What a run covers
gets a BLAKE2b digest (128 bits with bytes; 64 with words, beside 128 of hashes): runs that are equal as a whole are
settled by counting, and only one of each goes on to be compared window by window. All counting is pre-aggregated, so thousands of copies come down to one row for each
chunk of text.

Documents are told apart by doc_id and a digest of their text, so rows that share a doc_id do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.llm import suffixes, textcols
from spotloom.llm.shared import drop_saved, save

_START_BITS, _PLACE_BITS = 39, 16
_NONE = (1 << 63) - 1  # stands for a null doc_id, which is larger than any other
#: Anchors with more different runs than this are split by what surrounds them before they are sorted.
HOT_RUNS = 1024
#: Windows of a split anchor stay together when they start within so many bytes.
_PIECE = 8


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a digest of 24 bits of the text."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("v", F.xxhash64("text").bitwiseAND((1 << 24) - 1))


def _units(part: pa.RecordBatch, unit: str) -> tuple[textcols.PrefixHash, np.ndarray]:
    raw, offsets = textcols.utf8(part["text"])
    if unit == "bytes":
        return textcols.PrefixHash(raw), offsets
    starts, ends, firsts = textcols.words(raw, offsets)
    return textcols.PrefixHash(textcols.PrefixHash(raw).of(starts, ends)), firsts


def _anchors(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """anchor, n (places), least and most (doc_id, null as _NONE): one row for each chunk of text that an anchor occurs in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcols.chunks(batch):
                anchor, *_, row = textcols.anchors(*_units(part, unit), window, gram)
                doc = part["doc_id"].fill_null(_NONE).to_numpy(zero_copy_only=False)[row]
                order = np.argsort(anchor)
                anchor, doc = anchor[order], doc[order]
                first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(anchor[first].view(np.int64)),
                        "n": pa.array(np.diff(np.append(first, len(anchor)))),
                        "least": pa.array(np.minimum.reduceat(doc, first) if len(first) else doc),
                        "most": pa.array(np.maximum.reduceat(doc, first) if len(first) else doc),
                    }
                )

    return docs.mapInArrow(cut, "anchor long, n long, least long, most long")


def _digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of ranges of bytes, as two integers each."""
    data, blake = memoryview(raw.tobytes()), hashlib.blake2b
    joined = b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _runs(docs: DataFrame, unit: str, window: int, gram: int, double: bool = False) -> DataFrame:
    """Runs of windows: anchor, run and, of bytes, again (digest), doc_id, at (v and first window), size (number of windows, anchor's place).

    With `double`, a run has only windows that hold one and the same gram of twice the length around the anchor, and half
    is its hash: the gram goes on to the right of the anchor where every such window has room for that, else to the left.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcols.chunks(batch):
                raw, offsets = textcols.utf8(part["text"])
                begin, end = np.arange(len(raw)), np.arange(1, len(raw) + 1)
                prefix = textcols.PrefixHash(raw)
                if unit == "words":
                    begin, end, offsets = textcols.words(raw, offsets)
                    prefix = textcols.PrefixHash(prefix.of(begin, end))
                anchor, first, count, place, row = textcols.anchors(prefix, offsets, window, gram)
                cols = {}
                if double:
                    leftward = np.clip(place - (window - 2 * gram), 0, count)  # windows with too little room on the right come first
                    both = np.column_stack([leftward, count - leftward]).ravel()
                    left = np.tile([True, False], len(count))[both > 0]
                    two = lambda x: np.repeat(x, 2)[both > 0]
                    shift = two(leftward) * ~left
                    anchor, row, first, place, count = two(anchor), two(row), two(first) + shift, two(place) - shift, both[both > 0]
                    at = first + place - gram * left
                    cols["half"] = pa.array(prefix.of(at, at + 2 * gram).view(np.int64))
                digest = _digests(raw, begin[first], end[first + count + window - 2]) if len(first) else np.zeros((0, 2), np.int64)
                v = part["v"].to_numpy()
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(anchor.view(np.int64)),
                        **cols,
                        "run": pa.array(digest[:, 0]),
                        **({} if unit == "words" else {"again": pa.array(digest[:, 1])}),
                        "doc_id": part["doc_id"].take(pa.array(row)),
                        "at": pa.array((v[row] << _START_BITS) | (first - offsets[row])),
                        "size": pa.array((count << _PLACE_BITS) | place),
                    }
                )

    return docs.mapInArrow(cut, f"anchor long, {'half long, ' * double}run long, {'again long, ' * (unit == 'bytes')}doc_id long, at long, size long")


def _v() -> Column:
    return F.shiftright("at", _START_BITS).alias("v")


def _start() -> Column:
    return F.col("at").bitwiseAND((1 << _START_BITS) - 1).alias("start")


def _n() -> Column:
    return F.shiftright("size", _PLACE_BITS).alias("n")


def _cut_out(docs: DataFrame, runs: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Apply kernel(doc_id, v, prefix hash, bytes, runs of the document) to documents that have runs of interest."""
    lists = runs.groupBy(F.col("doc_id").alias("of"), F.col("v").alias("ov")).agg(F.collect_list(F.struct(*[c for c in runs.columns if c not in ("doc_id", "v")])).alias("runs"))
    both = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("v") == F.col("ov"))).select("doc_id", "v", "text", "runs")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcols.chunks(batch):
                yield from kernel(part)

    return both.mapInArrow(each, schema)


def _list_of(part: pa.RecordBatch, name: str = "runs") -> tuple[np.ndarray, pa.StructArray]:
    """Row of each list entry, and the entries."""
    lists = part[name]
    return textcols.row_of(lists.offsets.to_numpy()), lists.flatten()


def _ranges_by_doc(found: DataFrame, name: str) -> DataFrame:
    """found(doc_id, v, start, n) as lists of one document each; no list is longer than its document."""
    lists = found.groupBy(F.col("doc_id").alias("of"), F.col("v").alias("ov")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))).alias("ranges"))
    return save(lists, name)


def _apply(docs: DataFrame, ranges: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    both = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("v") == F.col("ov")), "left").select("doc_id", "text", "ranges")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcols.chunks(batch):
                yield kernel(part)

    return both.mapInArrow(each, schema)


def _covered(n_units: int, offsets: np.ndarray, part: pa.RecordBatch, window: int) -> np.ndarray:
    """Which units the windows in part's ranges cover."""
    row, entries = _list_of(part, "ranges")
    if not len(row):
        return np.zeros(n_units, bool)
    start = entries.field("start").to_numpy() + offsets[row]
    depth = np.zeros(n_units + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + entries.field("n").to_numpy() + window - 1, -1)
    return np.cumsum(depth[:-1]) > 0


def _hits(docs: DataFrame, unit: str, window: int, gram: int, again: str, double: bool = False) -> DataFrame:
    """Runs whose anchor occurs again (`again`: a condition on n, least and most of an anchor)."""
    anchors = _anchors(docs, unit, window, gram).groupBy("anchor").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    anchors = save(anchors.where(again).select("anchor"), "repeats-anchors")
    hits = save(_runs(docs, unit, window, gram, double).join(anchors, "anchor"), "repeats-hits")
    drop_saved(anchors)
    return hits


# --- byte strings ------------------------------------------------------------------------------------------------------


def repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 48, hot: int = HOT_RUNS) -> DataFrame:
    """Per document the ranges (start, n) of starts of `length`-byte strings that start anywhere else as well.

    Runs with one anchor are compared by suffix sorting in one task: polynomial prefix hashes and binary search give
    common extensions, merge sort orders the suffixes, equal neighbours are checked byte by byte. The runs of an anchor
    with more than `hot` different ones are first split into pieces, by how far their windows start before the anchor
    and by all bytes that such windows share; equal windows fall into one piece's group, and each group is sorted alike.

    Returns of, ov (doc_id and digest of the text), ranges. Strings never cross documents; null texts have no bytes;
    repeated rows are documents of their own and hence repeat each other.
    """
    whole, open_runs = _equal_runs(_hits(docs, "bytes", length, gram, "n > 1"))

    def pieces(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = textcols.utf8(part["text"])
        row, e = _list_of(part)
        start, size = e.field("start").to_numpy(), e.field("size").to_numpy()
        number, owner = textcols.ranges(np.zeros(len(size), np.int64), size >> _PLACE_BITS)
        place = (size & ((1 << _PLACE_BITS) - 1))[owner] - number
        zone = place // _PIECE
        first = np.flatnonzero(np.r_[True, (zone[1:] != zone[:-1]) | (owner[1:] != owner[:-1])])
        count = np.diff(np.append(first, len(zone)))
        owner, number, place, zone = owner[first], number[first], place[first], zone[first]
        core = start[owner] + number + place - _PIECE * zone + offsets[row[owner]]  # all windows of a zone hold these bytes
        begin = start[owner] + number + offsets[row[owner]]
        digest = _digests(raw, begin, begin + count + length - 1)
        anchor = e.field("anchor").to_numpy()[owner].view(np.uint64)
        key = textcols.mix(textcols.PrefixHash(raw).of(core, core + length - _PIECE + 1) + anchor * np.uint64(_PIECE * 2 + 1) + zone.astype(np.uint64))
        v = part["v"].to_numpy()[row[owner]]
        yield pa.RecordBatch.from_pydict(
            {
                "anchor": pa.array(key.view(np.int64)),
                "run": pa.array(digest[:, 0]),
                "again": pa.array(digest[:, 1]),
                "doc_id": part["doc_id"].take(pa.array(row[owner])),
                "at": pa.array((v << _START_BITS) | (start[owner] + number)),
                "size": pa.array((count << _PLACE_BITS) | place),
            }
        )

    def contents(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offsets = textcols.utf8(part["text"])
        row, e = _list_of(part)
        begin = e.field("start").to_numpy() + offsets[row]
        span = (e.field("size").to_numpy() >> _PLACE_BITS) + length - 1
        first = 0
        while first < len(span):  # contents overlap, so they may hold much more than the text
            total = np.cumsum(span[first : first + 65536])
            n = max(1, int(np.searchsorted(total, textcols.CHUNK_BYTES, "right")))
            at, _ = textcols.ranges(begin[first : first + n], span[first : first + n])
            bounds = np.concatenate([[0], total[:n]]).astype(np.int32)
            content = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(raw[at])])
            rows = pa.array(row[first : first + n])
            cols = {c: e.field(c).slice(first, n) for c in ("anchor", "c", "start", "size")}
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].take(rows), "v": part["v"].take(rows), **cols, "content": content})
            first += n

    schema = "doc_id long, v long, anchor long, c long, start long, size long, content binary"
    split = save(_cut_out(docs, open_runs.where(F.col("k") > hot), pieces, "anchor long, run long, again long, doc_id long, at long, size long"), "repeats-pieces")
    equal, open_pieces = _equal_runs(split)
    to_sort = open_runs.where(F.col("k") <= hot).unionByName(open_pieces).drop("k")
    cut = save(_cut_out(docs, to_sort, contents, schema), "repeats-contents")
    return _ranges_by_doc(whole.unionByName(equal).unionByName(_sorted_out(cut, length)), "repeats-ranges")


def _equal_runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of runs (anchor, run, again, doc_id, at, size): the ranges doc_id, v, start, n of those that occur again as a whole, and
    one of each of the others, if its anchor has several, to be compared window by window: doc_id, v, anchor, k (different
    runs of the anchor), c (how often it occurs), start, size."""
    same = ["anchor", "run", "again"]
    contexts = save(rows.groupBy(*same).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "at")).alias("rep"), F.min("size").alias("size")), "repeats-runs")
    copied = save(contexts.where("c > 1").select(*same), "repeats-copied")
    whole = rows.join(copied, same).select("doc_id", _v(), _start(), _n())
    several = save(contexts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "repeats-several")
    open_runs = contexts.join(several, "anchor").select("anchor", "k", "c", "rep.doc_id", F.col("rep.at").alias("at"), "size")
    return whole, save(open_runs.select("doc_id", _v(), "anchor", "k", "c", _start(), "size"), "repeats-unsettled")


def _runs_of(hit: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of each run of hits; joined[i]: i belongs with i - 1."""
    on = hit & ~(np.r_[False, hit[:-1]] & joined)
    first = np.flatnonzero(on)
    return first, np.diff(np.append(np.cumsum(hit)[first] - 1, hit.sum()))


def _windows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of contents: the bytes, and for each window its first byte, its row and its number within the row."""
    content = part["content"]
    _, off, data = content.buffers()
    offsets = np.frombuffer(off, np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    n = part["size"].to_numpy() >> _PLACE_BITS
    at, row = textcols.ranges(offsets[:-1], n)
    return raw, at, row, at - offsets[row]


def _found(part: pa.RecordBatch, row: np.ndarray, number: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Ranges of the windows that are hit; those of rows with c > 1 are known already."""
    hit = hit & (part["c"].to_numpy() == 1)[row]
    first, n = _runs_of(hit, np.r_[False, row[1:] == row[:-1]])
    rows = pa.array(row[first])
    return pa.RecordBatch.from_pydict(
        {"doc_id": part["doc_id"].take(rows), "v": part["v"].take(rows), "start": pa.array(part["start"].to_numpy()[row[first]] + number[first]), "n": pa.array(n)}
    )


_FOUND = "doc_id long, v long, start long, n long"


def _sorted_out(cut: DataFrame, length: int, chunk: int = 2 << 20) -> DataFrame:
    """Suffix-sort the contents that share an anchor, whole anchors at a time and about `chunk` bytes of them."""

    def settle(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, at, row, number = _windows(part)
        # Equal windows have their anchor at equal places: only those with the same distance to it are compared.
        distance = (part["size"].to_numpy() & ((1 << _PLACE_BITS) - 1))[row] - number
        anchor = part["anchor"].to_numpy()
        group = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])[row]
        bucket = group * (2 << _PLACE_BITS) + distance + (1 << _PLACE_BITS)
        return _found(part, row, number, suffixes.repeated(raw, at, bucket, length))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch["content"].nbytes
            if size < chunk:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = table["anchor"].to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            if last:
                yield settle(table.slice(0, last).combine_chunks().to_batches()[0])
            held = table.slice(last).to_batches()
            size = sum(x["content"].nbytes for x in held) if last else 0
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(each, _FOUND)


def remove_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 48, hot: int = HOT_RUNS, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that starts anywhere else as well.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and on request kept (the bytes that
    stay, as binary: a cut may split a character) and spans. A null text counts as empty; one row comes out for each row
    that goes in.
    """
    keyed = _keyed(docs)
    ranges = repeated_bytes(keyed, length, gram, hot)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = textcols.utf8(part["text"])
        gone = _covered(len(raw), offsets, part, length)
        total = np.r_[0, np.cumsum(gone)]
        begins = gone & ~np.r_[False, gone[:-1]]
        inner = offsets[:-1][offsets[:-1] < len(raw)]
        begins[inner] |= gone[inner]
        spans = np.r_[0, np.cumsum(begins)]
        kept = memoryview(raw[~gone].tobytes())
        bounds = offsets - total[offsets]
        pieces = [kept[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        cols = {
            "doc_id": part["doc_id"],
            "n_bytes": pa.array(np.diff(offsets)),
            "n_removed": pa.array(np.diff(total[offsets])),
            "n_spans": pa.array(np.diff(spans[offsets])),
            "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()),
        }
        if with_text:
            cols["kept"] = pa.array([bytes(p) for p in pieces], pa.binary())
        return pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return _apply(keyed, ranges, kernel, schema)


# --- word sequences ----------------------------------------------------------------------------------------------------


def repeated_words(docs: DataFrame, length: int = 13) -> DataFrame:
    """Per document the ranges (start, n) of windows of `length` words that also start in a document with a smaller doc_id.

    Level-wise doubling: sequences of a quarter of the length are looked for first (4 words of 13), at anchors that every
    full window holds one of. Those that occur in several documents are extended to twice that length (8 words), those
    that still do to the full length, which joins overlapping halves; the result depends on no longer level. Each level
    sees only what the level before left. A null doc_id is larger than any other.
    """
    base = -(-length // 4)
    doc = F.coalesce("doc_id", F.lit(_NONE))
    double = 2 * base < length
    hits = _hits(docs, "words", length, base, "least < most", double)
    if double:
        halves = save(hits.groupBy("half").agg(F.min(doc).alias("least"), F.max(doc).alias("most")).where("least < most").select("half"), "repeats-halves")
        longer = save(hits.drop("anchor").join(halves, "half").withColumnRenamed("half", "anchor"), "repeats-doubled")
        drop_saved(hits, halves)
        hits = longer
    same = ["anchor", "run"]
    contexts = save(
        hits.groupBy(*same).agg(
            F.count("*").alias("c"), F.min(F.struct(doc.alias("d"), "doc_id", "at")).alias("rep"), F.max(doc).alias("last"), F.min("size").alias("size")
        ),
        "repeats-runs",
    )
    copied = save(contexts.where("rep.d < last").select(*same, F.col("rep.d").alias("least")), "repeats-copied")
    whole = hits.join(copied, same).where(doc > F.col("least")).select("doc_id", _v(), _start(), _n())
    several = save(contexts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "repeats-several")
    open_runs = contexts.join(several, "anchor").select("anchor", "rep.doc_id", F.col("rep.at").alias("at"), "size")
    # A run's least document may hold it at more places than the representative's: `whole` settles none of them.
    twice = save(contexts.where("c > 1").join(several, "anchor").select(*same, F.col("rep.d").alias("d"), F.col("rep.at").alias("first")), "repeats-twice")
    places = hits.join(twice, same).where((doc == F.col("d")) & (F.col("at") != F.col("first")))
    open_runs = open_runs.unionByName(places.select("anchor", "doc_id", "at", "size").distinct()).select("doc_id", _v(), "anchor", _start(), _n())

    def extend(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prefix, firsts = _units(part, "words")
        row, e = _list_of(part)
        at, owner = textcols.ranges(e.field("start").to_numpy() + firsts[row], e.field("n").to_numpy())
        rows = pa.array(row[owner])
        yield pa.RecordBatch.from_pydict(
            {
                "anchor": e.field("anchor").take(pa.array(owner)),
                "hash": pa.array(prefix.of(at, at + length).view(np.int64)),
                "doc_id": part["doc_id"].take(rows),
                "v": part["v"].take(rows),
                "start": pa.array(at - firsts[row[owner]]),
            }
        )

    windows = save(_cut_out(docs, open_runs, extend, "anchor long, hash long, doc_id long, v long, start long"), "repeats-windows")
    least = windows.groupBy("anchor", "hash").agg(F.min(doc).alias("least"), F.max(doc).alias("most")).where("least < most")
    later = windows.join(save(least.drop("most"), "repeats-least"), ["anchor", "hash"]).where(doc > F.col("least"))
    found = whole.unionByName(later.select("doc_id", "v", "start", F.lit(1).cast("long").alias("n")))
    return _ranges_by_doc(found, "repeats-ranges")


def remove_repeated_words(docs: DataFrame, length: int = 13, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of `length` words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces) and on request kept.
    Words are runs without ASCII white space. A null text has no words; rows that share a doc_id do not remove each
    other's words; one row comes out for each row that goes in.
    """
    keyed = _keyed(docs)
    ranges = repeated_words(keyed, length)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = textcols.utf8(part["text"])
        starts, ends, firsts = textcols.words(raw, offsets)
        gone = _covered(len(starts), firsts, part, length)
        total = np.r_[0, np.cumsum(gone)]
        data, kept = raw.tobytes(), []
        a, b = starts[~gone].tolist(), ends[~gone].tolist()
        bounds = (firsts - total[firsts]).tolist()
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            kept.append(b" ".join([data[x:y] for x, y in zip(a[i:j], b[i:j], strict=True)]))
        cols = {
            "doc_id": part["doc_id"],
            "n_words": pa.array(np.diff(firsts)),
            "n_removed": pa.array(np.diff(total[firsts])),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        if with_text:
            cols["kept"] = pa.array([k.decode() for k in kept], pa.string())
        return pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return _apply(keyed, ranges, kernel, schema)
