"""Token ids in length-delimited binary records with masked checksums and a separate offset index.

A shard part-NNNNN-*.rec holds one record for each document, in ascending doc_id order:

    uint64 length, uint32 masked crc32c of those 8 bytes, `length` bytes of payload, uint32 masked crc32c of the payload

all little-endian; the payload is the token ids as unsigned 16- or 32-bit integers. Beside it part-NNNNN-*.idx holds for
each record doc_id, offset, number of ids (int64 each) and whether doc_id is null (1 byte), for reads in any order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom.llm import textcols
from spotloom.llm.shared import new_path, save

END_ID = 2
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n", "<i8"), ("null", "u1")])
_MANIFEST = "shard int, name string, rows long, tokens long, bytes long"
_BLOCK = 64
_CHUNK = 1 << 20  # bytes of text encoded at once; each takes about a hundred bytes in the arrays of a look-up


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """crc32c of each byte by its distance from the end of a block; and what a block of zeros makes of each state byte."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (np.uint32(0x82F63B78) * (one & np.uint32(1)))
    by = np.empty((_BLOCK, 256), np.uint32)
    by[_BLOCK - 1] = one
    for j in range(_BLOCK - 2, -1, -1):
        by[j] = one[by[j + 1] & np.uint32(255)] ^ (by[j + 1] >> np.uint32(8))
    shift = np.stack([by[k] for k in range(4)])  # a state is XORed to the first four bytes of what follows
    return by, shift


_BY, _SHIFT = _tables()
_AT = np.arange(_BLOCK)


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """crc32c of each range offsets[i]:offsets[i + 1] of bytes."""
    sizes = np.diff(offsets)
    out = np.empty(len(sizes), np.uint32)
    for i in np.flatnonzero(sizes < 4):
        c = 0xFFFFFFFF
        for b in data[offsets[i] : offsets[i + 1]].tolist():
            c = int(_BY[_BLOCK - 1][(c ^ b) & 255]) ^ (c >> 8)
        out[i] = c ^ 0xFFFFFFFF
    long = np.flatnonzero(sizes >= 4)
    if not len(long):
        return out
    n_blocks = -(-sizes[long] // _BLOCK)
    ends = np.cumsum(n_blocks)
    blocks = np.zeros(int(ends[-1]) * _BLOCK, np.uint8)
    first = ends * _BLOCK - sizes[long]  # zeros come before the bytes, which changes no checksum that starts at 0
    for at, start, size in zip(first.tolist(), offsets[long].tolist(), sizes[long].tolist(), strict=True):
        blocks[at : at + size] = data[start : start + size]
    for k in range(4):
        blocks[first + k] ^= 255
    crcs = np.bitwise_xor.reduce(_BY[_AT, blocks.reshape(-1, _BLOCK)], axis=1)
    begin = ends - n_blocks
    state, order = np.zeros(len(long), np.uint32), np.argsort(-n_blocks, kind="stable")
    counts = n_blocks[order]
    for k in range(int(counts[0])):
        on = order[: np.searchsorted(-counts, -k, "left")]
        s = state[on]
        s = _SHIFT[0][s & 255] ^ _SHIFT[1][(s >> 8) & 255] ^ _SHIFT[2][(s >> 16) & 255] ^ _SHIFT[3][s >> 24]
        state[on] = s ^ crcs[begin[on] + k]
    out[long] = state ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(ids: np.ndarray, firsts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Records of the ids firsts[i]:firsts[i + 1], and the offset of each and of the end."""
    data, at = ids.view(np.uint8), firsts * ids.itemsize
    sizes = np.diff(at)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 16, out=offsets[1:])
    out = np.zeros(int(offsets[-1]), np.uint8)
    lengths = sizes.astype("<u8").view(np.uint8).reshape(-1, 8)
    head = masked(crc32c(lengths.ravel(), np.arange(len(sizes) + 1) * 8)).astype("<u4").view(np.uint8).reshape(-1, 4)
    tail = masked(crc32c(data, at)).astype("<u4").view(np.uint8).reshape(-1, 4)
    for k in range(8):
        out[offsets[:-1] + k] = lengths[:, k]
    for k in range(4):
        out[offsets[:-1] + 8 + k] = head[:, k]
        out[offsets[1:] - 4 + k] = tail[:, k]
    for to, start, size in zip((offsets[:-1] + 12).tolist(), at[:-1].tolist(), sizes.tolist(), strict=True):
        out[to : to + size] = data[start : start + size]
    return out.tobytes(), offsets


def unframe(raw: np.ndarray, offsets: np.ndarray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids and first id of each record; checks both checksums and the lengths."""
    sizes = np.diff(offsets) - 16
    take = lambda at, n: raw[(at[:, None] + np.arange(n)).ravel()].copy()
    head = take(offsets[:-1], 8)
    if not np.array_equal(head.view("<u8"), sizes.astype(np.uint64)):
        raise ValueError("a record's length is not what the index says")
    if not np.array_equal(take(offsets[:-1] + 8, 4).view("<u4"), masked(crc32c(head, np.arange(len(sizes) + 1) * 8))):
        raise ValueError("the checksum of a record's length does not hold")
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    data = np.concatenate([raw[a + 12 : b - 4] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    if not np.array_equal(take(offsets[1:] - 4, 4).view("<u4"), masked(crc32c(data, at))):
        raise ValueError("the checksum of a record does not hold")
    return data.view(dtype), at // dtype.itemsize


_TAIL = b".,!?;:%&$*#|)"
_IN_TAIL = np.zeros(256, bool)
_IN_TAIL[list(_TAIL)] = True
_ALNUM = np.array([chr(i).isascii() and chr(i).isalnum() for i in range(256)])


class Encoder:
    """Encodes texts word by word: white space always separates tokens, so a word's ids do not depend on its neighbours.

    Words are found and hashed for a whole chunk at once; only its distinct words are looked up, and a look-up that
    hashes alike is checked byte by byte. For a tokenizer that lower-cases and splits letters and digits from
    punctuation, a word's stem, in lower case, and the punctuation behind it are looked up apart, and stems of letters
    alone are encoded many at a time. What this Python worker has seen is forgotten when it has grown to `keep` words.
    """

    _kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        probe = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Stem", "stem", *map(chr, _TAIL))]
        parts = {t: self.tokenizer.encode(f"stem{t}", add_special_tokens=False).ids for t in map(chr, _TAIL)}
        self.by_stem = probe[0] == probe[1] and all(parts[t] == probe[1] + own for t, own in zip(map(chr, _TAIL), probe[2:], strict=True))
        self.by_stem = self.by_stem and bool(self.ends.any())
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # ascending; of each: its word among `spelled`, its ids among `pool`
        self.words, self.spelled = np.zeros((0, 2), np.int64), np.zeros(0, np.uint8)
        self.places, self.pool = np.zeros((0, 2), np.int64), np.zeros(0, self.dtype)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _parts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """The bytes to look up, and the parts (start, end, word) of each word: its stem and, where there is one, its tail."""
        if not self.by_stem or not len(starts):
            return raw, starts, ends, np.arange(len(starts))
        marks = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        special = np.zeros(len(starts), bool)  # words that may hold a special token stay as they are
        special[np.unique(np.searchsorted(starts, marks, "right") - 1)] = len(marks) > 0
        wide = np.concatenate([[0], np.cumsum(raw >= 128, dtype=np.int64)])
        kept = np.flatnonzero(special | (wide[ends] > wide[starts]))  # lower case may compose otherwise beyond ASCII
        lower = textcols.lower_ascii(raw)
        at, _ = textcols.ranges(starts[kept], ends[kept] - starts[kept])
        lower[at] = raw[at]
        # The last byte that is not of a tail, at or before each byte.
        solid = np.maximum.accumulate(np.where(_IN_TAIL[raw], -1, np.arange(len(raw))))
        cut = solid[ends - 1] + 1
        whole = (cut <= starts) | ~_ALNUM[raw[np.maximum(cut, 1) - 1]]
        whole |= special
        cut = np.where(whole, ends, cut)
        n = 1 + (cut < ends)
        first = np.cumsum(n) - n
        word = np.repeat(np.arange(len(starts)), n)
        a, b = starts[word], ends[word]
        b[first] = cut
        tail = first[n == 2] + 1
        a[tail] = cut[n == 2]
        return lower, a, b, word

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes."""
        texts = [w.decode() for w in words]
        out: list[bytes | None] = [None] * len(words)
        letters = [i for i, t in enumerate(texts) if t.isalpha()] if self.by_stem else []
        for k in range(0, len(letters), 32 * 256):
            part = letters[k : k + 32 * 256]
            rows = [part[i : i + 256] for i in range(0, len(part), 256)]
            joined = [" ".join([texts[i] for i in row]) for row in rows]
            for row, e in zip(rows, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                ends = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
                if len(ends) == len(row):  # each word has one end, so these are the words' bounds
                    data, ends = ids.tobytes(), ends.tolist()
                    for i, a, b in zip(row, [0, *ends], ends, strict=False):
                        out[i] = data[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(rest), 10_000):
            part = rest[k : k + 10_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Take up words whose hashes (ascending) are new."""
        ids = self._encoded(words)
        size = np.array([len(w) for w in words], np.int64)
        n = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        at = np.searchsorted(self.hashes, hashes)
        self.words = np.insert(self.words, at, np.column_stack([len(self.spelled) + np.cumsum(size) - size, size]), axis=0)
        self.places = np.insert(self.places, at, np.column_stack([len(self.pool) + np.cumsum(n) - n, n]), axis=0)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(words), np.uint8)])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), self.dtype)])

    def ids(self, raw: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with end_id behind, and the first id of each."""
        starts, ends, firsts = textcols.words(raw, offsets)
        raw, starts, ends, word = self._parts(raw, starts, ends)
        firsts = np.searchsorted(word, firsts)
        distinct, first, of = np.unique(textcols.PrefixHash(raw).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > self.keep:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            data = raw.tobytes()
            self._learn(distinct[new], [data[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        known = at[of]  # of each part its number among the known ones
        size = ends - starts
        alike = size == self.words[known, 1]
        place, owner = textcols.ranges(starts[alike], size[alike])
        same = raw[place] == self.spelled[place + np.repeat(self.words[known[alike], 0] - starts[alike], size[alike])]
        wrong = np.flatnonzero(~alike).tolist() + np.flatnonzero(alike)[np.unique(owner[~same])].tolist()
        begin, n, pool = self.places[known, 0], self.places[known, 1], self.pool
        if wrong:  # another word has the hash: these are encoded one by one
            data = raw.tobytes()
            own = self._encoded([data[starts[i] : ends[i]] for i in wrong])
            n[wrong] = [len(x) // self.dtype.itemsize for x in own]
            begin[wrong] = len(pool) + np.cumsum(n[wrong]) - n[wrong]
            pool = np.concatenate([pool, np.frombuffer(b"".join(own), self.dtype)])
        row = textcols.row_of(firsts)
        ending = int(end_id is not None)
        total = np.concatenate([[0], np.cumsum(n)])
        bounds = total[firsts] + ending * np.arange(len(firsts))
        out = np.full(int(bounds[-1]), end_id or 0, self.dtype)
        source, owner = textcols.ranges(begin, n)
        out[np.arange(len(source)) + ending * row[owner]] = pool[source]
        return out, bounds


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """Encode the whole text of each document and write shards in ascending doc_id order under the URI path.

    Returns the manifest, one row for each shard (shard, name, rows, tokens, bytes), which is also written to
    path/manifest. Each attempt of a task writes files of its own and only those of the attempt that succeeded get into
    the manifest, so a task may be repeated. A null text counts as empty; null doc_ids come first; repeated rows are
    written as often as they occur; an empty table gives no records.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        encoder, number = Encoder.of(tokenizer), TaskContext.get().partitionId()
        name, at, rows, tokens = f"part-{number:05d}-{uuid.uuid4().hex}", 0, 0, 0
        rec = idx = None
        for batch in batches:
            for part in textcols.chunks(batch, size=_CHUNK):
                if rec is None:
                    fs.create_dir(folder, recursive=True)
                    rec, idx = fs.open_output_stream(f"{folder}/{name}.rec"), fs.open_output_stream(f"{folder}/{name}.idx")
                ids, firsts = encoder.ids(*textcols.utf8(part["text"]), end_id)
                raw, offsets = frame(ids, firsts)
                entries = np.zeros(part.num_rows, INDEX)
                entries["doc_id"] = part["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
                entries["null"] = part["doc_id"].is_null().to_numpy(zero_copy_only=False)
                entries["offset"], entries["n"] = at + offsets[:-1], np.diff(firsts)
                rec.write(raw)
                idx.write(entries.tobytes())
                at, rows, tokens = at + len(raw), rows + part.num_rows, tokens + len(ids)
        if rec is not None:
            rec.close()
            idx.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "name": [name], "rows": [rows], "tokens": [tokens], "bytes": [at]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = ordered.mapInArrow(shard, _MANIFEST)
    manifest.write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str, id_bytes: int = 2, with_ids: bool = False, chunk: int = 8 << 20) -> DataFrame:
    """Read all records back by their index, checking every checksum.

    Returns doc_id, start (ids of all records before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)
    and, on request, ids. One task reads a shard, a few MB at a time.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    # One row for each shard, not for each document.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = save(manifest.select("name", "rows", before.alias("start")), "records-starts")
    dtype = np.dtype(f"<u{id_bytes}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, rows, start in zip(*(batch[c].to_pylist() for c in ("name", "rows", "start")), strict=True):
                with fs.open_input_file(f"{folder}/{name}.rec") as rec, fs.open_input_file(f"{folder}/{name}.idx") as idx:
                    done = 0
                    while done < rows:
                        entries = np.frombuffer(idx.read(INDEX.itemsize * 65536), INDEX)
                        sizes = entries["n"] * dtype.itemsize + 16
                        bounds = np.append(entries["offset"], entries["offset"][-1] + sizes[-1])
                        k = 0
                        while k < len(entries):
                            end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + chunk, "right")) - 1)
                            raw = np.frombuffer(rec.read_at(int(bounds[end] - bounds[k]), int(bounds[k])), np.uint8)
                            ids, firsts = unframe(raw, bounds[k : end + 1] - bounds[k], dtype)
                            wide = memoryview(ids.astype("<u4").tobytes())
                            cols = {
                                "doc_id": pa.array(entries["doc_id"][k:end], mask=entries["null"][k:end].astype(bool)),
                                "start": pa.array(start + firsts[:-1]),
                                "n_tokens": pa.array(np.diff(firsts)),
                                "ids_crc32": pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)], pa.int64()),
                            }
                            if with_ids:
                                cols["ids"] = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids.astype(np.int32)))
                            yield pa.RecordBatch.from_pydict(cols)
                            start, k = start + len(ids), end
                        done += len(entries)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    n = max(1, shards.count())
    return shards.repartition(n).mapInArrow(read, schema)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, with_ids: bool = False) -> DataFrame:
    """Write docs as records in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "records")
    write_records(docs, path, tokenizer, end_id)
    return read_records(docs.sparkSession, path, Encoder.of(tokenizer).dtype.itemsize, with_ids)
