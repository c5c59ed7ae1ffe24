"""Byte-level BPE: a lazily determinised finite-state transducer that encodes, and a streaming decoder on a UTF-8 state machine.

A sequence of tokens is what the merges make of its bytes exactly where every two neighbours are what the merges make of
theirs, and each prefix of a text has one such sequence. So the machine that reads bytes, may end a token wherever the
vocabulary has one that fits its predecessor, and has at each place exactly one way to have ended a token there, encodes
without merging anything. Its determinised form is made as texts ask for it: a state is the set of ways that may still
go on, each the last token and how far the next one has got. Tokens are emitted as soon as all ways that are left share
them. A way lives no longer than the longest token, which bounds how far the output lags behind.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm.shared import save
from spotloom.llm.textcols import chunks

#: Matches that are held at once, of a text of any length.
PIECES = 8192
#: Bytes after which a long piece emits what is certain.
LAG = 512
_NEVER = 1 << 40

_ROOT = 0


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Bytes to token ids by ranks, as repeated merging of the neighbours of least rank (leftmost first) gives them.

    States are made when first reached; beyond `most_states` of them all are forgotten, which costs time and changes nothing.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 300_000, most_pairs: int = 600_000):
        self.ranks, self.most_states, self.most_pairs = ranks, most_states, most_pairs
        self.spelled = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.token, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = _ROOT
            for b in token:
                key = node << 8 | b
                at = self.child.get(key)
                if at is None:
                    at = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = at
            self.token[node] = rank
        self._own: dict[int, tuple[bool, list[tuple[int, bytes, bytes]]]] = {}
        self._pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.ways: list[tuple] = []
        self.ended: list[int] = []
        self.steps: dict[int, int] = {}
        self._state((-1, _ROOT), -1)

    def _state(self, ways: tuple[int, ...], ended: int) -> int:
        """The number of a set of ways: for each its last token and its place in the trie, one after the other."""
        at = self.ids.get(ways)
        if at is None:
            at = self.ids[ways] = len(self.ways)
            self.ways.append(ways)
            self.ended.append(ended)
        return at

    def merges(self, data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """What the merges make of data, and of each merge in turn its rank, the first and the last part after it."""
        parts, get, never, told = [data[i : i + 1] for i in range(len(data))], self.ranks.get, _NEVER, []
        ahead = [get(data[i : i + 2], never) for i in range(len(data) - 1)]
        while ahead and (least := min(ahead)) < never:
            at = ahead.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ahead[at]
            if at:
                ahead[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(ahead):
                ahead[at] = get(parts[at] + parts[at + 1], never)
            told.append((least, parts[0], parts[-1]))
        return parts, told

    def owned(self, token: int) -> bool:
        """Whether merges lead to this token at all; a vocabulary may hold some that only a whole piece can be."""
        return self._history(token)[0]

    def _history(self, token: int) -> tuple[bool, list[tuple[int, bytes, bytes]]]:
        found = self._own.get(token)
        if found is None:
            data = self.spelled[token]
            parts, told = self.merges(data)
            found = self._own[token] = (len(parts) == 1, [(-1, data[:1], data[-1:]), *told, (_NEVER, data, data)])
        return found

    def fits(self, last: int, token: int) -> bool:
        """Whether the merges of both, one behind the other, never join them: their own merges go on in the order of rank,
        and the last part of one with the first part of the other must never come before both."""
        if last < 0:
            return self.owned(token)
        key = last << 32 | token
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= self.most_pairs:
                self._pairs.clear()
            found = self._pairs[key] = self.owned(token) and self._apart(self._history(last)[1], self._history(token)[1])
        return found

    def _apart(self, left: list[tuple[int, bytes, bytes]], right: list[tuple[int, bytes, bytes]]) -> bool:
        i = j = 0
        while True:
            across = self.ranks.get(left[i][2] + right[j][1], _NEVER)
            a, b = left[i + 1][0], right[j + 1][0]
            if across < a and across <= b:
                return False
            if a <= b:
                if a == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _step(self, state: int, b: int) -> int:
        alive, ended = [], -1
        child, token = self.child, self.token
        ways = self.ways[state]
        for last, node in zip(ways[::2], ways[1::2], strict=True):
            at = child.get(node << 8 | b)
            if at is not None:
                alive += (last, at)
                if ended < 0 and token[at] >= 0 and self.fits(last, token[at]):
                    ended = token[at]
        if ended < 0:
            raise ValueError("the vocabulary lacks a single byte")
        alive += (ended, _ROOT)
        if len(self.ways) >= self.most_states:
            self._forget()
            return self._state(tuple(alive), ended)
        found = self.steps[state << 8 | b] = self._state(tuple(alive), ended)
        return found

    def _back(self, trail: list[int], end: int) -> list[int]:
        """Tokens of the first `end` bytes of a trail, which has for each byte the token that ends there."""
        out = []
        while end:
            out.append(trail[end - 1])
            end -= self.size[trail[end - 1]]
        return out[::-1]

    def _certain(self, state: int, trail: list[int]) -> int:
        """How many bytes of a trail all ways of a state have cut alike, up to a common end of a token."""
        begun = {len(trail) - self.depth[node] for node in self.ways[state][1::2]}
        while len(begun) > 1:
            late = max(begun)
            begun.remove(late)
            begun.add(late - self.size[trail[late - 1]])
        return begun.pop()

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and not self.owned(whole):
            return [whole]
        state, out, trail = 0, [], []
        for start in range(0, len(piece), LAG):
            for b in piece[start : start + LAG]:
                found = self.steps.get(state << 8 | b)
                state = found if found is not None else self._step(state, b)
                trail.append(self.ended[state])
            if start + LAG < len(piece):
                done = self._certain(state, trail)
                out += self._back(trail, done)
                del trail[:done]
        return out + self._back(trail, len(trail))


def _following() -> list[list[int]]:
    """State after each byte of UTF-8: 0 between characters, 1 to 3 that many bytes to come, 4 to 7 where the second byte
    is bound more closely (behind E0, ED, F0, F4); -1 where no character goes on so."""
    rules = {0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEF, 2), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]}
    rules |= {1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)]}
    rules |= {4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)]}
    table = [[-1] * 256 for _ in range(8)]
    for state, spans in rules.items():
        for low, high, to in spans:
            table[state][low : high + 1] = [to] * (high + 1 - low)
    return table


_FOLLOWING = _following()
_REPLACEMENT = "�".encode()


class Decoder:
    """Ids to text, part by part: what feed() returns are whole characters, and a character that a token cuts waits for its
    rest. Each longest piece that can not become a character is given as U+FFFD."""

    def __init__(self, spelled: dict[int, bytes]):
        self.spelled, self.state, self.waiting = spelled, 0, b""
        self._whole: dict[int, bool] = {}

    def _bytes(self, data: bytes, out: list[bytes]) -> None:
        begin, data, at = 0, self.waiting + data, len(self.waiting)
        state = self.state
        while at < len(data):
            to = _FOLLOWING[state][data[at]]
            if to < 0:
                out.append(_REPLACEMENT)
                at += state == 0  # a byte that can not begin one is a piece by itself; else it may begin the next
                state, begin = 0, at
                continue
            at += 1
            if to == 0:
                out.append(data[begin:at])
                begin = at
            state = to
        self.state, self.waiting = state, data[begin:]

    def feed(self, ids: Iterable[int]) -> bytes:
        out: list[bytes] = []
        spelled, whole = self.spelled, self._whole
        for i in ids:
            known = whole.get(i)
            if known is None:
                state = 0
                for b in spelled[i]:
                    state = _FOLLOWING[state][b]
                    if state < 0:
                        break
                known = whole[i] = state == 0
            if known and self.state == 0:
                out.append(spelled[i])
            else:
                self._bytes(spelled[i], out)
        return b"".join(out)

    def close(self) -> bytes:
        """What is left of a character that never ended; the decoder can begin anew."""
        left, self.state, self.waiting = self.waiting, 0, b""
        return _REPLACEMENT if left else b""


class Codec:
    """Pieces of text to ids and back. Ids of short pieces are remembered, as many as `keep`."""

    def __init__(self, path: str, pattern: str, keep: int = 200_000):
        self.transducer, self.pattern, self.keep = Transducer(load_ranks(path)), regex.compile(pattern), keep
        self.known: dict[str, list[int]] = {}

    @staticmethod
    @functools.lru_cache(2)
    def of(path: str, pattern: str) -> Codec:
        return Codec(path, pattern)

    def ids(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, of some thousand pieces at a time."""
        matches, known, encode = self.pattern.finditer(text), self.known, self.transducer.encode
        while block := [m[0] for m in islice(matches, PIECES)]:
            out: list[int] = []
            for piece in block:
                found = known.get(piece)
                if found is None:
                    found = encode(piece.encode())
                    if len(piece) <= 64:
                        if len(known) >= self.keep:
                            known.clear()
                        known[piece] = found
                out += found
            yield out

    def decoder(self) -> Decoder:
        return Decoder(self.transducer.spelled)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>): each match of `pattern` by itself, by the ranks in the file at path.

    A null text counts as empty and has no ids; a column named as `to` is replaced; rows are neither lost nor added.
    The file must be readable on every machine.
    """
    rest = [c for c in docs.columns if c != to]
    schema = docs.select(*rest).withColumn(to, F.array().cast("array<int>")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for part in chunks(batch, text):
                ids = [[i for block in codec.ids(t or "") for i in block] for t in part[text].to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in rest], pa.array(ids, pa.list_(pa.int32()))], [*rest, to])

    return docs.select(*rest).mapInArrow(kernel, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """rows with the text of a column of token ids; null ids give an empty text, bytes that are no text U+FFFD; an id that
    the vocabulary lacks is an error. A column named as `to` is replaced."""
    rest = [c for c in rows.columns if c not in (to, ids)]
    schema = rows.select(*rest).withColumn(to, F.lit("")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            texts = []
            for each in batch[ids].to_pylist():
                d = codec.decoder()
                texts.append((d.feed(each or []) + d.close()).decode())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(texts, pa.string())], [*rest, to])

    return rows.select(*rest, ids).mapInArrow(kernel, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes of the decoded ids) of each row.

    A text is encoded, hashed and decoded some thousand pieces at a time, so that a very long one takes no more memory
    than its own. A null text counts as empty; null and repeated doc_ids stay; an empty table gives no rows. Nothing is shuffled.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        names = {i: str(i) for i in codec.transducer.spelled}
        decoder = codec.decoder()
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for value in part["text"]:
                    n, told, back = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in codec.ids(value.as_py() or ""):
                        told.update((("," if n else "") + ",".join(map(names.__getitem__, ids))).encode())
                        back.update(decoder.feed(ids))
                        n += len(ids)
                    back.update(decoder.close())
                    rows.append((n, told.hexdigest(), back.hexdigest()))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, schema), "byte-bpe")
