"""Repair of conversations: the cheapest edits that make the roles take turns, and of those the least by their letters.

A conversation's rows may be kept (K), given the role that is due (R) or deleted (D), and empty turns inserted (I), so that
initials of roles read (s?(ua)+)?. States of that grammar: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.llm.shared import save

#: Rows of a conversation that are judged at once; a longer one is cut and its parts are joined by their costs.
CHUNK_BITS = 10
#: Nodes (four for each row) that a kernel takes at once.
NODES = 400_000

_FAR = 1 << 40
_INSERT, _DELETE, _REROLE, _TRUNCATED = 5, 2, 1, 5
#: State behind the initial s, u, a or another, from each state; -1 where the grammar does not allow it.
_NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The initial that is due in each state, and the state behind it.
_DUE = np.array([1, 1, 2, 1])
_AFTER = _NEXT[np.arange(4), _DUE]
_END = np.array([0, 2 * _INSERT, _INSERT, 0])
_LETTERS = "DIKR"  # in the order of ASCII
_ROLES = {1: "user", 2: "assistant"}


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of D, I, K and R for each symbol (three times the initial, plus 1 where truncated, 2 where
    the row must go), state and letter; insertions stay before the row."""
    cost, to = np.full((12, 4, 4), _FAR), np.zeros((12, 4, 4), np.int64)
    for symbol in range(12):
        initial, fault = divmod(symbol, 3)
        for q in range(4):
            cost[symbol, q, 0], to[symbol, q, 0] = _DELETE, q
            cost[symbol, q, 1], to[symbol, q, 1] = _INSERT, _AFTER[q]
            if fault < 2:
                if _NEXT[q, initial] >= 0:
                    cost[symbol, q, 2], to[symbol, q, 2] = _TRUNCATED * fault, _NEXT[q, initial]
                cost[symbol, q, 3], to[symbol, q, 3] = _REROLE + _TRUNCATED * fault, _AFTER[q]
    return cost, to


_COST, _TO = _arcs()


def _before_insertions(h: np.ndarray) -> np.ndarray:
    """Costs (..., 4) with the choice to insert up to two turns first."""
    g = h.copy()
    g[..., 2] = np.minimum(h[..., 2], _INSERT + h[..., 3])
    g[..., 3] = np.minimum(h[..., 3], _INSERT + h[..., 2])
    for q in (0, 1):
        g[..., q] = np.minimum(h[..., q], _INSERT + g[..., 2])
    return g


def _columns(symbols: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to go before each row and behind the last: (rows + 1, parts, 4, ...) of symbols (parts, rows), which fill each
    part from the left, from the costs `end` (parts, 4, ...) behind its last row."""
    parts, rows = symbols.shape
    g = np.empty((rows + 1, *end.shape), np.int64)
    g[rows] = end
    for i in range(rows - 1, -1, -1):
        live = i < sizes
        g[i] = end
        if live.any():
            s, after = symbols[live, i], g[i + 1][live]
            cost, to = _COST[s], _TO[s]
            wide = (slice(None), slice(None)) + (None,) * (after.ndim - 2)
            at = np.arange(len(s))[:, None]
            h = np.minimum.reduce([cost[:, :, k][wide] + after[at, to[:, :, k]] for k in (0, 2, 3)])
            moved = np.moveaxis(h, 1, -1)
            g[i][live] = np.moveaxis(_before_insertions(np.minimum(moved, _FAR)), -1, 1)
    return g


def transfer(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Least cost from each state before a part's rows to each state behind them: (parts, 4, 4)."""
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
    return np.minimum(_columns(symbols, sizes, np.repeat(unit[None], len(symbols), 0))[0], _FAR)


def least_paths(symbols: np.ndarray, sizes: np.ndarray, end: np.ndarray, final: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Of each part and each state before it the least audit among the cheapest, and the state behind it, where `end` are
    the costs behind the part and `final` tells that nothing follows, so that turns may be inserted behind the last row.

    Arcs that keep the cost least are ranked by the first letter, then by the first 2, 4, 8, ... letters of the audit that
    begins with them: a rank of twice the length comes from an arc's own and that of the best arc at the node to which its
    letters lead. From a node no two arcs have one letter, so a string of letters leads to one node. The least audit is read off the doubled pointers.
    """
    parts, rows = symbols.shape
    g = _columns(symbols, sizes, end)
    column, part, state = np.meshgrid(np.arange(rows + 1), np.arange(parts), np.arange(4), indexing="ij")
    node = lambda c, p, q: (c * parts + p) * 4 + q
    inside, last = column < sizes[part], column == sizes[part]
    s = np.where(inside, symbols[part, np.minimum(column, rows - 1)] if rows else 0, 0)
    known = np.minimum(g, _FAR)
    source, letter, target = [], [], []
    for k in range(4):
        to = _TO[s, state, k]
        into = column if k == 1 else np.minimum(column + 1, rows)
        least = (inside | (last & final[part] & (k == 1))) & (known < _FAR)
        least &= known == _COST[s, state, k] + known[into, part, to]
        source.append(node(column, part, state)[least])
        letter.append(np.full(int(least.sum()), k))
        target.append(node(into, part, to)[least])
    source, letter, target = (np.concatenate(x) for x in (source, letter, target))
    order = np.lexsort((letter, source))
    source, letter, target = source[order], letter[order], target[order]
    n, m = (rows + 1) * parts * 4, len(source)

    def best(rank: np.ndarray) -> np.ndarray:
        """Of each node the arc of least rank; m where it has none."""
        by = np.lexsort((rank, source))
        head = np.ones(m, bool)
        head[1:] = source[by][1:] != source[by][:-1]
        out = np.full(n, m)
        out[source[by][head]] = by[head]
        return out

    rank, ends, jumps = letter + 1, target, []
    while True:
        first = best(rank)
        jumps.append(np.append(ends, n)[first])  # of each node the one to which its best letters so far lead
        going = first[ends] < m
        if not going.any():
            break
        then = np.append(rank, 0)[first[ends]]
        rank = np.unique(rank * (m + 6) + then, return_inverse=True)[1] + 1
        ends = np.where(going, jumps[-1][ends], ends)
    chosen = np.append(letter, -1)[best(rank)]
    start = node(0, np.arange(parts)[:, None], np.arange(4)[None, :]).ravel()
    walk = start[:, None]
    for jump in reversed(jumps):
        onward = np.append(jump, n)[walk]
        walk = np.stack([walk, onward], axis=2).reshape(len(start), -1)
    taken = np.append(chosen, -1)[walk]
    audits = ["".join(_LETTERS[k] for k in each[each >= 0]) for each in taken]
    steps = (taken >= 0).sum(axis=1)
    at, left = start.copy(), steps.copy()
    for k in range(len(jumps) - 1, -1, -1):
        go = left >= 1 << k
        at[go] = jumps[k][at[go]]
        left[go] -= 1 << k
    return [audits[4 * i : 4 * i + 4] for i in range(parts)], (at % 4).reshape(parts, 4)


def _by_size(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Parts of alike length (within a factor of 2), as numbers, a matrix of symbols and lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    kind = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        each = max(1, NODES // (4 * ((1 << int(k)) + 1)))
        for i in range(0, len(at), each):
            some = at[i : i + each]
            matrix = np.zeros((len(some), int(sizes[some].max())), np.int64)
            for row, j in enumerate(some):
                matrix[row, : sizes[j]] = np.frombuffer(texts[j].encode(), np.uint8) - 97
            yield some.tolist(), matrix, sizes[some]


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with nulls of role and text as one space, damaged by the crc32 of `conv_id:turn`
    (nulls as one space) modulo 20: 0 drops a row, 1 empties its text, 2 removes `[.!?]`, 3 repeats it, 4 sets its role to user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    twice = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.withColumn("copy", F.explode(twice)).drop("kind", "copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, hash and at, which ascends through each conversation: by turn (nulls first), rows of
    one turn by role and sha256 of the text. Dealt by ranges of all these, so that a long conversation is in many tasks."""
    known = rows.withColumns({"key": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "hash": F.sha2("text", 256), "__salt": F.monotonically_increasing_id()})
    order = ["key", F.col("turn").asc_nulls_first(), "role", "hash", "__salt"]
    return save(known.repartitionByRange(*order).sortWithinPartitions(*order).drop("__salt").withColumn("at", F.monotonically_increasing_id()), "turns")


def _facts(turns: DataFrame) -> DataFrame:
    """key, turn, at, fault (blank, duplicate, truncated or null) and symbol of each row."""
    first = turns.groupBy("key", "role", "hash").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ending = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = turns.select("key", "turn", "at", blank.alias("blank"), (~ending.isin(".", "!", "?")).alias("cut"), code.alias("code"))
    each = narrow.join(first, "at", "left")  # at is a row's own: no value of it is common
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    each = each.select("key", "turn", "at", "code", fault.alias("fault"))
    weight = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    return each.withColumn("symbol", F.char(97 + 3 * F.col("code") + weight))


def _parts(facts: DataFrame) -> DataFrame:
    """key, part, at (of the first row), symbols of at most 2 ** CHUNK_BITS rows, and the costs through each part."""
    rows = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    grouped = facts.groupBy("key", F.shiftright("at", CHUNK_BITS).alias("part")).agg(F.min("at").alias("at"), rows.alias("rows"))
    parts = grouped.select("key", "part", "at", F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = np.zeros((batch.num_rows, 16), np.int64)
            for some, symbols, sizes in _by_size(batch["symbols"].to_pylist()):
                costs[some] = transfer(symbols, sizes).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "costs"])

    return parts.mapInArrow(kernel, "key string, part long, at long, symbols string, costs array<long>")


def _with_ends(parts: DataFrame) -> DataFrame:
    """parts with the costs behind each (`behind`), whether it is a conversation's last and the cost from its own start.

    A conversation's parts, one for a thousand rows, are read from the last to the first, one at a time."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, behind = None, _END
        for batch in batches:
            told = []
            for name, costs in zip(batch["key"].to_pylist(), batch["costs"].to_pylist(), strict=True):
                final = name != key
                if final:
                    key, behind = name, _END
                own = np.minimum((np.array(costs).reshape(4, 4) + behind).min(axis=1), _FAR)
                told.append((behind.tolist(), final, int(own[0])))
                behind = own
            cols = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.list_(pa.int64()), pa.bool_(), pa.int64()), strict=True)] if told else []
            if told:
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("key", "part", "at", "symbols")], *cols], ["key", "part", "at", "symbols", "behind", "final", "cost"])

    dealt = parts.repartition("key").sortWithinPartitions("key", F.desc("part"))
    return dealt.mapInArrow(kernel, "key string, part long, at long, symbols string, behind array<long>, final boolean, cost long")


def _with_paths(parts: DataFrame) -> DataFrame:
    """parts with the least audit and the state behind the part for each state before it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, ends = [[]] * batch.num_rows, np.zeros((batch.num_rows, 4), np.int64)
            behind, final = np.array(batch["behind"].to_pylist(), np.int64), batch["final"].to_numpy(zero_copy_only=False)
            for some, symbols, sizes in _by_size(batch["symbols"].to_pylist()):
                found, ends[some] = least_paths(symbols, sizes, behind[some], final[some].astype(bool))
                for i, each in zip(some, found, strict=True):
                    audits[i] = each
            cols = [*[batch[c] for c in ("key", "part", "at", "symbols", "cost")], pa.array(audits, pa.list_(pa.string())), pa.array(ends.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "part", "at", "symbols", "cost", "audits", "ends"])

    return parts.repartition("key", "part").mapInArrow(kernel, "key string, part long, at long, symbols string, cost long, audits array<string>, ends array<long>")


def _audited(parts: DataFrame) -> DataFrame:
    """key, at, audit of each part, its state before (`state`), the pairs of neighbours that may not follow each other and,
    on a conversation's first part, its cost."""
    legal = {(0, 1), (1, 2), (2, 1)}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last = None, 0, -1
        for batch in batches:
            told = []
            for name, symbols, cost, audits, ends in zip(*(batch[c].to_pylist() for c in ("key", "symbols", "cost", "audits", "ends")), strict=True):
                new = name != key
                if new:
                    key, state, last = name, 0, -1
                initials = [(ord(c) - 97) // 3 for c in symbols]
                pairs = zip([last, *initials[:-1]], initials, strict=True)
                told.append((audits[state], state, sum(p not in legal for p in pairs if p[0] >= 0), cost if new else 0))
                state, last = ends[state], initials[-1]
            if told:
                cols = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["key"], batch["at"], *cols], ["key", "at", "audit", "state", "illegal", "cost"])

    dealt = parts.repartition("key").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(kernel, "key string, at long, audit string, state long, illegal long, cost long")


class _Writer:
    """The digest of a conversation's repaired rows, one after the other."""

    def __init__(self):
        self.sum, self.any = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.sum.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True


def repaired_rows(role: str | None, text: str, letters: list[str], state: int, put) -> int:
    """Write what `letters` (those of one row, last first, or only insertions) make of a row; the state behind it."""
    while letters and letters[-1] == "I":
        letters.pop()
        put(_ROLES[int(_DUE[state])], "")
        state = int(_AFTER[state])
    if role is not None:
        letter = letters.pop()
        if letter == "K":
            put(role, text)
            state = int(_NEXT[state, "sua".index(role[0])])
        elif letter == "R":
            put(_ROLES[int(_DUE[state])], text)
            state = int(_AFTER[state])
    return state


def _repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """key, repaired_sha256. A conversation's digest needs its rows one after the other: one task reads them in order,
    a batch at a time, each part's audit right before its rows."""
    none = F.lit(None).cast("string")
    edits = audits.select("key", "at", F.lit(0).alias("kind"), none.alias("role"), none.alias("text"), "audit", "state")
    each = turns.select("key", "at", F.lit(1).alias("kind"), "role", "text", none.alias("audit"), F.lit(None).cast("long").alias("state"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, writer, letters, state = None, None, [], 0

        def done() -> pa.RecordBatch:
            repaired_rows(None, "", letters, state, writer.put)
            return pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [writer.sum.hexdigest()]})

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch["key"][i].as_py()
                if name != key:
                    if writer is not None:
                        yield done()
                    key, writer, letters = name, _Writer(), []
                if batch["kind"][i].as_py() == 0:
                    letters, state = list(reversed(batch["audit"][i].as_py())), batch["state"][i].as_py()
                else:
                    state = repaired_rows(batch["role"][i].as_py(), batch["text"][i].as_py(), letters, state, writer.put)
        if writer is not None:
            yield done()

    dealt = edits.unionByName(each).repartition("key").sortWithinPartitions("key", "at", "kind")
    return dealt.mapInArrow(kernel, "key string, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of
    rows(conv_id, turn, role, text), and of those of conversations(conv_id) that have no row.

    Rows stand by turn (nulls first), those of one turn by role and sha256 of the text; role and text may not be null. A row's
    first fault counts: blank, duplicate (role and text seen earlier), truncated. Keep costs 0, Rerole 1, Delete 2 (required
    for blank and duplicate rows), Insert 5, a truncated row that is not deleted 5 more; audit is the least string of
    initials among the cheapest ways. A conversation without rows has zeros, an empty audit and the digest of nothing;
    a null conv_id is a conversation of its own; an empty table gives no rows.

    Costs of a conversation's parts, of at most a thousand rows each, are joined from the last to the first, then every
    part ranks its paths by itself, as the letters of a path decide where it leads, and the parts are joined from the first on.
    """
    empty = hashlib.sha256(b"").hexdigest()
    turns = _in_order(rows)
    facts = save(_facts(turns), "turn-facts")
    audits = save(_audited(_with_paths(save(_with_ends(_parts(facts)), "turn-parts"))), "turn-audits")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    span = F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0))
    told = facts.groupBy("key").agg(span.alias("span"), *map(count, ("blank", "duplicate", "truncated")))
    turn = facts.where("turn is not null").select("key", "turn").distinct().groupBy("key").agg(F.count("*").alias("turns"))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda r: r["audit"])
    edits = audits.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(letters, "").alias("audit"))
    named = (conversations if conversations is not None else rows).select("conv_id").distinct()
    named = named.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = named.join(told, "key", "left").join(turn, "key", "left").join(edits, "key", "left").join(_repaired(turns, audits), "key", "left")
    zero: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    gaps = (F.coalesce("span", F.lit(0)) - F.coalesce("turns", F.lit(0))).cast("long").alias("gaps")
    return out.select("conv_id", gaps, *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """repair() of damage()d conversations, one row for each conv_id of the input."""
    return repair(damage(rows), rows)
