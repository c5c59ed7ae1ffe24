"""Merkle manifest, byte-level BPE and repair of conversations against brute force: nulls, ties, repeated rows, long texts."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from spotloom.llm import bytebpe, conversations, merkle, queries  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _manifest(rows):
    """Rows of documents_manifest() by definition."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: _sha(*map(field, (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])))
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        trees[k].sort(key=lambda t: t[:3])
    low = {k: _levels([t[2] for t in trees[k]]) for k in names}
    high = _levels([low[k][-1][0] for k in names])
    out = collections.Counter()
    for j, k in enumerate(names):
        for i, (_, _, own, r) in enumerate(trees[k]):
            path = []
            for levels, at in ((low[k], i), (high, j)):
                for nodes in levels[:-1]:
                    path.append((at & 1, nodes[at ^ 1]) if at ^ 1 < len(nodes) else None)
                    at >>= 1
            d = leaf(r, 1) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else own
            for p in path:
                d = _sha(d) if p is None else _sha(p[1], d) if p[0] else _sha(d, p[1])
            out[r["doc_id"], own, low[k][-1][0], high[-1][0], _sha(*[p[1] for p in path if p]), d, d == high[-1][0]] += 1
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree int, node int, at int, n int, changed int, path int"


def _documents(n, seed=4):
    rng = random.Random(seed)
    rows = [(i * 3, rng.choice(["", "é\n", "x" * rng.randrange(50)]), rng.choice(["en", "en", "en", "de", "", None, "fr"]), rng.choice(["a", None]), rng.choice([None, i])) for i in range(n)]
    rows += [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (None, None, None, None, None), (6, "again", "en", "s", 2), (7 * 300_000, "alone", "zz", "s", 2)] + rows[:3] * 2
    return [(*r, 1, 1, 1, 1, 1, 1) for r in rows]


@pytest.mark.parametrize(("n", "step"), [(0, 6), (70, 6), (300, 1), (700, 3)])
def test_manifest(spark, n, step, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, step))
    docs = spark.createDataFrame(_documents(n) if n else _documents(0)[:1], DOCS)
    assert collections.Counter(tuple(r) for r in merkle.documents_manifest(docs.repartition(3)).collect()) == _manifest(docs.collect())


def test_manifest_of_nothing(spark):
    assert merkle.documents_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_proofs_fold_to_the_root():
    for n in range(1, 40):
        leaves = [_sha(str(i)) for i in range(n)]
        levels = merkle.raise_levels(leaves, True)
        assert [len(x) for x in levels] == [len(x) for x in _levels(leaves)] and levels[-1] == _levels(leaves)[-1]
        for i in range(n):
            path = merkle.siblings(levels, i)
            assert merkle.fold(leaves[i], path) == levels[-1][0] and merkle.fold(_sha("other"), path) != levels[-1][0]


def _texts():
    rng = random.Random(5)
    kinds = ["ab", "aaaa ", "  \n\t\x1c\x85​　", "éüßñ", "日本語한국", "0123456789²½", "!?.,;'sdtm", "🎉👍‍", "\x00﻿"]
    out = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([0, 3, 10, 40, 300]))) for _ in range(600)]
    return [*out, None, "", "a" * 5000, "".join(rng.choice("etaoin") for _ in range(20_000)), "it's <|endoftext|> we'll"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(RANKS), special_tokens={})


def test_ids_are_those_of_the_merges(reference):
    codec = bytebpe.Codec(RANKS, public_tokenizers.PATTERN, keep=50)
    small = bytebpe.Transducer(bytebpe.load_ranks(RANKS), most_states=40, most_pairs=30)
    for t in _texts():
        want = reference.encode_ordinary(t or "")
        assert [i for block in codec.ids(t or "") for i in block] == want
        assert [i for m in codec.pattern.finditer((t or "")[:400]) for i in small.encode(m[0].encode())] == reference.encode_ordinary((t or "")[:400])


def test_a_token_that_merges_do_not_reach():
    """`abc` can not be merged from its parts: only a piece that is exactly it becomes that token."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"de": 257, b"cde": 258}
    want = tiktoken.Encoding("own", pat_str=r"[a-z]+|\s", mergeable_ranks=ranks, special_tokens={})
    machine = bytebpe.Transducer(ranks)
    for piece in ("abc", "abcd", "cde", "abcde", "dede", "cdecde"):
        assert machine.encode(piece.encode()) == want.encode_ordinary(piece)


def test_decoding_in_parts():
    rng, ranks = random.Random(2), bytebpe.load_ranks(RANKS)
    spelled = {i: t for t, i in ranks.items()}
    decoder = bytebpe.Decoder(spelled)
    for _ in range(500):
        ids = [rng.randrange(len(spelled)) for _ in range(30)] + [ranks[bytes([rng.randrange(256)])] for _ in range(4)]
        rng.shuffle(ids)
        cut = rng.randrange(len(ids))
        parts = [decoder.feed(ids[:cut]), decoder.feed(ids[cut:]), decoder.close()]
        assert b"".join(parts).decode() == b"".join(spelled[i] for i in ids).decode("utf-8", "replace")
        parts[0].decode()  # what is given out ends with a character


def test_byte_bpe_tables(spark, reference):
    texts = _texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, n_tokens string")
    got = collections.Counter(tuple(r) for r in bytebpe.round_trip(docs.repartition(3), RANKS, public_tokenizers.PATTERN).collect())
    told = lambda i, t: (i if i % 9 else None, len(reference.encode_ordinary(t)), _sha(",".join(map(str, reference.encode_ordinary(t)))), _sha(t))
    assert got == collections.Counter(told(i, t or "") for i, t in enumerate(texts))
    encoded = bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bytebpe.decode(encoded.drop("text"), RANKS, public_tokenizers.PATTERN)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for t in texts) and set(back.columns) == set(docs.columns) - {"ids"}
    assert bytebpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


SOLID = re.compile("[^\x20\x09-\x0d]")
TURN = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def _repaired(rows):
    """Rows of damage_and_repair() by definition: of each state the least (cost, audit) to go, from the last row on."""
    talks = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        talks[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = collections.Counter()
    for c, turns in talks.items():
        turns.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], _sha(q[2])))
        numbers, seen, faults = [q[0] for q in turns if q[0] is not None], set(), []
        for _, role, text in turns:
            truncated = SOLID.search(text) and SOLID.findall(text)[-1] not in ".!?"
            faults.append("blank" if not SOLID.search(text) else "duplicate" if (role, text) in seen else "truncated" if truncated else "")
            seen.add((role, text))
        far = (1 << 40, "", ())
        due = {q: "a" if q == "u" else "u" for q in ("", "s", "u", "a")}

        def inserted(g):
            for _ in range(3):
                for q in g:
                    to = g[due[q]]
                    g[q] = min(g[q], (to[0] + 5, "I" + to[1], (NAMES[due[q]] + ":", *to[2])))
            return g

        g = inserted({"": (0, "", ()), "a": (0, "", ()), "s": far, "u": far})
        for (_, role, text), fault in zip(reversed(turns), reversed(faults)):
            h = {}
            for q in g:
                ways = [(g[q][0] + 2, "D" + g[q][1], g[q][2])]
                more = 5 if fault == "truncated" else 0
                if fault not in ("blank", "duplicate"):
                    to = g[due[q]]
                    ways.append((to[0] + 1 + more, "R" + to[1], (f"{NAMES[due[q]]}:{text}", *to[2])))
                    if (q, role[:1]) in TURN:
                        to = g[TURN[q, role[:1]]]
                        ways.append((to[0] + more, "K" + to[1], (f"{role}:{text}", *to[2])))
                h[q] = min(ways)
            g = inserted(h)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[(c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, g[""][0], g[""][1], _sha("\n".join(g[""][2])))] += 1
    return out


def _turns(conversations_, seed):
    rng, rows = random.Random(seed), []
    for c in range(conversations_):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "tool", None, "", "Sx", "usr", "sys"]])
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 60])):
            text = rng.choice(["hi.", "ok", "no!", "what?", " ", "", "yes. \n", "wait", "é."]) + rng.choice(["", "", f"{t}", f"{t}."])
            rows.append((c or None, rng.choice([t, t, t + 1, None]) if c % 3 == 0 else t, rng.choice(roles), text if rng.random() < 0.9 else None))
    return rows


TURNS = "conv_id long, turn long, role string, text string, key int, part int, at int, symbol int, audit int, state int"


@pytest.mark.parametrize("bits", [0, 1, 3, 10])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    rows = _turns(60 if bits < 10 else 150, bits)
    if bits == 10:
        rows += [(5000, i, ["user", "assistant"][i % 2] if i % 7 else "user", f"t{i}" + ("." if i % 11 else "")) for i in range(3000)] + [(6000, 5, "user", "same.")] * 2500
    got = conversations.damage_and_repair(spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1) for r in rows], TURNS).repartition(5))
    assert collections.Counter(tuple(r) for r in got.collect()) == _repaired(rows)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversations.damage_and_repair(none).collect() == []
    gone = next(t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (r,) = conversations.damage_and_repair(spark.createDataFrame([(1, gone, "user", "a.", *[1] * 6)], TURNS)).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", _sha(""))


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_conversation_repair"])
def test_sql(spark, name):
    """DuckDB's rows, on tables with nulls, ties and repeated rows too."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    docs = spark.createDataFrame([r[:5] for r in _documents(150)], "doc_id long, text string, lang string, source string, n_chars long")
    turns = spark.createDataFrame(_turns(80, 9), "conv_id long, turn long, role string, text string")
    frames = {"documents": docs, "conversations": turns}
    for k, d in frames.items():
        con.register(k, d.toArrow())
    call = {"op11_merkle_manifest": lambda: merkle.documents_manifest(docs), "op13_conversation_repair": lambda: conversations.damage_and_repair(turns)}
    got = call[name]()
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(cur.fetchall())
    assert got.select(F.count("*")).head()[0] > 50


def test_links_of_vectors_of_any_length(spark):
    """Pairs at the threshold, one of them very long or very short, are linked as their own directions are."""
    import math

    from spotloom.llm import vectors

    s = math.sqrt(1 - 0.95**2)
    rows = [(1, [1.0, 0.0]), (2, [0.96, 0.28]), (3, [0.95, s]), (4, [1e200, 0.0]), (5, [2e200, 1e190]), (6, [1e-200, 0.0]), (7, [0.95e-200, s * 1e-200]), (8, [1.7e308, 1e300]), (9, [-1.0, 0.0]), (10, [5e-324, 0.0])]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()}
    unit = {}
    for k, (x, y) in rows:
        top = max(abs(x), abs(y))
        n = math.hypot(x / top, y / top)
        unit[k] = (x / top / n, y / top / n)
    cos = lambda a, b: unit[a][0] * unit[b][0] + unit[a][1] * unit[b][1]
    for a in unit:
        sure = sum(cos(a, b) >= 0.95 + 1e-12 for b in unit if b != a)
        may = sum(cos(a, b) >= 0.95 - 1e-12 for b in unit if b != a)
        assert sure <= got[a]["n_links"] <= may, (a, got[a])
    assert got[9]["n_links"] == 0 and got[10]["n_links"] >= 5
