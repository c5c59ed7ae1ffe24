"""Operators on small tables against brute force, with nulls, empty texts, repeated rows, ties and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from spotloom.llm import decontam, links, lmscore, mixture, neardup, records, repeats, suffixes, templates, textcols, toxicity, vectors  # noqa: E402

SCHEMA = "doc_id long, text string, source string, size long, v long, n long, score double, rep long, item_id long"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions under a pale moon and nobody dares to ask why"
ROWS = [
    (1, BASE, "a"),
    (2, BASE.upper(), "b"),
    (3, None, "b"),
    (4, "", None),
    (5, " \t\n", "a"),
    (6, "one", "c"),
    (7, "one two", "c"),
    (8, BASE.replace("pale", "red"), "a"),
    (9, "naïve " + BASE + " café " + BASE, "b"),
    (9, "naïve " + BASE + " café " + BASE, "b"),
    (10, "x" * 450, "c"),
    (11, "é" * 300 + "tail", "c"),
    (12, " ".join(f"w{i % 7}" for i in range(400)), "a"),
    (13, BASE, None),
    (None, BASE, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, s, 7, 7, 7, 0.5, 7, 7) for d, t, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_prefix_hash_and_minima():
    raw = np.frombuffer(b"abcabcabcxabcabc" * 20, np.uint8)
    p = textcols.PrefixHash(raw)
    assert p.of(np.array([0]), np.array([3]))[0] == p.of(np.array([3]), np.array([6]))[0]
    h = p.windows(4)
    for w in (1, 3, 7):
        got = textcols.sliding_argmin(h, w)
        top = h >> np.uint64(31)
        assert got.tolist() == [i + int(np.argmin(top[i : i + w])) for i in range(len(h) - w + 1)]


@pytest.mark.parametrize("length", [3, 8])
def test_suffix_sort(length):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    s = np.arange(len(raw) - length)
    bucket = s % 3
    by = np.argsort(bucket, kind="stable")
    order = suffixes.merge_sort(suffixes.HashedText(raw), s[by], bucket[by], length)
    keys = [(int(bucket[by][i]), raw[s[by][i] : s[by][i] + length].tobytes()) for i in order]
    assert keys == sorted(keys)
    c = collections.Counter((int(b), raw[i : i + length].tobytes()) for i, b in zip(s, bucket))
    assert suffixes.repeated(raw, s, bucket, length).tolist() == [c[int(b), raw[i : i + length].tobytes()] > 1 for i, b in zip(s, bucket)]


def test_crc32c_and_frames():
    assert int(records.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0, 9]))[0]) == 0xE3069283
    ids, firsts = np.arange(500, dtype="<u2"), np.array([0, 0, 1, 40, 500])
    raw, offsets = records.frame(ids, firsts)
    back, at = records.unframe(np.frombuffer(raw, np.uint8), offsets, np.dtype("<u2"))
    assert back.tolist() == ids.tolist() and at.tolist() == firsts.tolist()
    broken = bytearray(raw)
    broken[30] ^= 1
    with pytest.raises(ValueError):
        records.unframe(np.frombuffer(bytes(broken), np.uint8), offsets, np.dtype("<u2"))


def test_token_records(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["It's <|endoftext|> İ K <|ENDOFTEXT|>, ẗ T̈.", "a>, b|c!! x#$ \x1c y z", "WORD word, Word. (word)"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = records.encode_and_read(both, path, with_ids=True).toPandas().sort_values("start")
    tok = Tokenizer.from_file(path)
    rows = sorted([(d, t) for d, t, _ in ROWS] + [(100 + i, t) for i, t in enumerate(odd)], key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (d, t), r in zip(rows, got.itertuples(), strict=True):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert list(r.ids) == ids.tolist() and r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
        assert (d is None and r.doc_id != r.doc_id) or d == r.doc_id
        start += len(ids)
    assert records.encode_and_read(empty, path).count() == 0


def test_water_filling(spark):
    rows = [("a", 100), ("b", 1), ("c", 50), (None, 10)]
    t = {r["source"]: r["target"] for r in mixture.water_fill(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    # Weights 1, 2, 3, 1: b stops at 3, and c at 150 is not reached.
    assert t["b"] == 3 and t[None] == 30 and abs(sum(t.values()) - 161) < 1e-9
    assert abs(t["c"] / 3 - t["a"]) < 1e-9


def test_mix(docs, empty):
    got = mixture.mix(docs).collect()
    assert len(got) == len(ROWS)
    taken, target, biggest = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in taken)
    assert sorted(map(str, got)) == sorted(map(str, mixture.mix(docs).collect()))
    assert mixture.mix(empty).count() == 0
    assert mixture.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("hot", [1, 1024])
def test_repeated_bytes(docs, empty, hot):
    length = 40
    texts = [(t or "").encode() for _, t, _ in ROWS]
    c = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    want = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[1:] for r in repeats.remove_repeated_bytes(docs, length, 12, hot).collect()]
    assert sorted(got) == sorted(want)
    assert repeats.remove_repeated_bytes(empty, length, 12).count() == 0


def test_repeated_words(docs, empty):
    length = 5
    rows = [(1 << 62 if d is None else d, words(t)) for d, t, _ in ROWS]
    least = {}
    for d, w in rows:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, d), d)
    want = []
    for d, w in rows:
        gone = [0] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [1] * length
        want.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = [tuple(r)[1:] for r in repeats.remove_repeated_words(docs, length).collect()]
    assert sorted(got) == sorted(want)
    assert repeats.remove_repeated_words(empty, length).count() == 0


def test_repeated_words_at_all_places_of_a_document(spark):
    a, b, p = (" ".join(f"{x}{i}" for i in range(15)) for x in "abp")
    rows = [(1, f"{p} then something else"), (2, f"{a} {p} {b} {a} {p} {b}"), (2, f"{a} {p} {b} tail")]
    got = repeats.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert {(r["doc_id"], r["n_removed"], r["kept"]) for r in got} == {(1, 0, rows[0][1]), (2, 30, f"{a} {b} {a} {b}"), (2, 15, f"{a} {b} tail")}


def _shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.mark.parametrize("tile", [2, 128])
def test_near_duplicates(spark, docs, empty, tile):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(500)]
    rows = [(d, t) for d, t, _ in ROWS]
    for g in range(6):
        base = [vocabulary[i] for i in rng.integers(0, 500, 60)]
        for k in range(12):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, 60))] = f"e{rng.integers(0, 9999)}"
            rows.append((1000 + 100 * g + k, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("members", F.lit(1))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(table, group_tile=tile, bucket_tile=4).collect() if r["doc_id"] is not None}
    ids, sets = sorted({d for d, _ in rows if d is not None}), {d: _shingles(t) for d, t in rows}
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for d in ids:
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (len(sets[d]), find(d), find(d) == d), d
    assert neardup.near_duplicates(empty).count() == 0


def test_shingles_alike_in_any_chunk(spark):
    fill = [f"other text number {i} of chunk with its own words w{i} x{i}" for i in range(2000)]
    want = None
    for rows in (1, 3, 100, 2000):
        column = pa.array([*fill[: rows - 1], BASE + " " + BASE])
        h, firsts = neardup.shingle_hashes(*textcols.utf8(column), 3)
        assert np.diff(firsts).tolist() == [len(_shingles(t)) for t in column.to_pylist()]
        last = h[firsts[-2] : firsts[-1]].tolist()
        want = want or last
        assert last == want
    parts = [spark.createDataFrame([(n, BASE), *((10 * n + i, fill[10 * n + i]) for i in range(n - 1))], "doc_id long, text string").coalesce(1) for n in (1, 3, 100)]
    found = neardup.near_duplicates(parts[0].unionByName(parts[1]).unionByName(parts[2])).where("doc_id in (1, 3, 100)")
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 3: 1, 100: 1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("tile", [5, 4096])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 8))
    x = np.concatenate([base, base + 0.15 * rng.standard_normal((12, 8)), base[:3] * 2, base[:2]]).astype(np.float32)
    rows = [(i, v.tolist(), 1, 1) for i, v in enumerate(x)]
    rows += [(90, None, 1, 1), (91, [0.0] * 8, 1, 1), (92, [float("nan")] + [1.0] * 7, 1, 1), (93, [None] + [1.0] * 7, 1, 1), (94, [], 1, 1), (None, x[0].tolist(), 1, 1), (95, [float("inf")] + [1.0] * 7, 1, 1)]
    rows += [(100, [1.0], 1, 1), (101, [2.0], 1, 1), (102, [-1.0], 1, 1), (103, [1.0, 0.1], 1, 1), (104, [1.0, 0.4], 1, 1), (105, [1.0, 0.7], 1, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int").withColumn("dim", F.lit(1)).withColumn("cell", F.lit(1))
    got = {r["vec_id"]: r for r in vectors.near_vectors(table, 0.95, lead=3, per_tile=tile).collect()}
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    on = u @ u.T >= 0.95
    np.fill_diagonal(on, False)
    label = links.forest(on)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (int(on[i].sum()), int(label[i]), label[i] == i), i
    for i in range(90, 96):
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(100, 106)] == [(1, 100), (1, 100), (0, 102), (1, 103), (2, 103), (1, 103)]
    assert got[None]["component_id"] is None and len(got) == len(rows)
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_decontamination(spark, docs, empty):
    item = " ".join(f"b{i}" for i in range(60))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "alpha beta"), (4, BASE)], "item_id long, text string")
    near = item.split()
    near[10] = "changed"
    far = item.split()
    far[5] = far[20] = far[40] = "changed"
    rows = [(1, "start " + item + " end"), (2, "some " + " ".join(near)), (3, " ".join(far)), (4, None), (5, "the ALPHA, beta!"), (6, "beta alpha"), (7, item.upper()), (8, BASE), (9, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit(1)).withColumn("item_id", F.lit(1))
    got = {r["doc_id"]: list(r["items"]) for r in decontam.report(table, bench).collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [], 5: [3], 6: [], 7: [1], 8: [4], 9: []}
    assert {r["doc_id"] for r in decontam.clean(table, bench).collect()} == {3, 4, 6, 9}
    assert decontam.report(empty, bench).count() == 0 and decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_a_truncated_item(spark):
    item = [f"b{i}" for i in range(16)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(1, " ".join(item[:14])), (2, " ".join(item[2:])), (3, " ".join(item[:13])), (4, "and " + " ".join(item[:13]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (list(r["items"]), r["similarity"]) for r in decontam.report(table, bench).collect()}
    assert got == {1: ([1], 10 / 12), 2: ([1], 10 / 12), 3: ([], None), 4: ([], None)}
    assert {r["doc_id"] for r in decontam.clean(table, bench).collect()} == {3, 4}


def test_line_templates(spark, empty):
    rows = [(i, f"unique text number{i} of words{i}\nPage {i} of 200\nuser u{i} logged in from host h{i} at noon\n\nsame footer here") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "same footer here"), (53, "some other line entirely\nsame footer there")]
    got = {r["doc_id"]: r for r in templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1))).collect()}
    assert got[3]["kept"] == "" or "unique" not in got[3]["kept"] or got[3]["n_dropped"] >= 3
    assert "Page" not in got[3]["kept"] and "logged" not in got[3]["kept"] and "footer" not in got[3]["kept"]
    assert got[52]["n_dropped"] == 1 and got[53]["n_dropped"] == 0 and got[53]["n_lines"] == 2
    assert got[50]["n_dropped"] == 0 and got[51]["kept"] == ""
    few = templates.drop_recurring_lines(spark.createDataFrame(rows[:5], "doc_id long, text string"))
    assert few.agg(F.sum("n_dropped")).head()[0] == 0
    assert templates.drop_recurring_lines(empty).count() == 0


def _lm_brute(rows, target):
    """Losses by definition: counts of all other texts, one word after the other."""
    numbered = []
    for d, t in rows:
        n, _ = lmscore.word_numbers(*textcols.utf8(pa.array([t], pa.string())))
        numbered.append((d, n.tolist()))
    out = []
    for i, (d, w) in enumerate(numbered):
        means = []
        for inside in (lambda k: k in target and k is not None, lambda k: True):
            pairs, contexts, singles = collections.Counter(), collections.Counter(), collections.Counter()
            for j, (e, x) in enumerate(numbered):
                if j != i and inside(e):
                    pairs.update(zip([0, *x], x))
                    contexts.update([0, *x][: len(x)])
                    singles.update(x)
            kinds = collections.Counter(u for u, _ in pairs)
            total = 0.0
            for u, x in zip([0, *w], w):
                p = (singles[x] + 1) / (sum(singles.values()) + lmscore.VOCABULARY - 1)
                if contexts[u]:
                    p = (pairs[u, x] + kinds[u] * p) / (contexts[u] + kinds[u])
                total -= np.log2(p)
            means.append(total / len(w) if w else None)
        out.append((d, len(w), *means))
    return out


def test_lm_scores(spark, docs, empty, monkeypatch):
    target = spark.createDataFrame([(1,), (1,), (9,), (None,)], "doc_id long")
    want = sorted(_lm_brute([(d, t) for d, t, _ in ROWS], {1, 9}), key=str)
    for chunk, ranges in ((1 << 21, 1 << 21), (5, 3)):
        monkeypatch.setattr(lmscore, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(lmscore, "RANGE_WORDS", ranges)
        got = sorted(((r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in lmscore.cross_entropy_difference(docs.repartition(3), target).collect()), key=str)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:2] == b[:2] and all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:])), (a, b)
    none = lmscore.cross_entropy_difference(docs, target.limit(0)).where("n_tokens > 0").collect()
    assert all(abs(r["target_loss"] - np.log2(lmscore.VOCABULARY - 1)) < 1e-9 for r in none)
    assert lmscore.cross_entropy_difference(empty, target).count() == 0


def test_lm_probabilities_sum_to_one():
    words, sizes = np.array([5, 9, 5, 9, 7, 5, 9], np.uint16), np.array([5, 2])
    pairs = lmscore._spread_pairs(words, sizes)
    known, n = np.unique(pairs, return_counts=True)
    key = (known * lmscore._GATHER).astype(np.int64)
    totals = np.zeros((lmscore.VOCABULARY, 6), np.int64)
    for u, w, c in zip((key // lmscore.VOCABULARY).tolist(), (key % lmscore.VOCABULARY).tolist(), n.tolist()):
        totals[u, 0] += c
        totals[u, 1] += 1
        totals[w, 2] += c
    # A third text "5 x" for every word x, of which only the first two are counted.
    every = np.arange(1, lmscore.VOCABULARY)
    probe = np.concatenate([words, np.column_stack([np.full(len(every), 5), every]).ravel().astype(np.uint16)])
    count = dict(zip(known.tolist(), n.tolist()))
    asked = np.unique(lmscore._spread_pairs(probe, np.array([5, 2, *[2] * len(every)])))
    stats = np.hstack([totals[:, :3], totals[:, :3]])
    counts = np.array([count.get(k, 0) for k in asked.tolist()])
    loss, _ = lmscore.losses(probe, np.array([5, 2, *[2] * len(every)]), np.zeros(2 + len(every), bool), counts, counts, stats)
    assert abs((2.0 ** -loss[len(words) + 1 :: 2]).sum() - 1) < 1e-9


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        w = [f"w{k}" for k in rng.integers(0, 300, int(rng.integers(5, 90)))]
        bad = int(rng.random() < 0.3)
        if bad:
            w[int(rng.integers(0, len(w)))] = str(rng.choice(["Nasty!", "vile", "(rotten)"]))
        rows.append((i, " ".join(w), bad))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").withColumn("quality", F.lit(1))
    got = toxicity.classify(table.select("doc_id", "text"), labels).toPandas()
    truth = np.array([r[2] for r in rows])
    assert ((got.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted.to_numpy() == truth[held.doc_id]).mean() > 0.95
    assert got.score.between(0, 1).all()
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert len(none) == len(ROWS) and all(r["score"] == 0 for r in none)
    net = toxicity.train(table, labels)
    scored = toxicity.score(docs, net)
    assert scored.count() == len(ROWS) and toxicity.score(empty, net).count() == 0


def test_gradients():
    texts = ["alpha beta gamma delta", "epsilon beta"]
    whole = toxicity.Words(*toxicity._joined(texts))
    t = whole.part(np.arange(len(whole.distinct)))
    net = toxicity.Network(t.distinct, np.zeros(len(t.distinct), np.float32), 3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    windows, _ = whole.windows()
    d = np.array([0.7, -0.4])

    def value():
        x = net.inputs(t)
        return float((net.forward(x @ net.p["wx"] + net.p["bx"], windows) * d).sum())

    x, keep = net.inputs(t), []
    net.forward(x @ net.p["wx"] + net.p["bx"], windows, keep)
    grad = net.backward(t, x, windows, keep, d)
    for key, at in (("wx", (3, 5)), ("u", (0, 2, 7)), ("u", (1, 1, 20)), ("wa", (4, 3)), ("va", (2,)), ("wo", (9,)), ("bx", (30,))):
        kept = net.p[key][at]
        net.p[key][at] = kept + 1e-2
        up = value()
        net.p[key][at] = kept - 1e-2
        down = value()
        net.p[key][at] = kept
        assert abs((up - down) / 2e-2 - grad[key][at]) < 2e-3 + 0.02 * abs(grad[key][at]), key


def test_near_vectors_in_many_cells(spark):
    """Vectors over all directions and a crowded one, for cells along few and many axes."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 5))
    x[300:] = x[299] + 0.12 * rng.standard_normal((200, 5))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table, 0.95, lead=2, per_tile=40).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    on = u @ u.T >= 0.95
    np.fill_diagonal(on, False)
    label = links.forest(on)
    assert on.sum() > 1000
    assert got == {i: (int(on[i].sum()), int(label[i])) for i in range(len(x))}
    for count in (1, 2, 5):
        f = vectors._dealt(np.eye(5), 0.4, 0.33, count)
        (out,) = f(iter([pa.RecordBatch.from_pydict({"rep": pa.array(range(500)), "c": pa.array([1] * 500), "dim": pa.array([5] * 500, pa.int32()), "v": pa.array(u.tolist(), pa.list_(pa.float64()))})]))
        cells = collections.defaultdict(list)
        for c, up, r in zip(out["cell"].to_pylist(), out["upper"].to_pylist(), out["rep"].to_pylist()):
            cells[c].append((r, up))
        met = collections.Counter(frozenset((a, b)) for g in cells.values() for i, (a, x1) in enumerate(g) for b, x2 in g[i + 1 :] if not (x1 and x2))
        assert max(met.values()) == 1 and all(met[frozenset((a, b))] for a in range(500) for b in range(a) if np.linalg.norm(u[a] - u[b]) <= 0.33)
