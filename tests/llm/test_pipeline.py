"""Each stage of the pipeline against a brute-force version of its decisions, on the smallest documents."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from spotloom.llm import mixture, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def _tokens(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def _grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "source_mix", "token_records"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()}
    one = stage["toxicity"](spark, docs, SMALL)
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == {d for d, s in scores.items() if s < corpus_pipeline.TOXIC_FROM}

    sets = {}
    for d in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), rows[d] or ""))
        sets[d] = set(_grams(w, 5)) if len(w) > 4 else ({tuple(w)} if w else set())
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    twice = docs.unionByName(docs.where("doc_id = 3"))
    two = [r["doc_id"] for r in stage["near_dedup"](spark, twice, SMALL).collect()]
    assert sorted(two) == [d for d in ids if find(d) == d]

    bench = {r["item_id"]: collections.Counter(_grams(_tokens(r["text"]), 5)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    clean = set()
    for d in ids:
        g = _grams(_tokens(rows[d]), 5)
        hit = False
        for c in bench.values():
            m = sum(c.values())
            if not set(g) & set(c):
                continue
            for s in range(max(1, len(g) - m + 1)):
                w = collections.Counter(g[s : s + m])
                both = sum((w & c).values())
                hit |= 100 * both >= 80 * (m + sum(w.values()) - both)
        if not hit:
            clean.add(d)
    assert {r["doc_id"] for r in stage["decontamination"](spark, docs, SMALL).collect()} == clean

    four = stage["source_mix"](spark, docs, SMALL)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times = collections.Counter(r["doc_id"] for r in four.select("doc_id").collect())
    assert max(times.values()) <= 3 and four.columns == docs.columns
    total = sum(words(t) for t in rows.values())
    assert abs(sum(words(rows[d]) * n for d, n in times.items()) - total) < 0.05 * total

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = stage["token_records"](spark, docs, SMALL).orderBy("start").collect()
    start = 0
    for d, r in zip(ids, got, strict=True):
        t = np.array(tok.encode(rows[d] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(t), zlib.crc32(t.tobytes()))
        start += len(t)


def test_rows_without_a_key_of_their_own(spark):
    stage = dict(corpus_pipeline.STAGES)
    one, two, far = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(5, one, "z"), (5, one, "y"), (5, two, "y"), (2, far, "x"), (7, far, "x"), (None, far, "x"), (None, "few words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in stage["near_dedup"](spark, docs, SMALL).collect()]
    assert sorted(got, key=str) == sorted([(5, one, "y"), (5, two, "y"), (2, far, "x"), (None, far, "x"), (None, "few words", "x")], key=str)
    null = spark.createDataFrame([(None, f"text {i}", "a") for i in range(6)] + [(i // 2, f"word {i}", "b") for i in range(6)], docs.schema)
    texts = collections.Counter(r["text"] for r in stage["source_mix"](spark, null, SMALL).collect())
    want = collections.Counter()
    for r in mixture.mix(null).collect():
        want[r["doc_id"], r["source"]] += r["repeats"]
    assert texts and max(texts.values()) <= 3
    assert sum(n for t, n in texts.items() if t.startswith("text")) == want[None, "a"]
    for d in range(3):
        assert sum(texts[f"word {i}"] for i in (2 * d, 2 * d + 1)) == want[d, "b"]


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.where(F.col("n_tokens") < 1).count() == 0 and out.count() > 100


def test_near_duplicates_with_nested_columns(spark):
    """Maps have no order, arrays and structs do: one row of each text stays, however often it is repeated."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, {"a": 1}, [1], (2,)), (1, text, {"a": 0}, [1], (2,)), (2, text, None, None, None), (3, "other words here", {}, [], (1,)), (None, text, {"b": 2}, [3], (4,))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, v array<int>, s struct<k: int>")
    got = sorted((r["doc_id"] or 0, str(r["m"])) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect())
    assert got == [(0, "{'b': 2}"), (1, "{'a': 0}"), (3, "{}")]
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).columns == docs.columns
