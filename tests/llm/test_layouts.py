"""The text operators give the same rows however their input is dealt, with very long texts, nulls and repeated rows."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from spotloom.llm import decontam, lmscore, mixture, neardup, records, repeats, templates, textcols, toxicity  # noqa: E402


def _rows():
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), n))
    shared, footer = text(60), "all rights reserved to the owners of this page"
    rows = [(i, f"{text(40)}\n{shared if i % 3 == 0 else text(20)}\n{footer}", "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace("w1", "x1", 1), "a") for i in range(20)]
    rows += [(200 + i, rows[7][1], None) for i in range(15)]
    # Longer than a chunk of text: its words meet those of the others in a chunk of its own.
    rows += [(300, f"{shared} {text(450_000)} {rows[3][1]}", "b"), (301, None, "b"), (302, "", None), (303, "one", "c"), (None, rows[5][1], "a"), (None, None, "a")]
    return rows + [rows[0], rows[9], rows[-2]]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"v": F.lit(1), "key": F.lit("k"), "size": F.lit(2)})


def _operators(spark):
    bench = spark.createDataFrame([(1, ROWS[3][1]), (2, ROWS[0][1].split("\n")[1]), (3, "one")], "item_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    net = toxicity.fit([r[1] for r in ROWS[:40]], np.arange(40) % 2 == 0, np.ones(40), epochs=1, least_steps=4)
    return {
        "records": lambda d: records.encode_and_read(d, public_tokenizers.path("word_bpe_49k.json")),
        "losses": lambda d: lmscore.cross_entropy_difference(d, target),
        "toxicity": lambda d: toxicity.score(d.select("doc_id", "text"), net).select("doc_id", F.round("score", 3)),
        "decontamination": lambda d: decontam.report(d, bench),
        "mix": lambda d: mixture.mix(d),
        "bytes": lambda d: repeats.remove_repeated_bytes(d),
        "words": lambda d: repeats.remove_repeated_words(d),
        "near": lambda d: neardup.near_duplicates(d),
        "templates": lambda d: templates.drop_recurring_lines(d),
    }


@pytest.mark.parametrize("name", ["records", "losses", "toxicity", "decontamination", "mix", "bytes", "words", "near", "templates"])
def test_same_rows_in_any_layout(spark, docs, name):
    operator = _operators(spark)[name]
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r)
    # Records are laid out in ascending doc_id: rows of one doc_id (or of none) stand in any order.
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if name == "records" else docs
    one, seven = (collections.Counter(map(plain, operator(some.repartition(n)).collect())) for n in (1, 7))
    assert one == seven and sum(one.values()) == some.count()


def test_chunks_of_any_size(docs):
    """Kernels that see a text alone or among others tell it alike."""
    import pyarrow as pa

    column = pa.array([r[1] for r in ROWS[:40]], pa.string())
    batch = pa.RecordBatch.from_pydict({"text": column})
    whole = textcols.words(*textcols.utf8(column))
    for size in (1, 1000, 1 << 22):
        parts = list(textcols.chunks(batch, size=size))
        assert sum(p.num_rows for p in parts) == 40
        h = [neardup.shingle_hashes(*textcols.utf8(p["text"]), 3)[0] for p in parts]
        assert np.array_equal(np.concatenate(h), neardup.shingle_hashes(*textcols.utf8(column), 3)[0])
        n = [lmscore.word_numbers(*textcols.utf8(p["text"]))[0] for p in parts]
        assert np.array_equal(np.concatenate(n), lmscore.word_numbers(*textcols.utf8(column))[0])
    assert len(whole[0]) == sum(len(r[1].split()) for r in ROWS[:40])


def _templates(rows, min_docs, depth, min_fixed):
    """Lines that stay, by the definition of recurring_lines()."""
    mask = lambda x: re.sub("[^ ]*[0-9][^ ]*", templates.FIELD, re.sub("[\x20\x09-\x0d]+", " ", x).strip(" "))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if mask(x):
                holders[mask(x)].add((d, t))
    leaf = lambda x: (len(x.split(" ")), *x.split(" ")[:depth])
    weight = collections.Counter()
    for x, docs in holders.items():
        for i, token in enumerate(x.split(" ")):
            weight[leaf(x), i, token] += len(docs)
    template = {}
    for x in holders:
        tokens = x.split(" ")
        fixed = [w if weight[leaf(x), i, w] >= min_docs else templates.FIELD for i, w in enumerate(tokens)]
        share = sum(w != templates.FIELD for w in fixed) / len(tokens)
        template[x] = (leaf(x), *fixed) if len(tokens) > depth and share >= min_fixed else x
    members = collections.defaultdict(set)
    for x, docs in holders.items():
        members[template[x]] |= docs
    gone = {x for x in holders if len(members[template[x]]) >= min_docs}
    kept = lambda t: [x for x in (t or "").split("\n") if mask(x) not in gone]
    return collections.Counter((d, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept(t)), "\n".join(kept(t))) for d, t in rows)


@pytest.mark.parametrize(("min_docs", "depth", "min_fixed"), [(3, 2, 0.6), (4, 1, 0.5), (2, 2, 0.9)])
def test_templates_by_definition(spark, min_docs, depth, min_fixed):
    rng = np.random.default_rng(min_docs)
    heads, words = ["user logged", "error in", "page"], ["red", "blue", "green", "from", "to", "at", "noon", "7up", "x"]
    line = lambda: rng.choice([f"{rng.choice(heads)} {' '.join(rng.choice(words, int(rng.integers(0, 5))))} {rng.integers(0, 9)}", "\t same  footer ", "", " ", f"{rng.choice(words)}"])
    rows = [(int(i) if i % 7 else None, "\n".join(line() for _ in range(int(rng.integers(1, 6))))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "\n\n")] + rows[3:6] * 5 + [(70, rows[4][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "tokens": F.lit(1)})
    got = collections.Counter(tuple(r) for r in templates.drop_recurring_lines(table, min_docs, depth, min_fixed).collect())
    assert got == _templates(rows, min_docs, depth, min_fixed)


def test_repeated_rows_are_one_document(spark):
    table = spark.createDataFrame([(1, "first line of it\nsecond line of it")] * 12 + [(2, "other text")], "doc_id long, text string")
    assert templates.drop_recurring_lines(table).agg(F.sum("n_dropped")).head()[0] == 0


def test_network_reads_more_than_words():
    """Every text has the same words; those are toxic in which one of them comes right before another. The word vectors'
    starting values know nothing of that, so only the trained network can tell."""
    rng = np.random.default_rng(21)
    fill = [f"f{i}" for i in range(12)]
    texts, toxic = [], []
    for i in range(1200):
        w = list(rng.choice(fill, 10))
        w[2:4] = ["zap", "bad"] if i % 2 else ["bad", "zap"]
        texts.append(" ".join(w))
        toxic.append(bool(i % 2))
    toxic = np.array(toxic)
    net = toxicity.fit(texts[:900], toxic[:900], np.ones(900), least_steps=400)
    held = np.arange(900, 1200)
    raw, offsets = toxicity._joined([texts[i] for i in held])
    right = ((net.scores(raw, offsets) >= 0.5) == toxic[held]).mean()
    t = toxicity.Words(raw, offsets)
    untrained = toxicity.fit(texts[:900], toxic[:900], np.ones(900), epochs=0, least_steps=0)
    start = ((untrained.scores(raw, offsets) >= 0.5) == toxic[held]).mean()
    assert len(t.distinct) == 14 and right > 0.9 and start < 0.7, (right, start)
