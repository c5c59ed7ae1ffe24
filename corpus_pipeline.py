"""From raw documents to token records: filter, deduplicate, decontaminate, mix, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm import decontam, mixture, neardup, records, toxicity
from spotloom.llm.shared import save

TOXIC_FROM = 0.3
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, "__toxicity").where(f"__toxicity < {TOXIC_FROM}").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group whose 5-word shingles are 80 % alike; rows without doc_id stay.

    Of rows with one doc_id and one text the one with the least other columns stays; other texts of that doc_id stay too.
    """
    found = neardup.near_duplicates(docs, 80, 5, with_digest=True).where("kept and doc_id is not null")
    kept = save(found.select(F.col("doc_id").alias("__of"), F.col("v").alias("__ov")).distinct(), "pipeline-kept")
    same = (F.col("doc_id").cast("long") == F.col("__of")) & (F.xxhash64("text") == F.col("__ov"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.struct(F.lit(0), *others)
    if any("map<" in docs.schema[c].dataType.simpleString() or "variant" in docs.schema[c].dataType.simpleString() for c in others):
        pick = F.min_by(least, F.to_json(least))  # maps have no order: that of their text stands in for it
    else:
        pick = F.min(least)
    once = docs.join(kept.hint("merge"), same, "left_semi").groupBy("doc_id", "text").agg(pick.alias("__o"))
    once = once.select(*[c if c in ("doc_id", "text") else F.col(f"__o.{c}") for c in docs.columns])
    return once.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 80, 5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records, described as they are read back: doc_id, start, n_tokens, ids_crc32."""
    return records.encode_and_read(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_records", write_tokens),
]
#: A trained network and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each reading what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
