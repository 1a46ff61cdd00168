"""Corpus pipeline: five stages over ``documents``, each on what the one before it kept.

quality: documents that the classifier rejects go.
exact: of equal texts the row with the largest doc_id stays.
near: one document of each near-duplicate group stays (five-word shingles, similarity 0.8).
mix: documents are chosen to the target weights. One epoch at most: a repeated
    row would undo the two stages before.
bpe: every document that is left, encoded and decoded; ids and digests.

Every stage's rows are written and read again, so a lost executor repeats at
most one stage; ``run`` deletes a stage's scratch once its rows are there. Nulls, empty tables and further columns are treated as the
operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, exact_dedup, minhash_dedup, mixing, quality
from lodestone.llm.common import discard, made_so_far, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.survivors(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, mixing.domain_of(F.col("source")), F.col("tokens") * mixing.PART, mixing.WEIGHTS, mixing.SEED, max_epochs=1)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids_as_text=True))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("bpe", bpe_stage)]

#: The classifier, the near-duplicate search and the tokenizer have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), made_so_far()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # The stage's rows are written: its scratch, and the rows of the stage before, are read no more.
        discard(spark, since, made_so_far() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
