"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontaminate, minhash, pack, quality, substring
from cohortlens.llm.queries import tokenizer_path
from cohortlens.session import shared_dir, stage

#: Words of a passage that is cut where it repeats.
WINDOW = 20


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from all of ``labels``."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 0.8): the one with the smallest doc_id.

    Documents without words, and those without a doc_id, are nobody's copies and stay. Rows that repeat both doc_id
    and text stay once.
    """
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    left = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    again = stage(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return left
    once = left.join(again.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    return once.union(left.join(again.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of WINDOW words or more that also start earlier in the corpus."""
    return substring.remove_repeats(docs, WINDOW)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths up to 2048 ids, each from one document."""
    return pack.pack(docs, tokenizer_path(), 2048)


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats),
          ("decontaminate", drop_benchmark), ("pack", pack_sequences)]

#: The classifier, the banded alignment and the tokenizer have no SQL form; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written as Parquet and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
