"""From raw documents to token ids: quality rules, line dedup, near-duplicate join, decontamination, BPE.

A stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the
columns of ``documents``. Documents leave in three stages, and lines in one: a document that the rules
reject, all but the smallest id of a group of near copies, a document that holds a benchmark item; lines
found in ten documents or more of what the rules keep. Every decision is taken on the stage's own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.functions.staging import staged
from stormglass.llm import bpe, decontaminate, jaccard, lines, rules

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor meet a learned rejecting rule."""
    return rules.keep(docs, rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return lines.dedup(docs, min_docs=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a shingle similarity of 0.8 or more."""
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in any passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its id, n_tokens, the token ids, and the text decoded from them."""
    encoded = staged(bpe.encode(docs, RANKS).select("doc_id", "ids"), "token-ids")  # one Python worker a task at a time
    decoded = bpe.decode(encoded, RANKS)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot learn the rules or merge token pairs; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
