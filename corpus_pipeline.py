"""A text-cleaning pipeline of five operators; every stage is written as Parquet and read again.

All stages but the last keep the columns of ``documents``; the last returns the token ids of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from wakeline.llm.common import BLANKS, table, whole_text
from wakeline.session import saved

#: The rank file of the last stage.
RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels that aren't held out."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted. A document of which no word is left goes: it was a copy as a whole."""
    out = line_dedup.drop_repeated_lines(docs)
    changed = F.col("_lines_deleted") > 0
    out = out.filter(~changed | (F.btrim(whole_text("text"), F.lit(BLANKS)) != ""))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words a shingle, 0.8)."""
    return near_dedup.drop_near_copies(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the bytes that the ids decode to."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ("ids", "decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies),
          ("decontamination", drop_benchmark_text), ("byte_bpe", encode)]
#: The toxicity stage is a trained model, which SQL can't express; tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
