"""A training-data pipeline: five stages over the documents, each written before the next one reads it.

Documents may have further columns of any name; the stages but the last keep them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolattice.llm import decontamination, near_dups, piece_coding, quality_rules, toxicity
from hydrolattice.llm.shared import put_back, set_apart, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = [f"_own{i}" for i in range(len(docs.columns))]
    return put_back(quality_rules.judge(set_apart(docs, ["text", "source"]), own).where("kept"), docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half. The model learns from the labels of the documents that came in."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~toxicity.held_out())
    own = [f"_own{i}" for i in range(len(docs.columns))]
    return put_back(toxicity.score(set_apart(docs, ["text"]), own, model).where("predicted = 0"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dups.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of each document, as counts and digests."""
    coded = piece_coding.encode_decode(docs, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("pieces", pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
