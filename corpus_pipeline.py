"""A training corpus from the documents table: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.llm import bpe, line_dedup, mixing, ngram_join, quality
from snapdelta.llm.common import materialise
from snapdelta.session import ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the site-aware quality model rejects go."""
    ship_package(spark)
    scored = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_columns=True)
    return scored.where("_keep").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that match an earlier one go; a document left without any text by that goes too."""
    ship_package(spark)
    lines = line_dedup.line_dedup(docs, keep_columns=True)
    emptied = (F.col("_n_removed") > 0) & ~F.col("text").rlike(r"[^\s\p{Z}]")
    lines = lines.where(~F.coalesce(emptied, F.lit(False)))
    return lines.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near copies (five-word shingles, 0.8) the smallest id stays."""
    ship_package(spark)
    return ngram_join.one_of_each(docs, ngram_join.ngram_jaccard(docs, shingle=5, num=4, den=5))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents drawn by their calibrated chance."""
    return mixing.mix(docs).where("_take").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token ids of each text, and hashes for the round trip."""
    ship_package(spark)
    return bpe.encode_decode(docs, keep_ids=True)


STAGES = [("quality", keep_good), ("line_dedup", drop_repeated_lines), ("near_copies", one_of_near_copies), ("mixing", mix_to_targets), ("byte_bpe", tokenise)]

#: SQL cannot express the trained classifier of the first stage, nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
