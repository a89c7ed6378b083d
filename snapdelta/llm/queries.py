"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import ann, bpe, centroids, importance, language, line_dedup, mixing, ngram_join, quality, quotes, secrets, setsketch, winnow
from .sql import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.in_reply_order(quotes.quotation_links(_table(spark, sf_dir, "conversations")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard(_table(spark, sf_dir, "documents"), shingle=3, num=9, den=10)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    narrow = docs.select("doc_id", "text")
    return language.identify(narrow, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op6_rotated_codes_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # languages alike, sources by their number of documents, topics by a flattened share of tokens
    langs = docs.select(F.col("lang").alias("value")).distinct().withColumn("share", F.lit(1.0))
    sources = docs.groupBy(F.col("source").alias("value")).agg(F.count("*").cast("double").alias("share"))
    mixed = mixing.mix(docs, targets={"lang": langs, "source": sources}, most_gap=None)
    return mixed.select("doc_id", "source", "lang", *(F.col(f"_{c}").alias(c) for c in ("topic", "tokens", "weight", "p")), F.col("_take").alias("taken"), F.col("_gap").alias("gap"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(_table(spark, sf_dir, "documents"))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, num=4, den=5)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(ship_package(spark), sf_dir)


QUERIES = {f.__name__: f for f in (op1_quotation_links, op2_ngram_jaccard_join, op3_secret_scan, op4_language_id, op5_line_dedup, op6_rotated_codes_search, op7_byte_bpe, op8_site_quality, op9_mixing, op10_winnowing, op11_setsketch, op12_importance, op13_centroids, pipeline)}
