"""The named queries of the text operators, with their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, merkle, mixing, quality_cnn, rules, secrets, shards, simhash, sql, token_counts, tokens, urls, warc, winnow
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.round_trip(table(spark, sf_dir, "documents"), str(path))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document with the page's number: bad is quality 0."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), labels).withColumn("rate", F.round("rate", 9))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), str(path))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc": (op1_warc, sql.WARC),
    "op2_simhash": (op2_simhash, None),
    "op3_tokens": (op3_tokens, None),
    "op4_urls": (op4_urls, sql.URLS),
    "op5_kd_shards": (op5_kd_shards, None),
    "op6_secrets": (op6_secrets, None),
    "op7_cnn": (op7_cnn, None),
    "op8_rules": (op8_rules, sql.RULES),
    "op9_winnow": (op9_winnow, sql.WINNOW),
    "op10_mix": (op10_mix, sql.MIX),
    "op11_merkle": (op11_merkle, sql.MERKLE),
    "op12_token_counts": (op12_token_counts, None),
    "op13_hard_negatives": (op13_hard_negatives, sql.NEGATIVES),
}
