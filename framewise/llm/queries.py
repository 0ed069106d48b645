"""The thin queries opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import bpe, fingerprint, mixing, nearest, neardup, negatives, phrases, quality, rules, secrets, sharding, suffixes, surrogates
from framewise.llm.common import read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(read(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.stripped(read(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest.top_k(rows.filter(F.col("vec_id") % 100 == 0), rows)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.framewise.pii.key", "for checks only")
    return surrogates.pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), *bpe.default_vocabulary())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(read(spark, sf_dir, "documents"), n_shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, negatives.relabelled())


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_neardup": op2_neardup,
    "op3_quality": op3_quality,
    "op4_suffixes": op4_suffixes,
    "op5_topk": op5_topk,
    "op6_surrogates": op6_surrogates,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_negatives": op11_negatives,
    "op12_rules": op12_rules,
    "op13_phrases": op13_phrases,
}
ORACLE: dict[str, str] = {
    "op1_secrets": secrets.SQL,
    "op5_topk": nearest.SQL,
    "op9_sharding": sharding.SQL,
    "op10_mixing": mixing.SQL,
    "op11_negatives": negatives.SQL,
    "op12_rules": rules.SQL,
    "op13_phrases": phrases.SQL,
}
