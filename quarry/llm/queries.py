"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, embed_dedup, language_id, license_scan, lm_score, ring_shard, secret_scan, sentencepiece_codec, simhash_dedup, url_filter
from quarry.llm.common import read_table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = language_id.held_out(2, 4)
    model = language_id.train(docs, ~held)
    out = language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(read_table(spark, sf_dir, "documents"), sentencepiece_codec.Codec.load())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, radius=3)
    return out.select("doc_id", simhash_dedup.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8_ring_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shard.assign(read_table(spark, sf_dir, "documents"), shards=40)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read_table(spark, sf_dir, "documents"), language_id.held_out(1, 5))


QUERIES = {
    f.__name__: f
    for f in (op1_embedding_near_dedup, op2_license_scan, op3_language_id, op4_url_filter, op5_sentencepiece, op6_secret_scan, op7_simhash_near_dedup, op8_ring_shard, op9_decontamination, op10_lm_score)
}
