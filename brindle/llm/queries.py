"""The registered queries of the ten operators (thin: they derive the contract's columns from the operators' results)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed_dedup, mixing, oracle, pitman_yor, sentencepiece_sampling, simhash, suffix_dedup, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_sampling.round_trip(docs, sentencepiece_sampling.load_pieces(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.fold(F.col("doc_id")) != 0))
    out = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(_read(spark, sf_dir, "documents"), pitman_yor.fold(F.col("doc_id")) == 2)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(planted)))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("id") % 20 == 0, k=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_near_vectors": op2_near_vectors,
        "op3_mix_sources": op3_mix_sources,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_toxicity": op5_toxicity,
        "op6_pitman_yor": op6_pitman_yor,
        "op7_simhash": op7_simhash,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_chat_format": op9_chat_format,
        "op10_top_k": op10_top_k,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
