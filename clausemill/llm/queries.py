"""The operators of this subpackage over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold
from .conversations import damaged, digests, key_of, repair_conversations
from .decontaminate import find_leaks
from .hnsw import embedding_links
from .infill import fill_in_middle, restored
from .langid import predict_language, train_language_id
from .licenses import scan_licenses
from .lines import dedup_lines
from .lm_scoring import score_texts
from .mixing import mix_sources
from .ngram_join import ngram_join
from .secrets import BASE_RULES, listed, scan_secrets
from .sharding import shard_documents
from .topk import top_inner_products


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "n_bytes", "shard_id", "depth", "shard_bytes")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind_no"] < len(BASE_RULES))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train_language_id(docs, ~held_out)
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = repair_conversations(damaged(rows))
    told = rows.select("conv_id").distinct().withColumn("conv", key_of(F.col("conv_id")))
    told = told.join(repair.summary.hint("merge"), "conv", "left").join(digests(repair.blocks).hint("merge"), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda text, name: F.sha2(text, 256).alias(name)
    return out.select("doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                      sha(F.col("fim_text"), "output_sha256"), sha(restored(F.col("form"), F.col("fim_text")), "restored_sha256"))


def queries():
    ops = (op1_lm_scoring, op2_sharding, op3_embedding_dedup, op4_source_mixing, op5_line_dedup, op6_secret_scan,
           op7_ngram_join, op8_license_scan, op9_decontamination, op10_language_id, op11_conversation_repair, op12_top_k, op13_fill_in_middle)
    return {f.__name__: f for f in ops}
