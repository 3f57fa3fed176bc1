"""The queries opN_<name>: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, exact_dedup, importance, line_dedup, media, neighbours, ngram_join, packing, quality, suffix_dedup, token_files, toxicity


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file, which the executors have in the same place."""
    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir), n=4, percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate_lines(documents(spark, sf_dir).select("doc_id", "text"), short=True)
    return found.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    encoded = bpe.encode(documents(spark, sf_dir), path)
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.rated(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), path)
    return token_files.read_tokens(spark, path)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.stored(media.text_media(documents(spark, sf_dir)))
    found = media.stored(media.media_features(stored).withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256)).drop("media"), "tiles")
    return found.select(
        "doc_id", "n_bytes",
        F.col("samples_bytes").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"), F.col("samples_tail_crc32").alias("tail_crc32"),
        "media_bytes", "media_sha256", F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.flagged(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair_report(turns).withColumnRenamed("conv", "conv_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = importance.resampled(documents(spark, sf_dir), target, percent=25, least_words=20, most=2, buckets=10000, seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, F.col("id") % 20 == 0, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard_join, op2_exact_dedup, op3_line_dedup, op4_bpe_round_trip, op5_best_fit_packing, op6_quality_classifier, op7_token_files, op8_suffix_array_dedup, op9_media_columns, op10_toxicity, op11_conversation_repair, op12_importance_resampling, op13_nearest_neighbours]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
        """,
    }
