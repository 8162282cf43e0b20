"""Registered queries of the llm operators: each applies its operator, with production
parameters, to its whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.oracles import ORACLES as ORACLES  # noqa: PLC0414
from rollframe.llm.work import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents")).drop("clean_text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; ids as count and hash, and whether the text came back."""
    from rollframe.llm.sentencepiece import piece_decode, piece_encode

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = piece_decode(piece_encode(docs), "ids", "decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                      F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.url_filter import url_filter

    return url_filter(read_table(spark, sf_dir, "pages")).drop("score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.sharding import assign_shards

    out = assign_shards(read_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.quality_classifier import quality_classifier

    out = quality_classifier(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.line_dedup import line_dedup

    out = line_dedup(read_table(spark, sf_dir, "documents"), "source", "text")
    return out.select("doc_id", "n_lines", "n_dropped_lines", F.sha2("text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.decontamination import decontaminate

    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.jaccard_join import jaccard_classes

    return jaccard_classes(read_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.suffix_dedup import suffix_dedup

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return suffix_dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the conversations rebuilt on the beginnings of others."""
    from rollframe.llm.prefix_trie import encoded_turns, ends_digests, prefix_trie, spliced

    return ends_digests(prefix_trie(*spliced(encoded_turns(read_table(spark, sf_dir, "conversations")))))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.mixing import mix_sources, taken_words

    out = taken_words(mix_sources(read_table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollframe.llm.whitening import component_rows, whiten

    return component_rows(whiten(read_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_sharding": op4_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_mix": op12_source_mix,
    "op13_embedding_whitening": op13_embedding_whitening,
}
