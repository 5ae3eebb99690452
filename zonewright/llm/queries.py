"""The queries of this subpackage: op1 to op13, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from zonewright.llm.byte_pairs import decode_documents, encode_documents
from zonewright.llm.common import BYTE_VOCABULARY, PIECE_VOCABULARY, WORD_VOCABULARY, tokenizer_file
from zonewright.llm.conversation_trie import conversation_trie
from zonewright.llm.license_scan import license_table
from zonewright.llm.line_dedup import dedup_lines
from zonewright.llm.mixing import mix_documents
from zonewright.llm.oracles import license_scan_sql, line_dedup_sql, nearest_neighbours_sql, quality_rules_sql
from zonewright.llm.packing import pack_documents
from zonewright.llm.quality_model import quality_posteriors
from zonewright.llm.quality_rules import rule_table
from zonewright.llm.sharding import external_shuffle, write_shards
from zonewright.llm.simhash import hex_mark, near_duplicate_groups
from zonewright.llm.token_counts import token_counts
from zonewright.llm.vector_search import nearest_neighbours
from zonewright.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "weight", "copies", "first_finish")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_posteriors(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(external_shuffle(_table(spark, sf_dir, "documents"), 16))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return shards.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file(WORD_VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_file(PIECE_VOCABULARY))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_table(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows' result, without the exact check that the operator offers."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, complete=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_table(_table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_mark(F.col("fp")).alias("fingerprint"), "component_id")


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file(BYTE_VOCABULARY)
    both = decode_documents(encode_documents(_table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_mix_sources,
        op2_quality_classifier,
        op3_shard_documents,
        op4_pack_sequences,
        op5_token_counts,
        op6_quality_rules,
        op7_nearest_neighbours,
        op8_line_dedup,
        op9_license_scan,
        op10_simhash_near_dedup,
        op11_whiten_embeddings,
        op12_bpe_codec,
        op13_conversation_trie,
        pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Of the others, the order of a shuffle, token ids, fitted weights and hashes are beyond SQL; tests have brute force.

    That of op7 is brute force: windows find all of it on tables of up to two blocks, RECALL of it or so beyond.
    """
    return {"op6_quality_rules": quality_rules_sql(), "op7_nearest_neighbours": nearest_neighbours_sql(), "op8_line_dedup": line_dedup_sql(), "op9_license_scan": license_scan_sql()}
