"""From raw documents to packed sequences: rules, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonewright.functions.storage import materialize
from zonewright.llm.common import WORD_VOCABULARY, tokenizer_file
from zonewright.llm.jaccard import keep_one_alike
from zonewright.llm.line_dedup import dedup_lines
from zonewright.llm.mixing import mixed_rows
from zonewright.llm.packing import pack_documents
from zonewright.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their source, where copies of a text are one page, go; every document stays."""
    return dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id: 5-word Jaccard similarity of 0.8 or more.

    SimHash links, verified, and completed where 3 bits are too few.
    """
    return keep_one_alike(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources takes it: not at all, or up to three times."""
    return mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, with their token ids."""
    return pack_documents(docs, tokenizer_file(WORD_VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Groups of near copies, the queue and the tokenizer are beyond SQL; tests hold each stage against SQL or plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; each stage is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
