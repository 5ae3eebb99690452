"""A small table of awkward documents, and words as the contracts have them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, size long, shard int, slot int, bucket long, part int, place int, rid long, h long, fp long, words string, spans int, host string, n_lines string, quality string, kept string, label int"
LONG = " ".join(f"word{i % 997} tail{i % 13}" for i in range(60_000))
PROSE = "It was a bright cold day in April and the clocks were striking thirteen while Winston Smith slipped quickly through the glass doors of the mansions though not quickly enough to prevent a swirl of gritty dust from entering along with him and the hallway smelt of boiled cabbage and old rag mats at one end of it a coloured poster too large for indoor display"

TEXTS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, None, "en", "a"),
    (4, "", "en", None),
    (5, " \t\n\r ", None, "b"),
    (6, LONG, "en", "b"),
    (None, PROSE + " more", "en", "b"),
    (None, PROSE + " more", "en", "b"),
    (7, "Ünïcode ÄÖ İ ß ſ     x́ é 日本語 '" + "s 1234 <|endoftext|>", "xx", "c"),
    (8, "Released under the MIT License.\nCC BY-NC cc by nc\nApache License, Version 2.0", "en", "c"),
    (9, "single", None, None),
    (10, "a b", "en", "c"),
    (11, "x" * 30_000, "en", "c"),
]


def awkward(spark: SparkSession, parts: int = 3) -> DataFrame:
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves."""
    rest = (5, 9, 9, 9, 9, 9, 9, 9, 9, "w", 1, "h", "n", "q", "k", 1)
    return spark.createDataFrame([(*t, *rest) for t in TEXTS], SCHEMA).repartition(parts)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
