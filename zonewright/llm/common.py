"""Shared pieces: word patterns, vocabulary files, global numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Public vocabulary files.
WORD_VOCABULARY, PIECE_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the same place on every machine of the cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_remembered: dict[Any, Any] = {}


def remembered(key: Any, make: Callable[[], Any]) -> Any:
    """What this Python worker remembers under key from task to task, made where it is missing; all else is forgotten.

    Workers outlive a stage. So they remember for one operator at a time, and what packing needs is not there still
    when the next stage's texts come.
    """
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Called by tasks that remember nothing."""
    _remembered.clear()


def texts(column: pa.Array, at_once: int = 512) -> Iterator[bytes | None]:
    """The texts of an Arrow column as bytes; only so many at once stand beside the column."""
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).cast(pa.binary()).to_pylist()


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def source_key(source: Column) -> Column:
    """A never-null key in the code-point order of the source, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(">"))


def sorted_parts(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df range-partitioned and sorted by order, stored with part (in order) and place (row in its part, from 0).

    Spark samples the ranges, so a part holds a bounded share of the rows as long as order ends in columns that
    tell the rows apart.
    """
    mark = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_zw_mark", mark)
    return materialize(
        ranged.withColumn("part", F.shiftright("_zw_mark", 33)).withColumn("place", F.col("_zw_mark").bitwiseAND((1 << 33) - 1)).drop("_zw_mark"),
        label,
    )


def running_offsets(stored: DataFrame, amount: Column) -> DataFrame:
    """(part, part_amount, before): each part's amount and the sum over the parts before it. One row per part."""
    sums = stored.groupBy("part").agg(F.sum(amount).alias("part_amount"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("part_amount").over(ahead), F.lit(0)))


def number_rows(df: DataFrame, order: list[str], label: str, name: str = "position") -> DataFrame:
    """df with its 0-based position in the global order, by ranges and offsets; no task sees more than its range."""
    stored = sorted_parts(df, order, label)
    offsets = running_offsets(stored, F.lit(1)).select("part", "before")
    return stored.join(offsets, "part").withColumn(name, (F.col("before") + F.col("place")).cast("long")).drop("part", "place", "before")


def with_row_ids(docs: DataFrame, label: str) -> DataFrame:
    """docs with _zw_rid: unlike for any two rows, and the same whenever the rows are read again.

    Where every doc_id is there and stands once, it serves. Otherwise the rows are numbered and stored with their number.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn("_zw_rid", F.col("doc_id").cast("long"))
    return materialize(docs.withColumn("_zw_rid", F.monotonically_increasing_id()), label)
