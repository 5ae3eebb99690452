"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize

#: Hash cells that buckets are made of; with buckets of 32 MB they serve 128 TB.
CELLS = 1 << 22
BUCKET_BYTES = 32 << 20
MOST_TO_BROADCAST = 100_000
#: Buckets are dealt to so many tasks at most, in runs of neighbours.
MOST_TASKS = 50_000


def _fisher_yates(seed: int, columns: list[str]):
    def shuffle(key: tuple, bucket: pa.Table) -> pa.Table:
        """One bucket, put into a canonical order first so that reruns agree, then permuted (numpy's is Fisher-Yates)."""
        order = pc.sort_indices(bucket.select(["_zw_hash", "_zw_row"]), sort_keys=[("_zw_hash", "ascending"), ("_zw_row", "ascending")])
        rng = np.random.Generator(np.random.PCG64([seed, key[0].as_py()]))
        bucket = bucket.take(order.take(pa.array(rng.permutation(len(bucket)))))
        position = pa.array(np.arange(len(bucket), dtype=np.int64) + bucket["_zw_before"][0].as_py())
        return bucket.select(columns).append_column("_zw_position", position)

    return shuffle


def external_shuffle(docs: DataFrame, n_shards: int = 16, *, bucket_bytes: int = BUCKET_BYTES, seed: int = 11, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows of docs in a random order, dealt to n_shards shards whose row counts differ by one at most.

    Pass 1 scatters the rows into buckets of about bucket_bytes by a seeded hash of id and text. Pass 2 shuffles each
    bucket in memory by Fisher and Yates. The buckets end to end are the order; it is cut into n_shards equal runs.
    There are as many tasks as buckets (MOST_TASKS at most), whatever the session's number of shuffle partitions.
    Identical rows hash alike, so a cell of the hash that outgrows a bucket is split by row number: no bucket holds a
    hot id or text. The row number is stable for input read from files; store other input first.

    Null ids and texts hash as nulls; repeated rows stay; an empty table gives no rows. Input columns called shard or
    slot are replaced, all others are kept. Adds shard int (0 to n_shards - 1) and slot long (gapless from 0).
    """
    docs = docs.drop("shard", "slot")
    columns = docs.columns
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + 64
    tagged = docs.withColumn("_zw_hash", F.xxhash64(F.lit(seed), id_column, text_column))
    tagged = tagged.withColumn("_zw_cell", F.pmod("_zw_hash", F.lit(CELLS))).withColumn("_zw_row", F.monotonically_increasing_id())
    cells = materialize(tagged.groupBy("_zw_cell").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")), "shard-cells")
    rows, total = cells.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_buckets = min(CELLS, max(1, math.ceil(total / bucket_bytes)))
    heavy = cells.filter(F.col("bytes") > 2 * bucket_bytes).select("_zw_cell", F.ceil(F.col("bytes") / bucket_bytes).cast("long").alias("_zw_splits"))
    n_heavy = heavy.count()  # at most one for every two buckets
    base = F.pmod("_zw_cell", F.lit(n_buckets)).cast("long")
    if n_heavy:
        tagged = tagged.join(F.broadcast(heavy) if n_heavy <= MOST_TO_BROADCAST else heavy, "_zw_cell", "left")
        tagged = tagged.withColumn("_zw_bucket", base + n_buckets * F.coalesce(F.pmod("_zw_row", "_zw_splits"), F.lit(0)))
        counts = tagged.groupBy("_zw_bucket").agg(F.count("*").alias("rows"))
    else:
        tagged = tagged.withColumn("_zw_bucket", base)
        counts = cells.groupBy(base.alias("_zw_bucket")).agg(F.sum("rows").alias("rows"))
    ahead = Window.orderBy("_zw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_zw_bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).cast("long").alias("_zw_before"))

    before = materialize(before, "shard-offsets")  # a row a bucket; joined plainly, it would have the texts shuffled once more
    small = before.count() <= MOST_TO_BROADCAST
    scattered = tagged.join(F.broadcast(before) if small else before, "_zw_bucket").select("_zw_bucket", "_zw_before", "_zw_hash", "_zw_row", *columns)
    out = docs.withColumn("_zw_position", F.lit(0).cast("long")).schema
    # A run of buckets is a run of the order, so a task's rows are of one shard or a few, and it writes as many files.
    scattered = scattered.repartitionByRange(min(n_buckets, MOST_TASKS), "_zw_bucket")
    shuffled = scattered.groupBy("_zw_bucket").applyInArrow(_fisher_yates(seed, columns), out)
    shard = F.expr(f"_zw_position * {n_shards} div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {n_shards - 1}) div {n_shards}")
    return shuffled.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_zw_position") - first).cast("long")).drop("_zw_position")


def write_shards(sharded: DataFrame, label: str = "shards") -> DataFrame:
    """Write the shards to the shared folder, one directory each, rows in slot order; returns the table read back."""
    return materialize(sharded.sortWithinPartitions("shard", "slot"), label, partition_by=["shard"])
