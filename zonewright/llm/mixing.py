"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.common import number_rows, running_offsets, sorted_parts, source_key, with_row_ids, word_count

ROWS_A_BUCKET = 8_000
#: Rows of the same source, id and size are alike to the queue; so many of them are spread over slices of their own.
MANY_ALIKE = 1_000


def repeating_weights(keys: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source_key, weight): the sources in code-point order, null last, weigh as the cycle says, over and over."""
    ranked = number_rows(keys.select("source_key").distinct(), ["source_key"], "mix-sources")
    steps = F.array(*[F.lit(int(w)) for w in cycle])
    return ranked.select("source_key", F.element_at(steps, (F.col("position") % len(cycle) + 1).cast("int")).alias("weight"))


def fair_targets(sources: DataFrame, budget: float, max_repeats: int) -> tuple[DataFrame, float]:
    """Targets of (source_key, source_size, weight): shares of the budget by weight, none above max_repeats sizes.

    The excess of capped sources is shared again by weight until no source is above its cap. Only sums come to the
    driver: each round is one aggregation over the table of sources. Returns the table with `target`, and the
    common level (tokens for each unit of weight).
    """
    cap = F.col("source_size") * F.lit(max_repeats)
    level, capped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        got = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if got["n"] == capped or not got["weight"]:
            break
        capped, level = got["n"], (budget - got["size"]) / got["weight"]
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))), level


def fair_queue(items: DataFrame, weights: DataFrame | None = None, *, budget_share: float = 1.0, max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """Mix items (rid long unique, doc_id, source_key, size long) to target weights.

    Every source's documents are shuffled by a seeded hash and queue up to max_repeats times. A queued document's
    virtual finish time is the source's tokens up to and with it, divided by the source's weight. The queue of all
    sources is range-sorted by that time and cut where its tokens reach the budget (budget_share of all tokens).

    A source's running total comes from sums over equal slices of the hash range, so no task holds a whole source,
    however hot. Rows that hash alike (repeated rows, rows without ids) and are many stand behind the others of their
    slice, dealt out by row to slices of their own; as they are alike in all that counts here, any order of them gives
    the same mix. Ties of the time break by source, hash, id and repeat: reruns agree. An empty source or an all-empty
    table takes nothing. Returns rid, doc_id, source_key, size, copies int, taken long, source_size long,
    weight int, target double, first_finish double (null when not taken).
    """
    spark = items.sparkSession
    base = items.select("rid", "doc_id", "source_key", "size", F.xxhash64(F.lit(seed), "doc_id", "source_key", "size").alias("h"))
    rows = base.count()
    bits = max(1, (max(rows, 1) // ROWS_A_BUCKET).bit_length())
    base = base.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    many = base.groupBy("source_key", "bucket", "h").count().filter(F.col("count") > MANY_ALIKE)
    # Spark broadcasts these few if their stored size allows.
    many = materialize(many.select("source_key", "bucket", "h", F.ceil(F.col("count") / MANY_ALIKE).alias("lots")), "mix-alike")
    alike = F.when(F.col("lots").isNotNull(), F.col("h")).otherwise(0)
    lot = F.when(F.col("lots").isNotNull(), 1 + F.pmod(F.xxhash64("rid"), F.col("lots"))).otherwise(0)  # 0: all that are not many
    base = base.join(many, ["source_key", "bucket", "h"], "left").withColumn("alike", alike).withColumn("lot", lot).drop("lots")
    cell = ["source_key", "bucket", "alike", "lot"]
    slices = materialize(base.groupBy(*cell).agg(F.sum("size").alias("slice_size")), "mix-slices")
    sizes = slices.groupBy("source_key").agg(F.sum("slice_size").cast("long").alias("source_size"))
    weights = repeating_weights(sizes) if weights is None else weights
    sources = materialize(sizes.join(weights.select("source_key", F.col("weight").cast("int").alias("weight")), "source_key"), "mix-weights")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget = int(total * budget_share)
    targets, _ = fair_targets(sources, float(budget), max_repeats)
    targets = materialize(targets, "mix-targets")

    # one row a slice, that is one for some thousands of documents
    ahead = Window.partitionBy("source_key").orderBy("bucket", F.col("lot") > 0, "alike", "lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(*cell, F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("start")).join(targets, "source_key")
    within = Window.partitionBy(*cell).orderBy("h", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    queued = base.join(starts, cell).withColumn("upto", F.col("start") + F.sum("size").over(within))
    queue = queued.select("rid", "doc_id", "source_key", "size", "h", "source_size", "weight", "target", "upto", F.explode(F.sequence(F.lit(1), F.lit(max_repeats))).alias("repeat")).withColumn(
        "finish", (F.col("upto") + (F.col("repeat") - 1) * F.col("source_size")) / F.col("weight")
    )
    order = ["finish", "source_key", "h", "doc_id", "rid", "repeat"]
    stored = sorted_parts(queue, order, "mix-queue")
    cuts = materialize(running_offsets(stored, F.col("size")), "mix-cuts")
    # The cut falls inside one part at most: only that part needs running totals.
    edge = cuts.filter((F.col("before") < budget) & (F.col("before") + F.col("part_amount") > budget)).first()
    last_full = cuts.filter(F.col("before") + F.col("part_amount") <= budget).agg(F.max("part")).first()[0]
    run = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    taken = stored.withColumn("in", F.col("part") <= F.lit(-1 if last_full is None else last_full))
    if edge is not None:
        inside = stored.filter(F.col("part") == edge["part"]).withColumn("in", F.sum("size").over(run) + F.lit(edge["before"]) <= F.lit(budget))
        taken = taken.filter(F.col("part") != edge["part"]).unionByName(inside)
    of = F.col("in") & (F.col("size") > 0)
    return taken.groupBy("rid").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source_key", "size", "source_size", "weight", "target")],
        F.count(F.when(F.col("in"), 1)).cast("int").alias("copies"),
        F.coalesce(F.sum(F.when(of, F.col("size"))), F.lit(0)).cast("long").alias("taken"),
        F.min(F.when(F.col("in"), F.col("finish"))).alias("first_finish"),
    )


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The digest of a mix of documents (doc_id, text, source): one row for each input row, null texts of size 0.

    Null sources form one source, last in order. Repeated rows stay separate rows. Extra columns are ignored.
    """
    sized = docs.select("doc_id", source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"))
    items = materialize(sized.withColumn("rid", F.monotonically_increasing_id()), "mix-items")
    return fair_queue(items, weights, **options)


def mixed_rows(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The documents of a mix with all their columns, each as often as the mix takes it; documents without words go."""
    columns = docs.columns
    kept = with_row_ids(docs, "mix-rows")
    items = materialize(kept.select("doc_id", source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"), F.col("_zw_rid").alias("rid")), "mix-items")
    copies = fair_queue(items, weights, **options).filter((F.col("copies") > 0) & (F.col("size") > 0))
    copies = copies.select(F.col("rid").alias("_zw_rid"), F.col("copies").alias("_zw_copies"))
    return kept.join(copies, "_zw_rid").withColumn("_zw_n", F.explode(F.sequence(F.lit(1), F.col("_zw_copies")))).select(*columns)
