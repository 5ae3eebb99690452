"""Quality rules whose thresholds come from quantile sketches of each language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.functions.storage import materialize
from zonewright.llm.common import forget, source_key, texts

SPACE, SYMBOLS, UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS = 50
#: A group's quartiles weigh as many documents as it has against so many of its language, and these likewise against all.
PRIOR_DOCUMENTS = 100
#: Thresholds stand this many quartile ranges beyond the quartiles.
RANGES = 4
#: A thousand times the quartile range that chance alone gives the root of a rate, or a mean of its own size, times the
#: root of how many it is over: 1.35 deviations of a half.
CHANCE = 675.0
#: Measure: (numerator, denominator, whether it counts rare events, whether low values count too).
MEASURES = {
    "symbols": ("n_symbols", "word_chars", True, False),
    "upper": ("n_upper", "word_chars", True, False),
    "dup_lines": ("n_dup_lines", "n_lines", True, False),
    "word_length": ("word_chars", "n_words", False, True),
}
#: A sketch has this many bins for each power of two, and is exact below twice as many.
BIN_BITS = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    text = text or b""
    words = text.split()
    spaces = len(text) - len(text.translate(None, SPACE))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            twice = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
            inside = np.zeros(len(words), dtype=bool)
            for k in range(3):
                inside[k : k + len(twice)] |= twice
            repeated = int(inside.sum())
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - spaces,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
    )


def _count_batches(text_at: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            rows = [text_counts(t) for t in texts(b.column(text_at))]
            counts = zip(*rows) if rows else [[] for _ in COUNTS]
            columns = [*b.columns[:width], *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return run


def counted(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs with lang_key, source_key and COUNTS (each behind _zw_), stored: texts are counted once."""
    columns = [*[F.col(c) for c in carry], source_key(F.col("lang")).alias("_zw_lang_key"), source_key(F.col("source")).alias("_zw_source_key")]
    width = len(columns)
    bare = docs.select(*columns, *([] if "text" in carry else [F.col("text").cast("string").alias("text")]))
    kept = T.StructType(bare.schema.fields[:width] + [T.StructField(f"_zw_{c}", T.LongType()) for c in COUNTS])
    return materialize(bare.mapInArrow(_count_batches(bare.columns.index("text"), width), kept), "rules-counts")


def sketch_bin(v: Column) -> Column:
    """The bin of a whole number from 0: exact below 512, then 256 bins for each power of two (within 1/256)."""
    e = F.length(F.bin(v)) - 1
    coarse = (1 << BIN_BITS) * (e - BIN_BITS) + F.call_function("shiftright", v, (e - BIN_BITS).cast("int"))
    return F.when(v < 2 << BIN_BITS, v).otherwise(coarse).cast("long")


def bin_start(b: Column) -> Column:
    """The smallest number of a bin."""
    e = (F.floor(b / (1 << BIN_BITS)) - 1).cast("int")
    return F.when(b < 2 << BIN_BITS, b).otherwise(F.call_function("shiftleft", (b - (1 << BIN_BITS) * e).cast("long"), e)).cast("long")


def measure(count: Column, of: Column, rare: bool) -> Column:
    """A whole number: 1000 times the rate, or the root of the rate where events are rare; 0 of nothing is 0.

    Roots of counts (with 3/8 added, as usual) spread alike whatever the count. So a document without a single event
    has a measure that tells how little its length lets us say, and quartiles that are never the same for want of events.
    """
    rate = (count + F.lit(0.375)) / of if rare else count / of
    return F.when(of > 0, F.floor(1000 * (F.sqrt(rate) if rare else rate))).otherwise(0).cast("long")


def _measured(counts: DataFrame) -> DataFrame:
    """Adds base_failed and each measure, all behind _zw_."""
    c = lambda n: F.col(f"_zw_{n}")
    failed = (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    values = {m: measure(c(n), c(d), rare) for m, (n, d, rare, _) in MEASURES.items()}
    return counts.withColumns({"_zw_base_failed": failed} | {f"_zw_v_{m}": v for m, v in values.items()})


def _quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, q1, q3) of sketches (keys, measure, bin, n)."""
    to_here, whole = Window.partitionBy(*keys, "measure").orderBy("bin"), Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumn("upto", F.sum("n").over(to_here)).withColumn("total", F.sum("n").over(whole))
    at = lambda k: bin_start(F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))))
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def adaptive_quartiles(measured: DataFrame) -> DataFrame:
    """(lang_key, source_key, q1_<measure>, q3_<measure>), stored, from the sketches of every group of `measured`.

    A sketch is the counts of sketch_bin over a group: of bounded size, and two merge by adding counts, in any order
    and to the same result. Sketches of languages and of all documents are merged from those of the groups.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_zw_v_{m}").alias("v")) for m in MEASURES])
    each = measured.select(F.col("_zw_lang_key").alias("lang_key"), F.col("_zw_source_key").alias("source_key"), F.inline(pairs)).withColumn("bin", sketch_bin(F.col("v")))
    group = materialize(each.groupBy("lang_key", "source_key", "measure", "bin").agg(F.count("*").alias("n")), "rules-sketches")
    language = group.groupBy("lang_key", "measure", "bin").agg(F.sum("n").alias("n"))
    everything = language.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    fine, coarse, all_ = (_quartiles(s, k) for s, k in ((group, ["lang_key", "source_key"]), (language, ["lang_key"]), (everything, [])))
    coarse = coarse.select("lang_key", "measure", *[F.col(c).alias(f"lang_{c}") for c in ("n", "q1", "q3")])
    all_ = all_.select("measure", F.col("q1").alias("all_q1"), F.col("q3").alias("all_q3"))
    joined = fine.join(coarse, ["lang_key", "measure"]).join(all_, "measure")
    toward = lambda n, own, prior: (n * own + PRIOR_DOCUMENTS * prior) / (n + PRIOR_DOCUMENTS)
    c = lambda name: F.col(name).cast("double")
    q1, q3 = (toward(c("n"), c(q), toward(c("lang_n"), c(f"lang_{q}"), c(f"all_{q}"))) for q in ("q1", "q3"))
    bounds = joined.select("lang_key", "source_key", "measure", q1.alias("q1"), q3.alias("q3"))
    at = lambda side, m: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}")
    return materialize(bounds.groupBy("lang_key", "source_key").agg(*[at(side, m) for m in MEASURES for side in ("q1", "q3")]), "rules-quartiles")


def thresholds(m: str) -> tuple[Column, Column]:
    """The lowest and highest value of a measure that a document may have.

    They stand RANGES ranges beyond its group's quartiles. The range is the group's, or what chance alone would give so
    short a document where that is more: also where most of a group are copies of one text, others are not outliers.
    """
    count, of, rare, _ = MEASURES[m]
    n, q1, q3 = F.col(f"_zw_{of}"), F.col(f"_zw_q1_{m}"), F.col(f"_zw_q3_{m}")
    chance = F.lit(CHANCE) / F.sqrt(n) if rare else F.lit(CHANCE) * (F.col(f"_zw_{count}") / n) / F.sqrt(n)
    reach = RANGES * F.greatest(q3 - q1, F.when(n > 0, chance).otherwise(0.0))
    return q1 - reach, q3 + reach


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """`carry`, the counts, the quartiles, _zw_base_failed and _zw_kept. Spark broadcasts the stored quartiles if their size allows."""
    measured = _measured(counted(docs, carry))
    bounds = adaptive_quartiles(measured.filter(~F.col("_zw_base_failed")))
    bounds = bounds.select(*[F.col(c).alias(f"_zw_{c}") for c in bounds.columns])
    verdict = ~F.col("_zw_base_failed")
    for m, (*_, both) in MEASURES.items():
        low, high = thresholds(m)
        verdict = verdict & (F.col(f"_zw_v_{m}") <= high)
        if both:
            verdict = verdict & (F.col(f"_zw_v_{m}") >= low)
    return measured.join(bounds, ["_zw_lang_key", "_zw_source_key"], "left").withColumn("_zw_kept", F.coalesce(verdict, F.lit(False)))


def rule_table(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept) of documents (doc_id, text, lang, source), one row for each.

    base_failed: fewer than 50 words, or over half of them in 3-word windows that repeat. The others are kept while
    every measure stays within its group's thresholds, which come from all documents that the base rules pass; no cutoff
    is fixed. Repeats are left to the base rule: they come in clumps, which a rate's spread does not foretell. Null
    texts have no words and fail; null languages and sources are groups of their own; a measure with denominator 0 is
    0. Repeated rows stay; an empty table gives no rows; extra columns are ignored.
    """
    names = [*COUNTS, "base_failed", "kept"]
    return judged(docs, ["doc_id"]).select("doc_id", *[F.col(f"_zw_{c}").alias(c) for c in names])


def keep_good(docs: DataFrame) -> DataFrame:
    """docs, with all columns, without those that the rules reject. Texts are written once and never shuffled."""
    return judged(docs, docs.columns).filter("_zw_kept").select(*docs.columns)
