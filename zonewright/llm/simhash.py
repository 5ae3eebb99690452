"""Near-duplicates by SimHash, over an inverted index of the bytes at each position."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.common import forget, texts, with_row_ids
from zonewright.operators.components import connected_components

SHINGLE_WORDS = 3
MOST_BITS = 3
#: With 3 differing bits at most 3 of the 8 bytes differ, so 5 are the same.
LEAST_BYTES = 8 - MOST_BITS
#: All triples within either half of the 8 positions: any 5 positions have 3 in one half.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: A posting list above this is dealt out by two more positions.
LONGEST_LIST = 4096
SHINGLES_AT_ONCE = 1 << 16


def mask_of(positions: tuple[int, ...]) -> int:
    """The bits of these byte positions, as a signed 64-bit number."""
    return int(np.array(sum(0xFF << 8 * p for p in positions), dtype=np.uint64).astype(np.int64))


def marked(hashes: Iterable[np.ndarray], n: int) -> int:
    """The signed 64-bit SimHash of n hashes, given in arrays of little-endian unsigned 64-bit numbers; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for some in hashes:
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, words_each: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the lower-cased text's word shingles; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < words_each else list(map(b" ".join, zip(*(words[i:] for i in range(words_each)))))
    lots = (shingles[at : at + SHINGLES_AT_ONCE] for at in range(0, len(shingles), SHINGLES_AT_ONCE))
    return marked((np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(42)), dtype="<u8", count=len(some)) for some in lots), len(shingles))


def _fingerprints(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            marks = [fingerprint(t, words_each) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.int64())], names=["rid", "doc_id", "fp"])

    return run


def fingerprint_table(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(rid, doc_id, fp), stored: texts are read once. rid tells the rows apart, repeated ones too."""
    rid = F.col("_zw_rid") if "_zw_rid" in docs.columns else F.monotonically_increasing_id()
    bare = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(bare.mapInArrow(_fingerprints(words_each), "rid long, doc_id long, fp long"), "simhash")


def _roots(marks: np.ndarray, fixed: int) -> np.ndarray:
    """For each of these sorted distinct fingerprints, which agree in the fixed bits, the place of the smallest it reaches."""
    n, roots = len(marks), np.arange(len(marks))
    if n <= LONGEST_LIST:
        left, right = [], []
        for at in range(0, n, 256):
            x = marks[at : at + 256, None] ^ marks[None, at:]
            shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
            i, j = np.nonzero(shared >= LEAST_BYTES)
            near = np.bitwise_count(x[i, j]) <= MOST_BITS
            left.append(i[near] + at), right.append(j[near] + at)
        pairs = [(np.concatenate(left), np.concatenate(right))]
    else:  # all marks at up to 3 flips of the free bits: work in proportion to n, whatever the list's length
        free = [1 << b for b in range(64) if not (fixed >> b) & 1]
        flips = [np.uint64(sum(c)) for k in range(1, MOST_BITS + 1) for c in combinations(free, k)]
        pairs = []
        for flip in flips:
            other = marks ^ flip
            at = np.minimum(np.searchsorted(marks, other), n - 1)
            i = np.flatnonzero((marks[at] == other) & (at > np.arange(n)))
            if len(i):
                pairs.append((i, at[i]))
    while True:
        before = roots.copy()
        for i, j in pairs:
            low = np.minimum(roots[i], roots[j])
            np.minimum.at(roots, i, low)
            np.minimum.at(roots, j, low)
        roots = roots[roots]
        if (roots == before).all():
            return roots


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From posting lists (mask, part, fp), sorted, one edge to the root for each fingerprint that reaches a smaller one."""

    def of_list(mask: int, marks: np.ndarray) -> pa.RecordBatch | None:
        marks = np.unique(marks.view(np.uint64))
        roots = _roots(marks, int(mask) & ((1 << 64) - 1))
        i = np.flatnonzero(roots != np.arange(len(marks)))
        if len(i):
            return pa.RecordBatch.from_arrays([pa.array(marks[i].view(np.int64)), pa.array(marks[roots[i]].view(np.int64))], names=["a", "b"])

    held: tuple[int, int, list[np.ndarray]] | None = None
    for b in batches:
        if not len(b):
            continue
        mask, part, fp = (b.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(b)]
        if held and (held[0], held[1]) != (mask[0], part[0]):
            if (out := of_list(held[0], np.concatenate(held[2]))) is not None:
                yield out
            held = None
        more = held[2] if held else []
        for k in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(b))):
            s, e = starts[k], ends[k]
            own = [*(more if s == 0 else []), fp[s:e].copy()]
            if e == len(b):
                held = (mask[s], part[s], own)
            elif sum(map(len, own)) > 1 and (out := of_list(mask[s], np.concatenate(own))) is not None:
                yield out
    if held and (out := of_list(held[0], np.concatenate(held[2]))) is not None:
        yield out


def _linked(postings: DataFrame) -> DataFrame:
    dealt = postings.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
    return dealt.mapInArrow(_links, "a long, b long")


def _posted(marks: DataFrame, masks: Column) -> DataFrame:
    return marks.select("fp", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def near_links(marks: DataFrame) -> DataFrame:
    """Edges (a, b) that join every two fingerprints (fp, distinct) at MOST_BITS or fewer differing bits, or a chain of such.

    The inverted index lists fingerprints by the bytes at given positions. A list of a single position would hold a
    256th of all, and its pairs would grow with the square; the lists here are intersections of three, and any two
    fingerprints with the guaranteed 5 common bytes meet in one of 8. Within a list the common bytes of each pair are
    tallied, pairs with fewer than 5 are dropped, the others verified bit by bit; a list gives at most one edge for
    each fingerprint. A list longer than LONGEST_LIST is dealt out by each two of its other five positions, which
    again every such pair has in common; three bytes are then free, and a list that is still long is searched by
    flipping bits. Nothing is capped.
    """
    postings = _posted(marks, F.array(*[F.lit(mask_of(t)) for t in TRIPLES]))
    long = materialize(postings.groupBy("mask", "part").count().filter(F.col("count") > LONGEST_LIST).select("mask", "part"), "simhash-long")
    if long.isEmpty():
        return _linked(postings)
    finer = {mask_of(t): [mask_of(t + p) for p in combinations(sorted({*range(8)} - {*t}), 2)] for t in TRIPLES}
    masks = F.create_map(*[x for m, f in finer.items() for x in (F.lit(m), F.array(*map(F.lit, f)))])
    dealt = postings.join(long, ["mask", "part"], "left_semi").select("fp", F.explode(masks[F.col("mask")]).alias("mask"))
    dealt = dealt.distinct().withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    return _linked(postings.join(long, ["mask", "part"], "left_anti")).unionByName(_linked(dealt))


def near_duplicate_groups(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(rid, doc_id, fp, component_id): documents (doc_id, text) whose fingerprints link, directly or in a chain.

    Only distinct fingerprints enter the index, so any number of copies counts once. A text without words (null too)
    has fingerprint 0 and links like any other. component_id is the smallest doc_id of the component, null only where
    all of its doc_ids are. Repeated rows stay; an empty table gives no rows; extra columns are ignored.
    """
    table = fingerprint_table(docs, words_each)
    marks = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-marks")
    roots = connected_components(near_links(marks.select("fp")), "simhash-edges")
    placed = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialize(placed.select("fp", "root", "least"), "simhash-roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.join(placed.select("fp", "root").join(least, "root"), "fp").select("rid", "doc_id", "fp", "root", "component_id")


def keep_one_each(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id (nulls last), of equal ones the first.

    The rows that go are stored apart; Spark broadcasts them if their size allows, and joins by row number otherwise.
    """
    columns = docs.columns
    kept = with_row_ids(docs, "simhash-rows")
    groups = near_duplicate_groups(kept, words_each)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    best = groups.groupBy("root").agg(first.alias("best")).select(F.col("best.rid").alias("rid"))
    gone = materialize(groups.select("rid").join(best, "rid", "left_anti").select(F.col("rid").alias("_zw_rid")), "simhash-gone")
    return kept.join(gone, "_zw_rid", "left_anti").select(*columns)


def hex_mark(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
