"""What SimHash alone cannot promise: all pairs of a given Jaccard similarity.

Fingerprints within 3 bits of each other point out most near copies, not all: two texts of similarity 0.8 differ in 10 bits
of 64 on average, and no radius takes in every such pair and few others. So the links of the fingerprints' index are
verified by the shingles themselves, and a prefix-filtered join finds the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.common import forget, texts, with_row_ids
from zonewright.llm.simhash import SHINGLES_AT_ONCE, marked, near_links
from zonewright.operators.components import connected_components

SHINGLE_WORDS = 5
#: Least similarity, 4 of 5: of s shingles in two sets together (s = |a| + |b|), at least 4 s / 9 are common.
PARTS, OF = 4, 5
#: Longs in a text's parity bitmap: bits that differ are never more than the shingles that do, and hardly fewer in most texts.
MAP_LONGS = 32
#: Texts that tell which shingles are common, and how many of those are told; the result depends on neither.
SAMPLE_TEXTS, MOST_COMMON = 20_000, 1 << 18
TEXTS_AT_ONCE = 512
PAIRS_AT_ONCE = 200_000
PROFILE = "id long, size long, fp long, tokens array<long>, " + ", ".join(f"m{i} long" for i in range(MAP_LONGS))


def folded(text: bytes | None) -> list[bytes]:
    """Words of the lower-cased text; as for SimHash, A-Z and ASCII white space only."""
    return (text or b"").lower().split()


def shingles(words: list[bytes], words_each: int = SHINGLE_WORDS) -> set[bytes]:
    """The distinct shingles; a shorter text is one, and one without words has none."""
    if len(words) < words_each:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(words_each)))))


def alike(a: set[bytes], b: set[bytes]) -> bool:
    return OF * len(a & b) >= PARTS * len(a | b)


def _tokens(words: list[bytes], words_each: int) -> np.ndarray:
    """A 64-bit hash for each distinct shingle (equal hashes of two stay two)."""
    some = shingles(words, words_each)
    return np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(42)), dtype="<u8", count=len(some)).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        keys = [xxhash.xxh128_digest(b" ".join(folded(t))) for t in texts(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary())], names=["rid", "doc_id", "key"])


def _sampled(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for t in texts(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_tokens(folded(t), words_each)))], names=["token"])

    return run


def _profiles(words_each: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, counts = common.value
        for b in batches:
            for at in range(0, len(b), TEXTS_AT_ONCE):
                part = b.slice(at, TEXTS_AT_ONCE)
                sizes, marks, firsts, maps = [], [], [], np.zeros((len(part), MAP_LONGS * 64), dtype=np.uint8)
                for k, t in enumerate(texts(part.column(1))):
                    own = _tokens(folded(t), words_each)
                    rank = np.zeros(len(own), dtype=np.int64)
                    if len(known):
                        i = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        rank = np.where(known[i] == own, counts[i], 0)
                    n = len(own)
                    least = -(-PARTS * n // OF)
                    sizes.append(n)
                    marks.append(marked((own.view("<u8")[at : at + SHINGLES_AT_ONCE] for at in range(0, n, SHINGLES_AT_ONCE)), n))
                    firsts.append(own[np.lexsort((own, rank))][: n - least + 1] if n else own)
                    maps[k] = np.bincount((own.view(np.uint64) >> np.uint64(40)).astype(np.int64) % maps.shape[1], minlength=maps.shape[1]) & 1
                packed = np.packbits(maps, axis=1, bitorder="little").view("<i8")
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(f) for f in firsts])].astype(np.int32), pa.array(np.concatenate(firsts)))
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), lists, *(pa.array(packed[:, i].copy()) for i in range(MAP_LONGS))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "size", "fp", "tokens", *(f"m{i}" for i in range(MAP_LONGS))])

    return run


def _may_be_alike(left: Column, right: Column) -> Column:
    """If this shared token is the first in both sets' order, all that they share stands from here on."""
    return 9 * F.least(left["size"] - left["pos"], right["size"] - right["pos"]) >= 4 * (left["size"] + right["size"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each list (token, root, id, size, pos, bitmap), sorted, whose roots differ; roots stand in runs.

    Only pairs go out that may be alike by their sizes, by where the token stands and by their bitmaps.
    """

    def met(rows: np.ndarray) -> Iterator[np.ndarray]:
        root, ids, size, left, maps = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 2] - rows[:, 3], rows[:, 4:].view(np.uint64)
        ends = np.searchsorted(root, root, side="right")
        for i in np.flatnonzero(ends < len(rows)):
            j = np.arange(ends[i], len(rows))
            j = j[9 * np.minimum(left[i], left[j]) >= 4 * (size[i] + size[j])]
            j = j[9 * np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64) <= size[i] + size[j]]
            if len(j):
                yield np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1)

    def lists() -> Iterator[np.ndarray]:
        held, token = [], None
        for b in batches:
            if not len(b):
                continue
            own = b.column(0).to_numpy()
            rows = np.stack([b.column(k).to_numpy() for k in range(1, b.num_columns)], axis=1)
            starts = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)]
            for s, e in zip(starts[:-1], starts[1:]):
                if own[s] != token:
                    if held:
                        yield np.concatenate(held)
                    held, token = [], own[s]
                held.append(rows[s:e])
        if held:
            yield np.concatenate(held)

    def once(pairs: list[np.ndarray]) -> pa.RecordBatch:
        low, high = np.unique(np.concatenate(pairs), axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(low.copy()), pa.array(high.copy())], names=["a", "b"])

    forget()
    pairs, n = [], 0
    for rows in lists():
        for some in met(rows):
            pairs.append(some)
            n += len(some)
            if n > PAIRS_AT_ONCE:
                yield once(pairs)
                pairs, n = [], 0
    if n:
        yield once(pairs)


def _verified(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            near = np.fromiter((alike(shingles(folded(x), words_each), shingles(folded(y), words_each)) for x, y in zip(texts(b.column(2)), texts(b.column(3)))), dtype=bool, count=len(b))
            kept = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])
            yield kept.filter(pa.array(near))

    return run


def _edges(pairs: DataFrame, profiles: DataFrame, reps: DataFrame, words_each: int, label: str) -> DataFrame:
    """The pairs (a, b) that are alike, stored: bits that differ in the bitmaps leave out most, the words themselves decide."""
    side = lambda c: profiles.select(F.col("id").alias(c), F.struct("size", *(f"m{i}" for i in range(MAP_LONGS))).alias(f"of_{c}"))
    a, b = F.col("of_a"), F.col("of_b")
    differ = sum((F.bit_count(a[f"m{i}"].bitwiseXOR(b[f"m{i}"])) for i in range(MAP_LONGS)), F.lit(0))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    left = materialize(both.filter(9 * differ <= a["size"] + b["size"]).select("a", "b"), f"{label}-candidates")
    ids = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct()
    own = materialize(reps.join(ids, "id", "left_semi"), f"{label}-texts")
    of = lambda c: own.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    whole = left.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return materialize(whole.mapInArrow(_verified(words_each), "a long, b long"), f"{label}-edges")


def _common_tokens(reps: DataFrame, texts_there: int, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and how many texts."""
    share = max(1, -(-texts_there // SAMPLE_TEXTS))
    sample = reps.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    counts = sample.mapInArrow(_sampled(words_each), "token long").groupBy("token").count().filter("count > 2")
    rows = counts.orderBy(F.desc("count"), "token").limit(MOST_COMMON).toPandas().sort_values("token")
    return rows["token"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def alike_groups(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """(rid, doc_id, root): documents (_zw_rid, doc_id, text) that are alike, directly or in a chain, have the same root.

    Alike are texts whose sets of word shingles have a Jaccard similarity of 0.8 or more; texts equal but for case and
    white space always are, those without words too. The join is exact. Shingles stand in one order for all texts, the
    ones known to be common last; two alike texts of n and m shingles then share one among the first n - 0.8 n + 1 and
    m - 0.8 m + 1. First come the links of the texts' SimHash fingerprints, over the index of positional bytes, verified;
    then each text meets one other of each list of a shared shingle, so that a large group becomes one component from
    about as many pairs as it has texts; then all pairs of a list meet whose components still differ.
    """
    bare = docs.select(F.col("_zw_rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = materialize(bare.mapInArrow(_keys, "rid long, doc_id long, key binary"), "alike-keys")
    firsts = materialize(keyed.groupBy("key").agg(F.min("rid").alias("id"), F.count("*").alias("n")), "alike-firsts")
    again = keyed.join(firsts.filter("n > 1").select("key", "id"), "key", "left").select("rid", "doc_id", F.coalesce("id", "rid").alias("id"))
    again = materialize(again, "alike-rows")
    copies = materialize(again.filter("rid <> id").select("rid"), "alike-copies")
    reps = bare.join(copies, "rid", "left_anti").select(F.col("rid").alias("id"), "text")
    common = docs.sparkSession.sparkContext.broadcast(_common_tokens(reps, firsts.count(), words_each))
    profiles = materialize(reps.mapInArrow(_profiles(words_each, common), PROFILE), "alike-profiles")

    marks = materialize(profiles.filter("size > 0").groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "alike-marks")
    of_mark = lambda c: marks.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    linked = near_links(marks.select("fp")).join(of_mark("a"), "a").join(of_mark("b"), "b").select(F.col("first_a").alias("x"), F.col("first_b").alias("y"))
    same = profiles.join(marks.filter("n > 1"), "fp").filter("id <> first AND size > 0").select(F.col("id").alias("x"), F.col("first").alias("y"))
    linked = linked.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    by_mark = _edges(linked, profiles, reps, words_each, "alike-marked")

    own = profiles.select("id", "size", F.posexplode("tokens").alias("pos", "token"))
    here, place = Window.partitionBy("token"), F.struct(F.col("pos").cast("long").alias("pos"), "id", "size")
    lists = own.select("token", place.alias("own"), F.count("*").over(here).alias("n"), F.min(place).over(here).alias("pivot"))
    lists = materialize(lists.filter("n > 1").select("token", "own", "pivot"), "alike-lists")
    ends = [F.least("own.id", "pivot.id").alias("a"), F.greatest("own.id", "pivot.id").alias("b")]
    star = lists.filter((F.col("own.id") != F.col("pivot.id")) & _may_be_alike(F.col("own"), F.col("pivot"))).select(*ends)
    known = by_mark.withColumnRenamed("a", "x").withColumnRenamed("b", "y")
    star = star.distinct().join(known, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")
    edges = by_mark.unionByName(_edges(star, profiles, reps, words_each, "alike-star"))

    roots = connected_components(edges, "alike-first").withColumnRenamed("node", "id")
    rooted = lists.select("token", "own.*").join(roots, "id", "left").select("token", F.coalesce("root", "id").alias("root"), "id", "size", "pos")
    mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    mapped = rooted.join(mixed, "token", "left_semi").join(profiles.select("id", *(f"m{i}" for i in range(MAP_LONGS))), "id")
    mapped = mapped.select("token", "root", "id", "size", F.col("pos").cast("long").alias("pos"), *(f"m{i}" for i in range(MAP_LONGS)))
    dealt = mapped.repartition("token").sortWithinPartitions("token", "root", "id")
    more = _edges(dealt.mapInArrow(_across, "a long, b long"), profiles, reps, words_each, "alike-rest")

    roots = connected_components(edges.unionByName(more), "alike-all").withColumnRenamed("node", "id")
    return again.join(roots, "id", "left").select("rid", "doc_id", F.coalesce("root", "id").alias("root"))


def keep_one_alike(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each group of alike_groups: that of the smallest doc_id (nulls last), of equal ones the first."""
    columns = docs.columns
    kept = with_row_ids(docs, "alike-numbered")
    groups = materialize(alike_groups(kept, words_each), "alike-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    best = groups.groupBy("root").agg(first.alias("best")).select(F.col("best.rid").alias("rid"))
    gone = materialize(groups.join(best, "rid", "left_anti").select(F.col("rid").alias("_zw_rid")), "alike-gone")
    return kept.join(gone, "_zw_rid", "left_anti").select(*columns)
