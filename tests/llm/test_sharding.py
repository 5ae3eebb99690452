import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import TEXTS, awkward, empty
from zonewright.llm.queries import op3_shard_documents
from zonewright.llm.sharding import external_shuffle, write_shards


def laws(rows, n):
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(n)) and (len(rows) < n or max(counts.values()) - min(counts[i] for i in range(n)) <= 1)
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_round_trip_with_small_buckets(spark):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = external_shuffle(docs, 16, bucket_bytes=10_000).collect()
    laws(out, 16)
    assert sorted((r.doc_id, r.text) for r in out) == sorted(rows)
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)
    again = external_shuffle(docs.repartition(7), 16, bucket_bytes=10_000).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_a_hot_row_is_split(spark):
    docs = spark.createDataFrame([(1, "same")] * 3000 + [(i, f"t{i}") for i in range(2, 1000)], "doc_id long, text string")
    out = external_shuffle(docs, 4, bucket_bytes=5_000)
    rows = out.collect()
    laws(rows, 4)
    assert sum(r.doc_id == 1 for r in rows) == 3000 and len(rows) == 3998


def test_awkward_rows_are_written_and_read_again(spark):
    docs = awkward(spark)
    rows = write_shards(external_shuffle(docs, 4)).collect()
    laws(rows, 4)
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(t)) for i, t, _, _ in TEXTS)
    assert external_shuffle(empty(spark), 4).count() == 0
    assert external_shuffle(docs.limit(1), 4).count() == 1


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_shard_documents(spark, sf_dir).collect()
    laws(rows, 16)
    assert len(rows) == len(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def brute_shards(spark, rows, n, bucket_bytes, seed=11):
    """(doc_id, shard, slot) in plain Python: scatter by hash, Fisher and Yates bucket by bucket, cut into n runs."""
    hashed = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text")).collect()
    n_buckets = max(1, math.ceil(sum(len(r.text.encode()) + 64 for r in hashed) / bucket_bytes))
    buckets = defaultdict(list)
    for r in hashed:
        buckets[(r.h % (1 << 22)) % n_buckets].append((r.h, r.doc_id))
    order = []
    for b in sorted(buckets):
        own = sorted(buckets[b])
        rng = np.random.Generator(np.random.PCG64([seed, b]))
        order += [own[i][1] for i in rng.permutation(len(own))]
    shards = [i * n // len(order) for i in range(len(order))]
    return sorted((doc, s, i - shards.index(s)) for i, (doc, s) in enumerate(zip(order, shards)))


def test_the_order_by_brute_force(spark):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = external_shuffle(docs, 16, bucket_bytes=30_000)
    assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == brute_shards(spark, rows, 16, 30_000)
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange rangepartitioning") == 1
