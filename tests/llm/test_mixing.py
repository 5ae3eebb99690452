from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import TEXTS, awkward, empty, words
from zonewright.llm.mixing import fair_targets, mix_documents, mixed_rows


def test_targets_share_the_excess_until_none_is_above(spark):
    rows = [("a", 10, 1), ("b", 1000, 2), ("c", 100, 3), ("d", 500, 1)]
    sources = spark.createDataFrame(rows, "source_key string, source_size long, weight int")
    table, level = fair_targets(sources, 1610.0, 3)
    got = {r.source_key: r.target for r in table.collect()}
    caps, weights = {r[0]: 3 * r[1] for r in rows}, {r[0]: r[2] for r in rows}
    capped: set[str] = set()
    while True:  # plain water filling
        rest = 1610 - sum(caps[s] for s in capped)
        share = rest / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in caps if s not in capped and caps[s] <= share * weights[s]}
        if not over:
            break
        capped |= over
    assert all(abs(got[s] - (caps[s] if s in capped else share * weights[s])) < 1e-9 for s in caps)
    assert abs(sum(got.values()) - 1610) < 1e-6 and abs(level - share) < 1e-9


def test_mix_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix_documents(docs).collect()
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    size = {i: len(words(t)) for i, (t, _) in texts.items()}
    assert len(rows) == len(texts) and all(r["size"] == size[r.doc_id] for r in rows)
    of_source = Counter()
    for i, (_, s) in texts.items():
        of_source[s] += size[i]
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(of_source))}
    assert all(r.source_size == of_source[texts[r.doc_id][1]] and r.weight == weights[texts[r.doc_id][1]] for r in rows)
    total, largest = sum(size.values()), max(size.values())
    assert total - largest <= sum(r.taken for r in rows) <= total
    assert all(r.taken == r.copies * r["size"] and r.copies <= 3 for r in rows if r["size"])
    taken = Counter()
    for r in rows:
        taken[texts[r.doc_id][1]] += r.taken
    targets = {texts[r.doc_id][1]: r.target for r in rows}
    assert all(abs(taken[s] - targets[s]) <= 2 * largest for s in targets)
    assert sorted(tuple(r)[1:] for r in rows) == sorted(tuple(r)[1:] for r in mix_documents(docs.repartition(5)).collect())


def brute_copies(rows, budget):
    """doc_id -> copies of (doc_id, source_key, size, hash): every queue worked out in full, then one global sort."""
    of_source, queue = Counter(), []
    for _, s, n, _ in rows:
        of_source[s] += n
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(of_source))}
    for s in of_source:
        upto = 0
        for i, _, n, h in sorted((r for r in rows if r[1] == s), key=lambda r: r[3] % 2**64):
            upto += n
            queue += [((upto + e * of_source[s]) / weight[s], s, h, i, e, n) for e in range(3)]
    copies, total = Counter(), 0
    for _, _, _, i, _, n in sorted(queue):
        total += n
        if total > budget:
            break
        copies[i] += 1
    return copies


def test_copies_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", F.concat(F.lit("="), "source").alias("source_key"), "text").collect()
    table = spark.createDataFrame([(r.doc_id, r.source_key, len(words(r.text))) for r in sized], "doc_id long, source_key string, size long")
    rows = [tuple(r) for r in table.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "source_key", "size")).collect()]
    want = brute_copies(rows, sum(r[2] for r in rows))
    assert {r.doc_id: r.copies for r in mix_documents(docs).collect() if r.copies} == dict(want)


def test_the_cut_is_where_the_global_order_reaches_the_budget(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix_documents(docs).collect()
    taken = [r for r in got if r.copies]
    assert sum(r.taken for r in got) <= sum(r["size"] for r in got)
    light = [r for r in taken if r.weight == 1]  # the source that is not taken whole
    assert light and all(r.copies == 1 and r.first_finish <= r.target + 7 for r in light)
    assert max(r.first_finish for r in light) == sum(r.taken for r in light)  # a gapless start of its queue
    assert all(r.copies >= 1 for r in got if r.weight == 2)


def test_awkward_rows(spark):
    got = mix_documents(awkward(spark)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _, _ in TEXTS)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mix_documents(empty(spark)).count() == 0
    only_null = awkward(spark).filter("text is null")
    assert [(r["size"], r.target, r.taken) for r in mix_documents(only_null).collect()] == [(0, 0.0, 0)]


def test_mixed_rows_repeat_whole_rows(spark):
    docs = awkward(spark)
    copies = mix_documents(docs).filter(F.col("size") > 0).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == {r.doc_id: r.n for r in copies}
    assert mixed_rows(empty(spark)).count() == 0


def test_rows_that_are_alike_spread_and_give_the_same_totals(spark):
    """50,000 rows without ids, of one source and size, against the plain queue; and no slice holds many of them."""
    rows = [(None if i < 50_000 else i, "two words" if i < 50_000 else " ".join(["w"] * (1 + i % 5)), "a" if i < 50_000 or i % 3 else "b") for i in range(51_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mix_documents(docs).collect()
    sized = spark.createDataFrame([(i, f"={s}", len(t.split())) for i, t, s in rows], "doc_id long, source_key string, size long")
    hashed = [(n, r.source_key, r["size"], r.h) for n, r in enumerate(sized.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "source_key", "size")).collect())]
    want = brute_copies(hashed, sum(r[2] for r in hashed))
    taken = Counter()
    for n, copies in want.items():
        taken[rows[n][2]] += copies * hashed[n][2]
    heavy = Counter()
    for r in got:
        heavy[r.weight] += r.taken
    largest = 5
    assert abs(heavy[1] - taken["a"]) <= 4 * largest and abs(heavy[2] - taken["b"]) <= 4 * largest
    assert sum(1 for r in got if r.doc_id is None) == 50_000
    lots = Counter(r[0] for r in sized.filter("doc_id IS NULL").selectExpr("pmod(xxhash64(monotonically_increasing_id()), 50)").collect())
    assert len(lots) == 50 and max(lots.values()) < 2000
