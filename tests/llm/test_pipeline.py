"""The pipeline's stages against plain Python, each on its own input."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, empty, words
from tests.llm.test_jaccard import brute_kept
from tests.llm.test_mixing import brute_copies
from tests.llm.test_packing import full_ids, unpack
from zonewright.llm.common import WORD_VOCABULARY, tokenizer_file
from zonewright.llm.oracles import line_dedup_sql, quality_rules_sql


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules, lines, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    good = rules(spark, docs, sf_dir)
    assert good.columns == docs.columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules_sql()}) WHERE kept").fetchall()}
    assert {r.doc_id for r in good.collect()} == kept
    cut = lines(spark, good, sf_dir)
    assert cut.columns == docs.columns
    con.register("good", good.toArrow())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM good")
    assert {r.doc_id: r.text for r in cut.collect()} == dict(con.execute(f"SELECT doc_id, text FROM ({line_dedup_sql()})").fetchall())
    one = near(spark, cut, sf_dir)
    assert sorted(r.doc_id for r in one.collect()) == brute_kept({r.doc_id: r.text for r in cut.collect()})
    mixed = mix(spark, one, sf_dir)
    queue = one.select("doc_id", F.concat(F.lit("="), "source").alias("source_key"), "text").collect()
    sized = spark.createDataFrame([(r.doc_id, r.source_key, len(words(r.text))) for r in queue], "doc_id long, source_key string, size long")
    hashed = [tuple(r) for r in sized.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "source_key", "size")).collect()]
    copies = brute_copies(hashed, sum(r[2] for r in hashed))
    size = {r[0]: r[2] for r in hashed}
    want = {i: n for i, n in copies.items() if size[i]}
    assert Counter(r.doc_id for r in mixed.collect()) == want
    texts = {r.doc_id: r.text for r in one.collect()}
    ids = dict(zip(want, full_ids(tokenizer_file(WORD_VOCABULARY), [texts[i] for i in want])))
    windows, got = unpack(pack(spark, mixed, sf_dir).collect(), 2048)
    for i, n in want.items():
        starts = Counter(at for at, _, _ in got[i])
        assert set(starts.values()) == {n}
        pieces = {at: piece for at, _, piece in got[i]}
        assert [x for at in sorted(pieces) for x in pieces[at]] == ids[i]
    assert got.keys() == want.keys()


def test_run_over_awkward_and_empty_tables(spark, tmp_path):
    for name, table in (("awkward", awkward(spark)), ("empty", empty(spark))):
        path = f"{tmp_path}/{name}"
        table.select("doc_id", "text", "lang", "source").write.parquet(f"{path}/documents.parquet")
        rows = corpus_pipeline.run(spark, path).collect()
        assert bool(rows) == (name == "awkward")
