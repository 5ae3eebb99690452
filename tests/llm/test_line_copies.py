from pyspark.sql import functions as F

import corpus_pipeline
from zonewright.llm.line_dedup import dedup_lines, is_among, slotted


def test_a_text_of_many_copies_survives(spark, sf_dir):
    """A third of the rows are copies of one text; menu lines, which many texts have, still go."""
    text = "the first line of a copied text\nits second line"
    rows = [(i, f"menu\nline {i}\nmore {i}", "en", "h") for i in range(60)] + [(100 + i, text, "en", "h") for i in range(30)]
    docs = spark.createDataFrame([*rows, (200, None, "en", "h")], "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf_dir).collect()}
    assert len(got) == 91 and got[200] is None
    assert all(got[100 + i] == text for i in range(30)) and got[7] == "line 7\nmore 7"
    near = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, docs, sf_dir), sf_dir)
    assert [r.text for r in near.filter("doc_id BETWEEN 100 AND 199").collect()] == [text]


def test_copies_count_once_for_both_sides(spark):
    """8 texts, 2 of them with the line: a quarter, whatever the copies; repeated doc_ids and rows do no harm."""
    rows = [(1, "x\na", "h")] * 9 + [(2, "x\nb", "h")] + [(10 + i, f"other {i}", "h") for i in range(6)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    left = lambda ratio: {r.text for r in dedup_lines(docs, ratio, 2).filter("doc_id < 3").collect()}
    assert left(0.24) == {"a", "b"} and left(0.25) == {"x\na", "x\nb"}


def test_slots_hold_their_marks_and_no_others(spark):
    """Negative marks, one mark, thousands, and marks of another host."""
    marks = {"a": [-(2**63), 2**63 - 1, 0], "b": [-7], "c": [(i * 2654435761) ** 2 % 2**62 - 2**61 for i in range(5000)]}
    common = spark.createDataFrame([(h, m) for h, some in marks.items() for m in some], "host string, mark long")
    slots = slotted(common)
    sizes = {r.host: (r.n, r.most) for r in slots.select("host", F.size("slots").alias("n"), F.array_max(F.transform("slots", F.size)).alias("most")).collect()}
    assert {h: n for h, (n, _) in sizes.items()} == {h: len(some) for h, some in marks.items()} and sizes["c"][1] < 12
    asked = [(h, m, m in marks.get(h, [])) for h in ("a", "b", "c", "d") for m in [None, 1, -7, 0, *marks["a"], *marks["c"][:50]]]
    probe = spark.createDataFrame(asked, "host string, mark long, want boolean").join(slots, "host", "left")
    assert probe.filter(is_among(F.col("mark"), F.col("slots")) != F.col("want")).count() == 0 and probe.filter("want").count() > 50
