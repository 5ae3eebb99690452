from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.helpers import PROSE, TEXTS, awkward, empty, lower
from zonewright.llm import license_scan
from zonewright.llm.license_scan import license_spans, license_table
from zonewright.llm.line_dedup import dedup_lines


def test_boilerplate_goes_and_the_rest_stays(spark):
    rows = [(i, f"  Home | About \nunique {i}\n\nShared by few {i // 20}\nHome | About", "h1") for i in range(100)]
    rows += [(1000 + i, f"Home | About\nother {i}", "h2" if i < 3 else "h3") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in dedup_lines(docs, ratio=0.25, least_pages=5).collect()}
    assert got[7].text == "unique 7\n\nShared by few 0" and (got[7].n_lines, got[7].n_dropped) == (5, 2)
    assert got[1001].text == "Home | About\nother 1"  # three pages are too few to tell
    assert got[1050].text == "other 50"
    assert {r.text for r in dedup_lines(docs, ratio=0.1).filter("doc_id = 7").collect()} == {"unique 7\n"}


def test_line_counts_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    white = " \t\n\x0b\x0c\r"
    distinct = {(r.source, r.text) for r in rows}
    pages, having = Counter(s for s, _ in distinct), defaultdict(Counter)
    for s, text in distinct:
        having[s].update({x.strip(white) for x in text.split("\n")} - {""})
    common = {s: {x for x, n in c.items() if n >= 5 and n > 0.05 * pages[s]} for s, c in having.items()}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(white) not in common[r.source]) for r in rows}
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == want


def test_lines_of_awkward_rows(spark):
    out = dedup_lines(awkward(spark), ratio=0.1, least_pages=3)
    assert sorted(out.columns) == sorted([*awkward(spark).columns, "n_dropped"])
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in TEXTS)
    assert [(r.text, r.n_lines, r.n_dropped) for r in rows if r.doc_id == 3] == [(None, 0, 0)]
    assert {r.text for r in rows if r.doc_id == 2} == {PROSE}  # copies of a text are one page
    assert dedup_lines(empty(spark)).count() == 0


def test_rules_are_many_and_in_order():
    rules = license_scan.rules()
    assert len(license_scan.signatures()) >= 200 and [r[0] for r in rules] == list(range(len(rules)))
    assert sum(len(some) for *_, some in license_scan.SIGNATURES) >= 100


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"),
        ("licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2"),
        ("the BSD 3-Clause License applies", "bsd-3-clause"),
        ("Distributed under the Boost Software License", "boost"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
        ("CC BY-NC-SA 4.0 and cc by nc", "cc-by-nc,cc-by-nc-sa"),
        ("All rights reserved. MIT license", "mit,proprietary"),
        ("we submit licenses to them", ""),
        ("a blic license mitigation", ""),
        ("Under the MIT License", "mit"),
        ("", ""),
    ],
)
def test_labels(spark, text, labels):
    row = license_table(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == labels and (row.score > 0) == bool(labels)


def test_inner_spans_of_lower_priority_are_suppressed(spark):
    docs = spark.createDataFrame([(1, "x licensed under the GNU General Public License version 3 only. GPL v2 license here; MIT license. Another MIT license")], "doc_id long, text string")
    spans = license_spans(docs).first().spans
    assert [(s.start, -s.minus_end, s.label) for s in spans] == [(1, 10, "gpl-3"), (11, 14, "gpl-2"), (15, 17, "mit"), (18, 20, "mit")]


def test_base_places(spark):
    text = "cc by nc cc by nc CC-BY-NC é under the MIT license apache license version 2 apache license version 2"
    row = license_table(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (22, 6, 0, 18, "apache-2,cc-by-nc,mit")


def test_licenses_of_awkward_rows(spark):
    import re

    rows = license_table(awkward(spark)).collect()
    n = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((i, n(t)) for i, t, _, _ in TEXTS)
    assert [(r.n_base, r.first_word, r.labels, r.score) for r in rows if r.doc_id == 3] == [(0, None, "", 0.0)]
    assert [r.labels for r in rows if r.doc_id == 8] == ["apache-2,cc-by-nc,mit"]
    assert license_table(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["op6_quality_rules", "op7_nearest_neighbours", "op8_line_dedup", "op9_license_scan"])
def test_sql_twins(spark, sf_dir, name):
    from zonewright.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))
