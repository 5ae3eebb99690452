import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import TEXTS, awkward, empty, lower, words
from zonewright.llm import simhash
from zonewright.llm.queries import op10_simhash_near_dedup
from zonewright.llm.simhash import keep_one_each, near_duplicate_groups, near_links
from zonewright.operators.components import connected_components


def brute_mark(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def brute_groups(marks):
    """item -> smallest item that it reaches; marks: item -> fingerprint."""
    items, root = sorted(marks), {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([marks[i] for i in items], dtype=np.uint64)
    for k, i in enumerate(items):
        for j in np.flatnonzero(np.bitwise_count(values[k] ^ values) <= 3):
            a, b = find(i), find(items[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = {i: brute_mark(t) for i, t in texts.items()}
    rows = op10_simhash_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_groups(marks)


@pytest.mark.parametrize("longest", [4096, 20, 3])
def test_links_of_planted_marks(spark, monkeypatch, longest):
    """Chains and dense groups, with lists of any length: longer ones are dealt out, and searched by flipping bits."""
    rng = random.Random(11)
    marks = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(marks)[:6]:
        at = seed
        for _ in range(25):
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                at ^= 1 << bit
            marks.add(at)
        marks |= {seed ^ (1 << a) ^ (1 << b) for a in range(0, 24, 3) for b in range(24, 30)}
    monkeypatch.setattr(simhash, "LONGEST_LIST", longest)
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    edges = near_links(spark.createDataFrame([(m,) for m in signed], "fp long"))
    got = {m: m for m in signed} | {r.node: r.root for r in connected_components(edges).collect()}
    want = brute_groups({m: np.uint64(np.int64(m)) for m in signed})
    assert got == want


def test_flipping_bits_finds_what_all_pairs_do(monkeypatch):
    rng = random.Random(5)
    fixed = int(simhash.mask_of((0, 1, 2, 4, 5))) & (1 << 64) - 1
    base = rng.getrandbits(64) & fixed
    free = [b for b in range(64) if not fixed >> b & 1]
    marks = np.unique(np.array([base | sum(1 << b for b in rng.sample(free, rng.randrange(5))) for _ in range(300)], dtype=np.uint64))
    whole = simhash._roots(marks, fixed)
    monkeypatch.setattr(simhash, "LONGEST_LIST", 5)
    assert (simhash._roots(marks, fixed) == whole).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(60, 60), (61, 62), (62, 61), (63, 62)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 1 for i in range(2, 50)} | {62: 61, 63: 61}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    rows = near_duplicate_groups(awkward(spark)).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].component_id == 1 and by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    kept = keep_one_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({r.root for r in rows}) and 1 in ids and 2 not in ids and 3 in ids and 5 not in ids
    assert near_duplicate_groups(empty(spark)).count() == 0 and keep_one_each(empty(spark)).count() == 0
