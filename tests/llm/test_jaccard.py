import random

import pytest

from tests.llm.helpers import TEXTS, awkward, empty, lower, words
from zonewright.llm import jaccard
from zonewright.llm.jaccard import keep_one_alike


def brute_kept(texts):
    """doc_ids that stay, by the Jaccard similarity of all pairs; texts: doc_id -> text."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in texts})


def planted(rng):
    """Near copies round 0.8, in groups and chains, with a passage that many texts have."""
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, out = prose(40), []
    for n in (3, 30, 80, 150, 400):
        base = prose(n)
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(1 + n // 20)):
                own[rng.randrange(n)] = f"x{rng.randrange(10**9)}"
            out.append(own)
    out += [passage + prose(rng.choice([5, 60])) for _ in range(30)]
    chain = prose(120)
    for _ in range(12):
        chain = [*chain[4:], *prose(4)]
        out.append(chain)
    rng.shuffle(out)
    return {i: (" " if i % 2 else "\n").join(w).title() if i % 3 else " ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize("most_common", [1 << 18, 0])
def test_kept_against_all_pairs(spark, monkeypatch, most_common):
    monkeypatch.setattr(jaccard, "MOST_COMMON", most_common)
    texts = planted(random.Random(3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute_kept(texts)
    assert 40 < len(want) < len(texts) - 40
    assert sorted(r.doc_id for r in keep_one_alike(docs).collect()) == want


def test_stage_keeps_what_all_pairs_say(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    copy = " ".join(f"w{i}" for i in range(100))
    texts |= {10**9: copy, 10**9 + 1: copy.replace("w50 ", "other "), 10**9 + 2: copy.replace("w20 ", "a ").replace("w50 ", "b ").replace("w80 ", "c ")}
    more = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, more, sf_dir).collect())
    assert kept == brute_kept(texts) and 10**9 in kept and 10**9 + 1 not in kept and 10**9 + 2 in kept


def test_awkward_rows(spark):
    kept = keep_one_alike(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids
    assert len(ids) < len(TEXTS) and keep_one_alike(empty(spark)).count() == 0
