from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import TEXTS, awkward, empty
from zonewright.llm.common import WORD_VOCABULARY, tokenizer_file
from zonewright.llm.packing import OpenWindows, WordIds, bundled, merged, pack_documents


@pytest.fixture(scope="module")
def path():
    return tokenizer_file(WORD_VOCABULARY)


def full_ids(path, texts):
    t = Tokenizer.from_file(path)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def unpack(rows, length):
    windows, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length
        windows[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.doc_tokens, ids))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= length
    return windows, docs


def test_every_id_once_and_little_padding(spark, sf_dir, path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(6)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, full_ids(path, texts.values())))
    windows, got = unpack(pack_documents(docs, path).collect(), 2048)
    for i, ids in want.items():
        pieces = sorted(got[i])
        assert [x for _, _, p in pieces for x in p] == ids
        assert all(of == len(ids) for _, of, _ in pieces)
    tokens = sum(map(len, want.values()))
    assert tokens / (2048 * len(windows)) > 0.95


def test_many_partitions_merge_in_rounds(spark, path):
    docs = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(900)], "doc_id long, text string").repartition(150)
    rows = pack_documents(docs, path, length=128, open_windows=2).collect()
    windows, got = unpack(rows, 128)
    assert len(got) == 900
    assert sum(r.length for r in rows) / (128 * len(windows)) > 0.85


def test_awkward_rows(spark, path):
    rows = pack_documents(awkward(spark), path).collect()
    unpack(rows, 2048)
    want = Counter()
    for (i, _, _, _), ids in zip(TEXTS, full_ids(path, [t for _, t, _, _ in TEXTS])):
        want[i] += len(ids)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    one = [r for r in rows if r.doc_id == 7]
    assert np.frombuffer(b"".join(r.ids for r in sorted(one, key=lambda r: r.start)), dtype="<u4").tolist() == full_ids(path, [TEXTS[10][1]])[0]
    assert pack_documents(empty(spark), path).count() == 0


def test_best_fit_and_fullest_first():
    w = OpenWindows(10, 2)
    assert list(w.place(["a"], 6)) == [] and list(w.place(["b"], 8)) == []
    assert list(w.place(["c"], 2)) == [(1, [(["b"], 0), (["c"], 8)])]  # best fit fills and closes
    assert list(w.place(["d"], 7)) == []
    assert list(w.place(["e"], 9)) == [(2, [(["d"], 0)])]  # none fits: the fullest goes


def test_special_strings_and_broken_bytes(path):
    ids = WordIds(path)
    as_list = lambda b: np.frombuffer(b, dtype="<u4").tolist()
    assert as_list(ids.of_text(b"x <|endoftext|> y")) == [343, 49407, 344]
    t = Tokenizer.from_file(path)
    for text in ("x<|endoftext|>y's", "<|STARTOFTEXT|> <|startoftext|><|endoftext|>", "<|endoftext|>́e don't 12ab"):
        assert as_list(ids.of_text(text.encode())) == t.encode(text, add_special_tokens=False).ids
    assert as_list(ids.of_text(b"ab \xff\xfe cd")) == t.encode("ab \ufffd\ufffd cd", add_special_tokens=False).ids
    ids.of_text(b"y" * 5000)
    assert all(len(w) <= 64 for w in ids)


def best_fit(sizes, length, most):
    """The plain statement: lists of sizes, looked through one by one. Returns the windows in order of closing, then the open."""
    windows, closed = [], []
    for size in sizes:
        fits = [w for w in windows if sum(w) + size <= length]
        if fits:
            best = min(fits, key=lambda w: length - sum(w))
        else:
            if len(windows) == most:
                fullest = max(windows, key=sum)
                windows.remove(fullest)
                closed.append(fullest)
            best = []
            windows.append(best)
        best.append(size)
        if sum(best) == length:
            windows.remove(best)
            closed.append(best)
    return closed, windows


def test_placement_is_best_fit_by_brute_force():
    rng = np.random.default_rng(3)
    for most in (1, 3, 8):
        sizes = [int(x) for x in rng.integers(1, 41, 400)]
        w, closed = OpenWindows(40, most), []
        for size in sizes:
            closed += [[p[0] for p, _ in window] for _, window in w.place([size], size)]
        want, still = best_fit(sizes, 40, most)
        assert sorted(map(sum, closed)) == sorted(map(sum, want))
        assert sorted(sum(p[0] for p, _ in v) for v in w.held.values()) == sorted(map(sum, still))


def test_merging_by_brute_force():
    rng = np.random.default_rng(4)
    bundles = [(int(x), i, 0) for i, x in enumerate(rng.integers(1, 64, 300))]
    placed = merged(bundles, 64, 2)
    want, still = best_fit(sorted((b[0] for b in bundles), reverse=True), 64, 300)
    held = defaultdict(list)
    for (tokens, _, _), (n, offset, _) in zip(bundles, placed):
        held[n].append((offset, tokens))
    assert sorted(sum(t for _, t in v) for v in held.values()) == sorted(map(sum, [*want, *still]))
    for v in held.values():
        ends = [0, *np.cumsum([t for _, t in sorted(v)])]
        assert [o for o, _ in sorted(v)] == ends[:-1]
    assert len({n for n, _, closed in placed if not closed}) == min(2, len(still))
    assert bundled([1] * 130 + [2000], 2048)[-1] == 3 and max(bundled([1] * 2048, 2048)) == 31
