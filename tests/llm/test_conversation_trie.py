import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from zonewright.llm.conversation_trie import conversation_trie, nearest_smaller, range_minimum, running_sums
from zonewright.llm.queries import op13_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, i long, v long, chunk int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Node by node over a plain dict of prefixes. rows: (conv_id, turn, role, text), ties in turn with the same role and text."""
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [x[2:] for x in sorted(t)] for c, t in held.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        # Spark's and SQL's remainder has the sign of c
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt = tuple(held.get(base, [])[:h] + own[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = mine + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    up = lambda node: min(members[node[:-1]]) if node else None
    return sorted((min(m), len(n), up(n) if n else -1, len(m), len(children[n]), leaves[n], saved[n], sha(n)) for n, m in members.items())


def found(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


def test_query_against_a_dict_of_prefixes(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_conversation_trie(spark, sf_dir)
    assert got.columns == COLUMNS and found(got) == brute(rows)


@pytest.mark.parametrize("chunk, block", [(2, 3), (1, 2), (1024, 4096)])
def test_random_conversations(spark, chunk, block):
    rng = random.Random(chunk)
    rows = []
    for c in [*range(0, 12), *range(100, 130), 200, 205, 314, -3, -100, -150]:
        n = rng.choice([1, 1, 2, 3, 5, 6, 7, 9])
        rows += [(c, t, rng.choice("ua"), rng.choice(["x", "yy", ""])) for t in range(n)]
    rows += [(c, t, "u", "same") for c in range(140, 199) for t in range(7)]
    assert found(conversation_trie(table(spark, rows), chunk=chunk, block=block)) == brute(rows)


def test_awkward_rows(spark):
    long = "é😀" * 20_000
    rows = [(1, None, None, None), (1, None, None, None), (1, 3, "a", None), (1, 2, None, long), (2, 0, "a", "x"), (2, 0, "a", "x"), (None, 1, "a", "x"), (100, 1, "", ""), (101, 5, "a", "b"), (102, 1, "a", "\x00")]
    assert found(conversation_trie(table(spark, rows))) == brute(rows)
    assert found(conversation_trie(table(spark, rows[:1]))) == brute(rows[:1])
    assert conversation_trie(table(spark, [])).count() == 0 and conversation_trie(table(spark, [])).columns == COLUMNS
    alone = [(105, 0, "u", "one turn, that its family's absent head takes away")]
    assert zlib.crc32(b"105") % 6 > 0 and found(conversation_trie(table(spark, alone))) == brute(alone)


def test_nearest_smaller_values_over_levels_of_blocks(spark):
    rng = random.Random(8)
    v = [rng.choice([0, 0, 0, 1, 2, 3, 9]) + (5 if i % 11 else 0) for i in range(90)]
    df = spark.createDataFrame(list(enumerate(v)), "i long, v long").repartition(4)
    got = {r.i: (r.v, r.before, r.after) for r in nearest_smaller(df, 90, 3).collect()}
    for i, x in enumerate(v):
        before = max((j for j in range(i) if v[j] < x), default=None)
        assert got[i] == (x, before, min((j for j in range(i + 1, 90) if v[j] < x), default=None))
    asked = spark.createDataFrame([(a, b) for a in range(0, 90, 4) for b in range(a + 1, 91, 7)], "l long, r long")
    assert all(r.least == min(v[r.l : r.r]) for r in range_minimum(df, asked, 90, 3).collect())
    assert {r.i: r.v_before for r in running_sums(df, ["v"], 7).collect()} == {i: sum(v[:i]) for i in range(90)}
