import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from zonewright.llm import whitening
from zonewright.llm.queries import op11_whiten_embeddings
from zonewright.llm.whitening import fit, primes, reconstructed, steps_of, whiten


def brute(rows, most=4):
    """Row by row in fractions and doubles: {(vec_id, component): (n, deviation, |whitened|, explained)}, one length."""
    steps = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({x for _, x in steps})
    n, d = len(listed), len(listed[0])
    s = [sum(x[j] for x in listed) for j in range(d)]
    centred = [[Fraction(n * x[j] - s[j], n) for j in range(d)] for x in listed]
    v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = defaultdict(list)
    for i, x in steps:
        off = np.array([float(Fraction(n * x[j] - s[j], n)) for j in range(d)])
        for k in range(min(most, d)):
            out[i, k + 1].append((n, sum((n * x[j] - s[j]) ** 2 for j in range(d)), abs(off @ u[:, k]) / math.sqrt(e[k]), e[k] / np.trace(v)))
    return out, v


def close(got, want):
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
    assert set(by) == set(want) and all(len(by[k]) == len(want[k]) for k in by)
    for k, rs in by.items():
        for r, (n, deviation, whitened, explained) in zip(rs, want[k]):
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.whitened) == pytest.approx(whitened, abs=1e-6) and r.explained == pytest.approx(explained, rel=1e-9)
            assert r.identity_error < 1e-9


def test_residues_give_exact_numbers():
    moduli = primes(1 << 90)
    assert len(set(moduli)) == len(moduli) and math.prod(moduli) > 1 << 90 and all(all(p % q for q in range(2, 1500)) for p in moduli)
    rng = random.Random(1)
    for x in (0, 1, -1, (1 << 89) - 5, -(1 << 89) + 5, *(rng.randrange(-(1 << 80), 1 << 80) for _ in range(50))):
        assert reconstructed([x % p for p in moduli], moduli) == x
    assert whitening.ROWS * (whitening.BELOW // 2) ** 2 <= 1 << 53


def test_table_against_fractions(spark, sf_dir):
    rows = [(r.vec_id, r.embedding[:12]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(120).collect()]
    rows += [(9000 + i, v) for i, v in rows[:40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    want, v = brute(rows)
    got = whiten(df).collect()
    close(got, want)
    f = fit(steps_of(df, "vec_id", "embedding").select("x").distinct(), 12)
    assert np.abs(f.vectors.T @ v @ f.vectors - np.diag(f.values)).max() < 1e-10 * f.values[0]
    sign = {}  # one sign for all rows: distances between rows are kept
    for r in got:
        sign.setdefault(r.component, {})[r.vec_id] = r.whitened
    assert all(abs(np.mean([sign[k][i] for i in {r.vec_id for r in got if r.vec_id < 9000}])) < 1e-9 for k in sign)


def test_whole_query(spark, sf_dir):
    got = op11_whiten_embeddings(spark, sf_dir).collect()
    x = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert len(got) == 4 * len(x) and got[0].identity_error < 1e-9
    whole = np.array([[math.floor(256 * c) for c in x[i]] for i in sorted(x)], dtype=object)
    unique = np.array(sorted(set(map(tuple, whole))), dtype=object)
    off = len(unique) * whole - unique.sum(axis=0)
    assert {r.vec_id: r.deviation for r in got} == dict(zip(sorted(x), (off * off).sum(axis=1)))


def test_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**45 for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    listed = steps_of(df, "vec_id", "embedding").select("x").distinct()
    f = fit(listed, 3)
    x = [r.x for r in listed.collect()]
    assert f.sums == [sum(v[j] for v in x) for j in range(3)] and f.largest == max(abs(c) for v in x for c in v)
    want, _ = brute(rows)
    for r in whiten(df).collect():
        n, deviation, whitened, explained = want[r.vec_id, r.component][0]
        assert r.deviation is None and deviation >= 1 << 63
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-9) and r.explained == pytest.approx(explained)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(2)
    good = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(30)]
    bad = [(100, None), (101, [nan] * 5), (102, [inf, 0.0, 0.0, 0.0, 0.0]), (103, [None, 1.0, 1.0, 1.0, 1.0]), (104, [])]
    copies = [(None, good[0][1]), (0, good[0][1]), (0, good[0][1]), (105, [0.0] * 5)]
    other = [(200, [1.0, 2.0]), (201, [1.0, 2.0]), (202, [3.0, 5.0])]
    rows = [(i, v, 7, "x", 1.0, 2) for i, v in good + bad + copies + other]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, x string, whitened double, component int").repartition(3)
    got = whiten(df).collect()
    want, _ = brute(good + copies)
    close([r for r in got if r.vec_id is None or r.vec_id < 200], want)
    two = {(r.vec_id, r.component): r for r in got if r.vec_id is not None and r.vec_id >= 200}
    assert set(two) == {(i, k) for i in (200, 201, 202) for k in (1, 2)} and all(r.n == 2 for r in two.values())
    assert abs(two[200, 1].whitened) == pytest.approx(1) and two[200, 2].whitened is None and two[202, 1].identity_error < 1e-12
    alone = whiten(spark.createDataFrame([(1, [1.0, -0.5])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whiten(none).count() == 0 and whiten(none).columns == whiten(df).columns
    huge = whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")).collect()
    assert sorted(round(r.whitened) for r in huge) == [-1, 1]


def test_partitions_do_not_matter(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(300)
    a, b = (sorted((r.vec_id, r.component, r.deviation, r.whitened) for r in whiten(df.repartition(n)).collect()) for n in (1, 9))
    assert a == b


def test_a_row_has_the_same_digits_in_any_batch():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (200, 64))
    f = whitening.Fit(200, [int(v) for v in x.sum(axis=0)], 300, 1.0, np.ones(64), np.linalg.qr(rng.normal(size=(64, 64)))[0])
    rows = pa.record_batch([pa.array(range(200), pa.int64()), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["vec_id", "x"])
    together = [r for b in whitening._whitened(f, 4)([rows]) for r in b.to_pylist()]
    alone = [r for b in whitening._whitened(f, 4)(rows.slice(i, 1 + i % 7) for i in range(200)) for r in b.to_pylist()[:1]]
    assert together == alone
