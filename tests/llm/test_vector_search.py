import numpy as np
import pyarrow as pa
import pytest

from zonewright.llm.vector_search import hilbert_keys, nearest_neighbours

ASKED = "vec_id % 10 = 0"


def brute(rows, k=10):
    """query -> [(vec_id, distance)] over all other rows."""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, i in enumerate(ids):
        if i % 10 == 0:
            d = np.sqrt(np.add.accumulate((x - x[q]) ** 2, axis=1)[:, -1])
            out[i] = sorted((float(d[j]), ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
    return out


def got_of(df):
    out: dict[int, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in np.float32(v)]) for i, v in rows], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["sphere", "clusters", "copies"])
def test_exact_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    if kind == "clusters":
        x = rng.standard_normal((12, 16))[rng.integers(12, size=600)] * 5 + 0.1 * x
    if kind == "copies":
        x[100:400] = x[100]
    rows = [(i, np.float32(v)) for i, v in enumerate(x)]
    got = got_of(nearest_neighbours(table(spark, rows), ASKED, block_rows=64))
    assert got == brute(rows)


def test_windows_alone_on_clustered_vectors(spark):
    """Recall of the Hilbert windows without the completion, against brute force."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 16))[rng.integers(40, size=2000)] * 3 + 0.3 * rng.standard_normal((2000, 16))
    rows = [(i, np.float32(v)) for i, v in enumerate(x)]
    got, want = got_of(nearest_neighbours(table(spark, rows), ASKED, block_rows=128, complete=False)), brute(rows)
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("n", [40, 130, 250])
def test_windows_that_cover_the_table_are_exact(spark, n):
    """One block a curve, and two: no block holds rows of two curves, so none has a row twice."""
    rows = [(i, np.float32(v)) for i, v in enumerate(np.random.default_rng(n).standard_normal((n, 16)))]
    assert got_of(nearest_neighbours(table(spark, rows), ASKED, block_rows=128, complete=False)) == brute(rows)


def test_recall_of_the_curves_on_many_vectors(spark):
    """50,000 evenly spread vectors of 16 dimensions: windows alone, as wide as they are measured to need."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((50_000, 16)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 16).cast(pa.list_(pa.float32()))}))
    got = got_of(nearest_neighbours(df, "vec_id % 500 = 0", block_rows=256, complete=False))
    hits = []
    for i in range(0, len(x), 500):
        d = ((x.astype(np.float64) - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits.append(len({j for _, j in got[i]} & set(np.argsort(d)[:10].tolist())) / 10)
    assert len(hits) == 100 and np.mean(hits) >= 0.9


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 0.0]), (20, None), (30, []), (40, [0.0, 0.0]), (50, [nan, 1.0]), (60, [inf, 1.0]), (70, [None, 1.0]), (None, [1.0, 1.0]), (80, [1.0, 0.0]), (80, [5.0, 0.0]), (3, [2.0, 0.0]), (90, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<float>, query string, rep int, score double")
    df = df.unionByName(df.sparkSession.createDataFrame([(100, [1.0, 2.0, 4.0], "x", 1, 2.0)], df.schema))
    got = got_of(nearest_neighbours(df, ASKED))
    assert got.pop(90) == [(1.0, 100)] and got.pop(100) == [(1.0, 90)]  # with those of their own length
    assert got == {10: [(0.0, 80), (1.0, 3)], 80: [(0.0, 10), (1.0, 3)]}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_neighbours(none, ASKED).count() == 0
    assert nearest_neighbours(table(spark, [(10, [1.0, 2.0])]), ASKED).count() == 0
    assert nearest_neighbours(table(spark, [(11, [1.0, 2.0]), (12, [1.0, 1.0])]), ASKED).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
