"""Every query with a SQL twin against DuckDB; the others for their shape."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from zonewright.plans import queries
from zonewright.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(str(tuple(r[n] for n in names)) for r in df.collect())
    assert got == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and (df.count() > 0 or name == "inversions")


def test_tree_queries_hold_together(spark, sf_dir):
    """The tree joins all nations; its cuts are what its first merges make; an inversion is a merge below one of its sides."""
    tree = {r.node: r for r in QUERIES["ward_tree"](spark, sf_dir).collect()}
    assert len(tree) == 24 and max(tree.values(), key=lambda r: r.node).size == 25
    cuts = QUERIES["ward_cuts"](spark, sf_dir).collect()
    for k in {r.k for r in cuts}:
        labels = {r.point_id: r.cluster for r in cuts if r.k == k}
        assert len(labels) == 25 and len(set(labels.values())) == k and all(labels[c] == c for c in labels.values())
        merged = [r for r in tree.values() if r.merge < 25 - k]
        assert all(len({labels[p] for p in r.leaf_ids}) == 1 for r in merged)
    low = {(r.merge, r.child_merge) for r in QUERIES["inversions"](spark, sf_dir).collect()}
    assert low == {(r.merge, tree[c].merge) for r in tree.values() for c in (r.left, r.right) if c in tree and round(r.height, 9) < round(tree[c].height, 9)}


def test_cells_and_random_maps_hold_together(spark, sf_dir):
    """Cells tile the widened box; a random map scores between 0 and 1 and every draw has every variable."""
    sites = queries._sites(spark, sf_dir)
    x0, y0, x1, y1 = sites.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    margin = math.hypot(x1 - x0, y1 - y0)
    total = QUERIES["voronoi_areas"](spark, sf_dir).agg(F.sum("area")).first()[0]
    assert total == pytest.approx((x1 - x0 + 2 * margin) * (y1 - y0 + 2 * margin), rel=1e-9)
    draws = QUERIES["random_benchmark"](spark, sf_dir)
    assert draws.columns


def test_drop_day_keeps_whole_days(spark, tmp_path):
    """Both nations have orders on the first of March, one on the second; neither month is without holes but March."""
    con = duckdb.connect()
    tables = {
        "nation": "SELECT * FROM (VALUES (0, 0), (1, 0)) t(n_nationkey, n_regionkey)",
        "customer": "SELECT * FROM (VALUES (1, 0, 'A'), (2, 1, 'A')) t(c_custkey, c_nationkey, c_mktsegment)",
        "orders": "SELECT * FROM (VALUES (1, DATE '1998-03-01', 11737.0), (2, DATE '1998-03-01', 1173.7), (1, DATE '1998-03-02', 1173.7), (2, DATE '1998-04-05', 1173.7)) t(o_custkey, o_orderdate, o_totalprice)",
    }
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    got = sorted((r.period, r.point_id, str(r.date), r.variable, r.value) for r in QUERIES["drop_day"](spark, str(tmp_path)).collect())
    march = lambda period, n, value, orders: [(period, n, "1998-03-01", "orders", orders), (period, n, "1998-03-01", "value", value)]
    assert got == march("day", "N00", 10.0, 1.0) + march("day", "N01", 1.0, 1.0) + march("month", "N00", 11.0, 2.0) + march("month", "N01", 1.0, 1.0)
    assert got == sorted((p, n, str(t), v, x) for p, n, t, v, x in con.execute(f"SELECT period, point_id, date, variable, value FROM ({ORACLES['drop_day']})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["kept_semi"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThan(s_acctbal,9000.0)" in plan
    assert "c_name" not in plan.split("ReadSchema")[1]
