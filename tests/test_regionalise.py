"""The planted country end to end, against values worked out independently."""

import pytest
from pyspark.sql import functions as F

from zonewright.plans import regionalise
from zonewright.plans.regionalise import DisconnectedError, MissingDataError, NestingError, Settings, check_nesting, run
from zonewright.sources import planted

SETTINGS = Settings(build_start="2023-09-01", manual_links=(("P18", "P12"),), missing_data="drop_day", cuts_to_save=(2, 3), random_partitions=60)
VARIABLES = ("tmin", "tmax", "rain", "wind")
GOLDEN = {
    ("eta", "current"): (0.000974, 0.001568, 0.006632, 0.001180),
    ("eta", "new"): (0.974623, 0.972838, 0.965318, 0.977024),
    ("ceiling", None): (0.991561, 0.992797, 0.980206, 0.987881),
    ("variance_explained", None): (0.874210, 0.870873, 0.851496, 0.881924),
}


@pytest.fixture(scope="module")
def out(spark):
    points = planted.points(spark).select("point_id", "x", "y")
    return run(spark, points, planted.layers(spark), planted.weather(spark), planted.demand(spark), SETTINGS)


@pytest.mark.parametrize("key", GOLDEN, ids=str)
def test_scores(out, key):
    table, name = key
    rows = {r.variable: r.eta_squared for r in out[table].filter(F.lit(True) if name is None else F.col("map") == name).collect()}
    assert all(abs(rows[v] - g) < 1e-4 for v, g in zip(VARIABLES, GOLDEN[key]))
    if table == "eta":
        assert abs(rows["demand"] - {"current": 0.039083, "new": 0.897957}[name]) < 1e-4


def test_correlations_and_misfits(out):
    c = {r.map: r for r in out["correlations"].collect()}
    assert abs(c["current"].within + 0.999146) < 1e-4 and abs(c["current"].between - 0.000183) < 1e-4
    assert abs(c["new"].within - 0.997388) < 1e-4 and abs(c["new"].between + 0.998084) < 1e-4
    wrong = {r.map: r.n for r in out["misfits"].groupBy("map").agg(F.count_if("misfit").alias("n")).collect()}
    assert wrong == {"current": 8, "new": 0}


def test_graph(out):
    edges = out["edges"].collect()
    assert sum(e.source == "computed" for e in edges) == 24 and sum(e.source == "manual" for e in edges) == 1
    assert all(abs(e.shared_edge_metres - 25_000) < 1 for e in edges if e.source == "computed")
    assert {r.point_id for r in out["cells"].collect()} == {f"P{i:02d}" for i in range(1, 19)} - {"P17"}


def test_clusters(out):
    west = {f"P{i:02d}" for i in (1, 2, 5, 6, 9, 10, 13, 14)}
    labels = out["labels"].collect()
    assert {r.point_id for r in labels if r.k == 2 and r.cluster == "P01"} == west
    assert {r.point_id for r in labels if r.k == 3 and r.cluster == "P04"} == {"P04", "P08", "P12", "P16", "P18"}
    heights = sorted((r.height for r in out["tree"].collect()), reverse=True)
    assert abs(heights[0] - 215.664285) < 1e-3 and abs(heights[1] - 30.381251) < 1e-3
    assert out["inversions"].count() == 0


def test_assignments_and_benchmark(out):
    rows = {r.unit_id: (r.group_id, r.straddle_score) for r in out["assignments"].collect()}
    assert rows == {"PGA-NW": ("NCA-P01", 0.0), "PGA-SW": ("NCA-P01", 0.0), "PGA-NE": ("NCA-P03", 0.0), "PGA-SE": ("NCA-P03", 0.0)}
    assert out["moves"].count() == 0
    best = {r.variable: r.best for r in out["benchmark"].groupBy("variable").agg(F.max("eta_squared").alias("best")).collect()}
    new = {r.variable: r.eta_squared for r in out["eta"].filter("map = 'new'").collect()}
    assert all(best[v] <= new[v] + 1e-9 for v in new)


def test_anomalies_are_centred_and_scaled(out):
    a = out["anomalies"]
    day = a.groupBy("date", "variable").agg(F.avg("regional_anomaly").alias("m")).agg(F.max(F.abs("m"))).first()[0]
    assert day < 1e-9
    for r in a.filter("window = 'build'").groupBy("point_id", "variable").agg(F.avg("z_score").alias("m"), F.stddev_pop("z_score").alias("s")).collect():
        assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9
    days = {r.window: r.n for r in a.groupBy("window").agg(F.countDistinct("date").alias("n")).collect()}
    assert days == {"build": 365, "held_out": 365}


def test_held_out_days_cannot_reach_the_clusters(spark, out):
    """Scrambled held-out weather leaves normals, parameters and the tree as they are."""
    held = F.col("date") > F.lit(SETTINGS.build_end)
    scrambled = planted.weather(spark).withColumn("value", F.when(held, F.col("value") + 7 + F.crc32("point_id") % 5).otherwise(F.col("value")))
    again = regionalise.build_scores(scrambled, out["cells"], out["edges"], SETTINGS)
    key = ["point_id", "variable", "parameter", "day_of_year"]
    both = out["parameters"].join(again["parameters"].withColumnRenamed("value", "other"), key)
    assert both.filter(F.abs(F.col("value") - F.col("other")) > 1e-9).count() == 0 and both.count() == out["parameters"].count()
    tree = regionalise.cluster(again["anomalies"], out["edges"], SETTINGS)["tree"]
    strip = lambda t: sorted((r.left, r.right, round(r.height, 6)) for r in t.collect())
    assert strip(tree) == strip(out["tree"])


def test_stops(spark):
    points = planted.points(spark).select("point_id", "x", "y")
    layers = planted.layers(spark)
    with pytest.raises(DisconnectedError):
        regionalise.build_graph(points, layers["ra"], Settings())
    _, joined = regionalise.build_graph(points, layers["ra"], Settings(disconnected_parts="join_nearest"))
    assert [(r.unit_a, r.unit_b) for r in joined.filter("source = 'join_nearest'").collect()] == [("P12", "P18")]
    cells = points.select("point_id")
    with pytest.raises(MissingDataError, match="P07 tmax 2024-03-15"):
        regionalise.build_scores(planted.weather(spark), cells, joined, Settings())
    moved = layers["ra"].withColumn("parent_id", F.when(F.col("id") == "RA-NW-1", "PGA-GHOST").otherwise(F.col("parent_id")))
    assert any("RA-NW-1" in p and "GHOST" in p for p in check_nesting(moved, layers["pga"], 25_000))
    with pytest.raises(NestingError):
        run(spark, points, layers | {"ra": moved}, planted.weather(spark), planted.demand(spark), SETTINGS)


def test_all_problems_of_settings_at_once():
    bad = Settings(neighbour_rule="bishop", smoothing_days=4, missing_data="guess", number_of_regions=0, held_out_start="2020-01-01")
    assert len(bad.problems()) == 5 and not SETTINGS.problems()
