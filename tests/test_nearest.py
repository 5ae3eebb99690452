"""Nearest points and cells, against a plain look at every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from zonewright.operators import geometry, nearest


def brute(places, points, k):
    good = [p for p in points if all(c is not None and math.isfinite(c) for c in p[1:])]
    return {i: sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), n) for n, a, b in good)[:k] for i, x, y in places if x is not None and math.isfinite(x)}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.place_id, []).append((r["rank"], r.metres, r.point_id))
    return {i: [x[1:] for x in sorted(rows)] for i, rows in out.items()}


@pytest.mark.parametrize("k", [1, 4])
def test_dense_and_thin_ground(spark, k):
    rng = random.Random(k)
    points = [(f"p{i:03d}", rng.gauss(0, 1) ** 5 * 1000, rng.uniform(0, 50)) for i in range(200)]  # most in a heap, some far off
    points += [(f"same{i}", 5.0, 5.0) for i in range(6)] + [("null", None, 1.0), ("nan", float("nan"), 1.0), ("inf", 1.0, float("inf"))]
    places = [(i, rng.uniform(-9000, 9000), rng.uniform(-500, 500)) for i in range(60)] + [(900, 5.0, 5.0), (901, None, 0.0), (902, 1e9, -1e9)]
    df = nearest.nearest_join(spark.createDataFrame(places, "place_id long, x double, y double"), spark.createDataFrame(points, "point_id string, x double, y double"), k, leaf=3)
    got, want = found(df), brute(places, points, k)
    assert {i: [(n, round(m, 6)) for m, n in rows] for i, rows in got.items()} == {i: [(n, round(m, 6)) for m, n in rows] for i, rows in want.items()}


def test_few_points(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0)], "point_id string, x double, y double")
    places = spark.createDataFrame([(1, 4.0, 6.0), (2, 1.0, 2.0)], "place_id long, x double, y double")
    assert found(nearest.nearest_join(places, one, 3)) == {1: [(5.0, "a")], 2: [(0.0, "a")]}
    assert nearest.nearest_join(places, one.limit(0)).count() == 0 and nearest.nearest_join(places.limit(0), one).count() == 0
    pair = nearest.closest_pair(places.select(F.concat(F.lit("u"), F.col("place_id").cast("string")).alias("unit_id"), "x", "y"), one.withColumnRenamed("point_id", "unit_id"))
    assert [tuple(r) for r in pair.collect()] == [("u2", "a", 0.0)]
    assert nearest.closest_pair(places.withColumnRenamed("place_id", "unit_id").limit(0), one.withColumnRenamed("point_id", "unit_id")).count() == 0


def shuffled(spark):
    """Bytes shuffled and written by all stages so far."""
    lists = spark._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), lists()).iterator()
    total = 0
    while stages.hasNext():
        s = stages.next()
        total += s.shuffleWriteBytes() + s.outputBytes()
    return total


def test_places_move_once(spark):
    """Places go to tasks in blocks: without broadcasts, what moves is a few times the places, not the squares that each keeps."""
    side = lambda c, seed: (F.rand(seed) * 1000).alias(c)
    places = spark.range(60_000).select(F.col("id").alias("place_id"), side("x", 1), side("y", 2))
    points = spark.range(4_000).select(F.col("id").alias("point_id"), side("x", 3), side("y", 4))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = nearest.nearest_join(places, points).agg(F.count("*").alias("n"), F.sum("metres").alias("m")).first()
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.n == 60_000 and got.m / got.n == pytest.approx(0.5 * 1000 / math.sqrt(4_000), rel=0.05)
    assert moved < 60_000 * 150


@pytest.mark.parametrize("k", [1, 5])
def test_heaps_and_copies(spark, k):
    """Many places at one spot, heaps far apart, and equal distances: deep squares, and blocks in several parts."""
    rng = random.Random(11)
    points = [(f"p{i:03d}", float(i % 20), float(i // 20)) for i in range(200)] + [(f"q{i:02d}", 1e7 + rng.random() * 1e-3, 1e7 + rng.random() * 1e-3) for i in range(40)]
    places = [(i, 7.5, 3.5) for i in range(700)] + [(1000 + i, 1e7 + rng.random() * 1e-3, 1e7) for i in range(50)] + [(2000 + i, float(i), 3.5) for i in range(20)] + [(3000, 5e6, 5e6), (3001, -1e12, 7.0)]
    df = nearest.nearest_join(spark.createDataFrame(places, "place_id long, x double, y double"), spark.createDataFrame(points, "point_id string, x double, y double"), k, leaf=3)
    assert found(df) == brute(places, points, k)


def test_cells_by_neighbours_are_the_cells(spark):
    rng = random.Random(7)
    rows = [(f"p{i:02d}", rng.uniform(0, 100) + 4e5, rng.uniform(0, 30) + 3e5) for i in range(40)] + [("line1", 4e5, 3e5), ("line2", 4e5 + 100, 3e5), ("line3", 4e5 + 50, 3e5)]
    points = spark.createDataFrame(rows, "point_id string, x double, y double")
    area = lambda cells: {r.point_id: r.a for r in cells.select("point_id", geometry.area(F.col("shape")).alias("a")).collect()}
    got, want = area(nearest.voronoi_cells(points, in_task=0)), area(nearest.voronoi_cells(points))
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 * want[i] for i in want)


def areas(cells):
    return {r.point_id: r.a for r in cells.select("point_id", geometry.area(F.col("shape")).alias("a")).collect()}


@pytest.mark.parametrize("last", [0, nearest.LAST_CELLS])
def test_cells_of_awkward_ground(spark, last):
    """Heaps, copies, a line, empty ground and a far point: the cells are those by all points, by corners' rounds and by the last cells' squares."""
    rng = random.Random(5)
    rows = [(f"p{i:03d}", rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(300)] + [(f"h{i:03d}", 5000 + rng.random(), 700 + rng.random()) for i in range(300)]
    rows += [(f"c{i:02d}", 500.0, 500.0) for i in range(30)] + [(f"l{i:03d}", 2000.0, i * 7.0) for i in range(150)] + [("far", 3000.0, 40000.0), ("null", None, 1.0), ("nan", 1.0, float("nan"))]
    points = spark.createDataFrame(rows, "point_id string, x double, y double")
    got, want = areas(nearest.cells_by_neighbours(points, last=last)), areas(geometry.voronoi_cells(points.filter("x IS NOT NULL AND NOT isnan(y)")))
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-6, abs=1e-6) for i in want)


def test_cells_of_one_spot(spark):
    points = spark.createDataFrame([(i, 3.0, 4.0) for i in range(20)], "point_id long, x double, y double")
    assert areas(nearest.cells_by_neighbours(points)) == {i: 4.0 for i in range(20)}
    assert nearest.cells_by_neighbours(points.limit(0)).count() == 0


def task_memory(spark, run):
    """MB of execution memory of the largest task of what run does."""
    store, lists = spark._jvm.org.apache.spark.SparkContext.getOrCreate().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: store.stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), lists())
    before = max((s.stageId() for s in (stages().apply(i) for i in range(stages().size()))), default=-1)
    run()
    most, found = 0, stages()
    for i in range(found.size()):
        if (s := found.apply(i)).stageId() > before and s.numCompleteTasks():
            tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
            most = max([most, *(tasks.apply(j).taskMetrics().get().peakExecutionMemory() for j in range(tasks.size()) if tasks.apply(j).taskMetrics().isDefined())])
    return most / 1e6


def test_memory_of_cells_follows_the_points(spark):
    """A task's memory grows no faster than the points, and no task makes all cells of some thousand points."""
    side = lambda c, seed: (F.rand(seed) * 1000).alias(c)
    sizes, used = (6_000, 24_000), []
    for n in sizes:
        points = spark.range(n).select(F.col("id").alias("point_id"), side("x", 1), side("y", 2))
        total = []
        used.append(task_memory(spark, lambda: total.append(nearest.voronoi_cells(points).select(geometry.area(F.col("shape")).alias("a")).agg(F.sum("a"), F.count("*")).first())))
        x0, y0, x1, y1 = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        margin = math.hypot(x1 - x0, y1 - y0)
        assert total[0][1] == n and total[0][0] == pytest.approx((x1 - x0 + 2 * margin) * (y1 - y0 + 2 * margin), rel=1e-9)
    assert 0 < used[1] <= used[0] * sizes[1] / sizes[0], used
