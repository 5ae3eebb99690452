"""Finding and filling holes, against the plain walk in order of variable, date and point."""

import datetime
import random

from zonewright.operators import anomaly
from zonewright.plans import regionalise

DAY = datetime.date(2024, 1, 1)
READINGS = "point_id string, variable string, date date, value double"


def walked(values, points, near):
    """values {(variable, date, point): value}; the holes filled one by one, each seeing the fills before it."""
    values, filled, left = dict(values), {}, set()
    days = {(v, d) for v, _, _ in values for _, d, _ in values}
    for v, d in sorted(days):
        for p in sorted(points):
            if values.get((v, d, p)) is None:
                have = [values[v, d, n] for n in near.get(p, ()) if values.get((v, d, n)) is not None]
                if have:
                    values[v, d, p] = filled[p, v, d] = sum(have) / len(have)
                else:
                    left.add((p, v, d))
    return filled, left


def tables(spark, seed, share):
    rng = random.Random(seed)
    points = [f"p{i:02d}" for i in range(12)]
    pairs = [(a, b) for a in points for b in points if a < b and rng.random() < 0.25]
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    values = {(v, DAY + datetime.timedelta(d), p): float(rng.randrange(100)) for v in ("rain", "tmax") for d in range(9) for p in points}
    gone = {k for k in values if rng.random() < share} - {(v, DAY, "p03") for v in ("rain", "tmax")}
    rows = [(p, v, d, None if rng.random() < 0.5 else float("nan")) if (v, d, p) in gone else (p, v, d, x) for (v, d, p), x in values.items()]
    rows = [r for r in rows if r[3] is not None or rng.random() < 0.5]  # absent, null and not-a-number are all missing
    df = spark.createDataFrame(rows, READINGS).repartition(3)
    values = {k: x for k, x in values.items() if k not in gone}
    return df, spark.createDataFrame([(p,) for p in points], "point_id string"), spark.createDataFrame(pairs, "point_a string, point_b string"), values, points, near, gone


def test_order_of_filling(spark):
    for seed, share in ((1, 0.1), (2, 0.6), (3, 0.9)):
        df, points, edges, values, names, near, gone = tables(spark, seed, share)
        dates = {d for _, d, _ in values} | {r.date for r in df.select("date").distinct().collect()}
        missing = anomaly.holes(df, points)
        assert {(r.variable, r.date, r.point_id) for r in missing.collect()} == {k for k in gone if k[1] in dates}
        want, left = walked({k: x for k, x in values.items()} | {(v, d, "none"): 0.0 for v in ("rain", "tmax") for d in dates}, names, near)
        fills = {(r.point_id, r.variable, r.date): r.value for r in anomaly.neighbour_fills(df, missing, edges).collect()}
        assert set(fills) == set(want) and all(abs(fills[k] - want[k]) < 1e-9 for k in want)
        full = anomaly.filled_from_neighbours(df, missing, edges)
        assert full.count() == len(values) + len(want)


def test_a_chain_of_two_holes(spark):
    """b waits for a: a = mean(10, 30) = 20; b has a and c: mean(20, 40)."""
    rows = [("x", "t", DAY, 10.0), ("y", "t", DAY, 30.0), ("c", "t", DAY, 40.0), ("a", "t", DAY, None), ("b", "t", DAY, None), ("z", "t", DAY, None)]
    edges = spark.createDataFrame([("a", "x"), ("y", "a"), ("a", "b"), ("b", "c"), ("a", "z")], "point_a string, point_b string")
    df = spark.createDataFrame(rows, READINGS)
    missing = anomaly.holes(df, df.select("point_id"))
    got = {r.point_id: (r.value, r.neighbours) for r in anomaly.neighbour_fills(df, missing, edges).collect()}
    assert got == {"a": (20.0, 2), "b": (30.0, 2), "z": (20.0, 1)}


def test_no_holes_and_repeats(spark):
    rows = [(p, "t", DAY + datetime.timedelta(i), 1.0) for p in "ab" for i in (0, 1, 5)]
    df, points = spark.createDataFrame(rows, READINGS), spark.createDataFrame([("a",), ("b",)], "point_id string")
    assert anomaly.holes(df, points).count() == 0
    # a repeated day does not make up for a missing one
    odd = spark.createDataFrame(rows[1:] + rows[1:2], READINGS)
    assert [(r.point_id, r.date) for r in anomaly.holes(odd, points).collect()] == [("a", DAY)]
    assert anomaly.holes(df.limit(0), points).count() == 0
    assert regionalise.MissingDataError


def test_a_run_fills_and_says_so(spark):
    """The planted hole gets the mean of its neighbours' readings, and a notice; nothing else is touched."""
    from pyspark.sql import functions as F

    from zonewright.sources import planted

    cells = planted.points(spark).select("point_id", F.lit(None).cast("string").alias("shape")).filter("point_id <> 'P17'")
    edges = spark.createDataFrame([("P06", "P07"), ("P07", "P08"), ("P03", "P07"), ("P07", "P11"), ("P01", "P02")], "unit_a string, unit_b string")
    said = []
    settings = regionalise.Settings(build_start="2023-09-01", missing_data="fill_from_neighbours")
    scores = regionalise.build_scores(planted.weather(spark), cells, edges, settings, said.append)["anomalies"]
    assert said == ["filled 1 reading(s): P07 tmax on 2024-03-15 from the mean of 4 neighbour(s)"]
    days = scores.filter("variable = 'tmax'").groupBy("point_id").count().collect()
    assert len(days) == 17 and {r["count"] for r in days} == {731}
