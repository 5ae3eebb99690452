"""Overlay of shapes against areas worked out otherwise, and cases with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from zonewright.operators import geometry, overlay
from zonewright.operators.overlay import EITHER, INTERSECTION, REST, UNION, cut_to_square, overlaid, overlaid_area, repaired


def shape(*rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]]


def box(x0, y0, x1, y1):
    return shape(((x0, y0), (x1, y0), (x1, y1), (x0, y1)))


def size(s):
    return sum(geometry.signed_area([(p["x"], p["y"]) for p in ring]) for polygon in s for ring in polygon)


U = shape(((0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)))
BOW = shape(((0, 0), (2, 2), (2, 0), (0, 2)))


def star(rng, cx, cy, n):
    radius = [rng.uniform(3, 20) for _ in range(n)]
    return shape([(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i, r in enumerate(radius)])


def test_concave_land_has_its_parts():
    cut = overlaid([U, box(-5, 20, 40, 40)], INTERSECTION)
    assert len(cut) == 2 and size(cut) == pytest.approx(200) and not geometry.crossing(cut)
    assert overlaid([U, box(11, 12, 19, 40)], INTERSECTION) == []
    assert len(overlaid([U, box(0, 0, 30, 5)], INTERSECTION)) == 1


def test_union_keeps_holes_and_parts():
    frame = overlaid([box(0, 0, 30, 10), box(0, 20, 30, 30), box(0, 0, 10, 30), box(20, 0, 30, 30)], UNION)
    assert [len(p) for p in frame] == [2] and size(frame) == pytest.approx(800)
    filled = overlaid([frame, box(10, 10, 20, 20)], UNION)
    assert [len(p) for p in filled] == [1] and len(filled[0][0]) == 4  # no corner is left of the inner borders
    apart = overlaid([box(0, 0, 10, 10), box(10, 0, 20, 5), box(10, 5, 20, 10), box(40, 0, 41, 1)], UNION)
    assert [round(size([p]), 6) for p in apart] == [200.0, 1.0]
    corner = overlaid([box(0, 0, 10, 10), box(10, 10, 20, 20)], UNION)
    assert len(corner) == 2 and not geometry.crossing(corner)


def test_random_stars_against_triangles():
    rng = random.Random(3)
    for _ in range(120):
        a, b = star(rng, 4e5, 3e5, rng.randrange(3, 25)), star(rng, 4e5 + rng.uniform(-10, 10), 3e5 + rng.uniform(-10, 10), rng.randrange(3, 25))
        both = geometry.overlap(a, b)
        got = [size(overlaid([a, b], rule)) for rule in (INTERSECTION, UNION, REST, EITHER)]
        assert got == pytest.approx([both, size(a) + size(b) - both, size(a) - both, size(a) + size(b) - 2 * both], abs=1e-6)
        assert overlaid_area([a, b], EITHER) == pytest.approx(got[3], abs=1e-6)


def test_repair():
    mended = repaired(BOW)
    assert [round(size([p]), 9) for p in mended] == [1.0, 1.0] and not geometry.crossing(mended)
    assert repaired(U) is U and repaired(None) is None
    twice = shape(((0, 0), (10, 0), (10, 10), (2, 10), (2, 4), (6, 4), (6, 12), (0, 12)))  # runs over itself
    assert geometry.crossing(twice) and size(repaired(twice)) == pytest.approx(overlaid_area([twice, []], UNION)) and not geometry.crossing(repaired(twice))


def test_squares_cut_and_put_together_again(spark):
    pieces = cut_to_square(U, -5, 20, 40, 40)
    assert size(pieces) == pytest.approx(200) and len(overlaid([pieces], UNION)) == 2
    rows = [("u", U), ("u", box(10, 10, 20, 12)), ("v", box(3, 3, 90, 4)), ("v", box(50, 0, 51, 30))]
    df = spark.createDataFrame(rows, f"group_id string, shape {geometry.SHAPE}")
    far = spark.createDataFrame([("w", box(-40 + i, -3, -39 + i, 3)) for i in range(80)], df.schema)
    strip = overlay.dissolved(far, 1.5).first()["shape"]
    assert len(strip) == 1 and len(strip[0][0]) == 4 and size(strip) == pytest.approx(480)
    for step in (7.0, 1000.0):
        got = {r.group_id: r["shape"] for r in overlay.dissolved(df, step).collect()}
        assert len(got["u"]) == 1 and len(got["u"][0][0]) == 8 and size(got["u"]) == pytest.approx(size(U) + 20)
        assert len(got["v"]) == 1 and size(got["v"]) == pytest.approx(87 + 30 - 1)


def test_slivers_of_overlapping_children(spark):
    parents = spark.createDataFrame([("P", box(0, 0, 10, 10)), ("Q", box(20, 0, 30, 10)), ("R", box(40, 0, 50, 10))], f"id string, shape {geometry.SHAPE}")
    children = spark.createDataFrame(
        [("a", "P", box(0, 0, 6, 10)), ("b", "P", box(4, 0, 10, 10)), ("c", "Q", box(20, 0, 26, 12)), ("d", "Q", box(24, 0, 30, 9)), ("e", "nowhere", box(0, 0, 9, 9))],
        f"id string, parent_id string, shape {geometry.SHAPE}",
    )
    for step in (3.0, 100.0):
        got = {r.parent_id: round(r.sliver_area, 6) for r in overlay.slivers(children, parents, step).collect()}
        assert got == {"Q": 12.0 + 4.0, "R": 100.0}  # 6 x 2 above; the two overlap, and 26 to 30 lacks its top row


def test_slivers_of_crowded_squares(spark):
    """Thousands of copies and hundreds of overlapping children in one square: no task puts more than a few together."""
    spots = [(i % 20, i // 20) for i in range(400)]
    boxes = [box(x, y, x + 9, y + 9) for x, y in spots] + [box(2, 2, 7, 7)] * 3000
    children = spark.createDataFrame([("P", s) for s in boxes] + [("Q", shape(((50, 0), (50 + i / 10, 0), (50, i / 2)))) for i in range(1, 60)], f"parent_id string, shape {geometry.SHAPE}")
    parents = spark.createDataFrame([("P", box(0, 0, 25, 30)), ("Q", box(50, 0, 60, 30))], f"parent_id string, shape {geometry.SHAPE}")
    most = overlay.differing_squares(children, parents, 100.0, crowd=8).agg(F.max(F.size("kids"))).first()[0]
    assert most <= 8
    named = children.withColumn("id", F.monotonically_increasing_id())
    got = {r.parent_id: r.sliver_area for r in overlay.slivers(named, parents.withColumnRenamed("parent_id", "id"), 100.0).collect()}
    assert got == pytest.approx({"P": 28 * 28 + 25 * 30 - 2 * 25 * 28, "Q": 300 - 5.9 * 29.5 / 2})


def test_points_in_shapes(spark):
    land = spark.createDataFrame([("U", U), ("B", box(100, 100, 130, 130))], f"id string, shape {geometry.SHAPE}")
    points = [("a", 5.0, 20.0), ("b", 15.0, 20.0), ("c", 0.0, 5.0), ("d", 115.0, 129.0), ("e", -50.0, 3.0), ("f", None, 1.0)]
    df = spark.createDataFrame(points, "point_id string, x double, y double")
    got = {(r.point_id, r.id) for r in geometry.points_within(df, land, 8.0).collect()}
    assert got == {("a", "U"), ("d", "B")}


def test_columns(spark):
    df = spark.createDataFrame([(BOW, U, box(-5, 20, 40, 40))], f"bow {geometry.SHAPE}, u {geometry.SHAPE}, b {geometry.SHAPE}")
    row = df.select(geometry.part_count(overlay.repair("bow")).alias("bow"), geometry.part_count(overlay.intersection("u", "b")).alias("parts")).first()
    assert (row.bow, row.parts) == (2, 2)
    assert df.select(geometry.part_count(overlay.union_of(F.array("u", "b"))).alias("n")).first().n == 1
