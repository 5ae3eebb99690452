"""Polygons as nested arrays: areas, overlaps, cells and common borders.

A shape is array<array<array<struct<x,y>>>>: polygons of rings of points, the first ring of a polygon its outside, the
others holes; a ring closes itself. Candidate pairs come from an equi-join on grid squares, so no pair of far shapes
is ever made; the geometry of a pair is a small function on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SHAPE = "array<array<array<struct<x:double,y:double>>>>"
#: Coordinates closer than this are the same, in metres.
SNAP = 0.01
#: Voronoi cells hold all points in each task; the count is checked.
MOST_POINTS = 20_000

Point = tuple[float, float]


def box_shape(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """An upright rectangle as a shape."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))))


def _ring_area(ring: Column) -> Column:
    """Signed, about the ring's first point (coordinates are large); open and closed rings alike."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    cross = lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0)
    return F.aggregate(F.zip_with(ring, after, cross), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))) / 2


def area(shape: Column) -> Column:
    """Square units, holes taken off; 0 for an empty shape, null for a null one."""
    of_polygon = lambda p: F.aggregate(F.transform(p, lambda r, i: F.when(i == 0, F.abs(_ring_area(r))).otherwise(-F.abs(_ring_area(r)))), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(shape, of_polygon), F.lit(0.0), lambda s, v: s + v)


def part_count(shape: Column) -> Column:
    return F.coalesce(F.size(shape), F.lit(0))


def bounds(shape: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    points = F.flatten(F.flatten(shape))
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def near_pairs(left: DataFrame, right: DataFrame, step: float) -> DataFrame:
    """(left_id, right_id, left_shape, right_shape) whose bounds touch; sides (id, shape).

    Each shape goes to the squares of side step that its bounds meet. A pair meets once, in the square of the lower
    corner of the common part. Shapes much larger than step go to many squares: choose step near their usual size.
    """

    def gridded(df: DataFrame, side: str) -> DataFrame:
        b = df.select(F.col("id").alias(f"{side}_id"), F.col("shape").alias(f"{side}_shape"), bounds(F.col("shape")).alias(side)).filter(F.size(f"{side}_shape") > 0)
        cell = lambda c: F.floor(F.col(f"{side}.{c}") / step)
        b = b.withColumn("gx", F.explode(F.sequence(cell("x0"), cell("x1"))))
        return b.withColumn("gy", F.explode(F.sequence(cell("y0"), cell("y1"))))

    pairs = gridded(left, "left").join(gridded(right, "right"), ["gx", "gy"])
    touch = (F.col("left.x0") <= F.col("right.x1")) & (F.col("right.x0") <= F.col("left.x1")) & (F.col("left.y0") <= F.col("right.y1")) & (F.col("right.y0") <= F.col("left.y1"))
    once = (F.col("gx") == F.floor(F.greatest("left.x0", "right.x0") / step)) & (F.col("gy") == F.floor(F.greatest("left.y0", "right.y0") / step))
    return pairs.filter(touch & once).select("left_id", "right_id", "left_shape", "right_shape")


def polygons_of(shape: Iterable | None) -> list[list[list[Point]]]:
    """Plain tuples, closing points dropped, outsides anticlockwise and holes clockwise."""
    out = []
    for polygon in shape if shape is not None else ():
        rings = []
        for i, ring in enumerate(polygon):
            points = [(float(p["x"]), float(p["y"])) for p in ring]
            if len(points) > 1 and points[0] == points[-1]:
                points.pop()
            if len(points) >= 3:
                rings.append(points if (signed_area(points) >= 0) == (i == 0) else points[::-1])
        if rings:
            out.append(rings)
    return out


def signed_area(points: list[Point]) -> float:
    if len(points) < 3:
        return 0.0
    x0, y0 = points[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(points[1:], points[2:])) / 2


def clip_half(points: list[Point], a: float, b: float, c: float) -> list[Point]:
    """The part of a convex ring where a*x + b*y <= c."""
    out: list[Point] = []
    for i, (px, py) in enumerate(points):
        qx, qy = points[(i + 1) % len(points)]
        dp, dq = a * px + b * py - c, a * qx + b * qy - c
        if dp <= 0:
            out.append((px, py))
        if (dp < 0 < dq) or (dq < 0 < dp):
            t = dp / (dp - dq)
            out.append((px + t * (qx - px), py + t * (qy - py)))
    return out


def clip_convex(points: list[Point], convex: list[Point]) -> list[Point]:
    """The part of a convex ring within another, anticlockwise one."""
    for i, (px, py) in enumerate(convex):
        qx, qy = convex[(i + 1) % len(convex)]
        points = clip_half(points, qy - py, px - qx, (qy - py) * px + (px - qx) * py)
        if len(points) < 3:
            return []
    return points


def _triangles(polygons: list[list[list[Point]]], ox: float, oy: float) -> list[tuple[float, list[Point]]]:
    """A shape as signed triangles, moved to a near origin; concave rings, holes and parts come out right in the sum."""
    out = []
    for ring in (r for p in polygons for r in p):
        pts = [(x - ox, y - oy) for x, y in ring]
        for b, c in zip(pts[1:], pts[2:]):
            t = [pts[0], b, c]
            if s := signed_area(t):
                out.append((1.0, t) if s > 0 else (-1.0, t[::-1]))
    return out


def overlap(first: Iterable | None, second: Iterable | None) -> float:
    """Area that two shapes have in common."""
    a, b = polygons_of(first), polygons_of(second)
    if not a or not b:
        return 0.0
    ox, oy = a[0][0][0]
    total = 0.0
    theirs = [(s, t, min(p[0] for p in t), max(p[0] for p in t), min(p[1] for p in t), max(p[1] for p in t)) for s, t in _triangles(b, ox, oy)]
    for s, t in _triangles(a, ox, oy):
        x0, x1, y0, y1 = min(p[0] for p in t), max(p[0] for p in t), min(p[1] for p in t), max(p[1] for p in t)
        for s2, t2, u0, u1, v0, v1 in theirs:
            if u0 < x1 and x0 < u1 and v0 < y1 and y0 < v1:
                total += s * s2 * abs(signed_area(clip_convex(t, t2)))
    return max(0.0, total)


def mended(shape: Iterable | None) -> list:
    """A shape without repeated points, spikes and rings of no area; outsides anticlockwise, holes clockwise.

    Rings that cross themselves are not taken apart; crossing() finds them.
    """
    out = []
    for polygon in polygons_of(shape):
        rings = []
        for ring in polygon:
            points: list[Point] = []
            for p in ring:
                points.append(p)
                while len(points) >= 2 and math.dist(points[-1], points[-2]) <= SNAP:
                    points.pop()
                while len(points) >= 3 and math.dist(points[-1], points[-3]) <= SNAP:  # out and back: a spike
                    del points[-2:]
            while len(points) > 1 and math.dist(points[0], points[-1]) <= SNAP:
                points.pop()
            if abs(signed_area(points)) > SNAP * SNAP:
                rings.append([{"x": x, "y": y} for x, y in points])
        if rings:
            out.append(rings)
    return out


def crossing(shape: Iterable | None) -> bool:
    """Whether any two edges of a shape cross, other than at common ends."""
    edges = _edges(polygons_of(shape))
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for i, (a, b) in enumerate(edges):
        for c, d in edges[i + 1 :]:
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return True
    return False


def inside(shape: Iterable | None, x: float, y: float) -> bool:
    """Whether a point lies strictly within a shape: the border is outside."""
    within = False
    for (px, py), (qx, qy) in _edges(polygons_of(shape)):
        length = math.hypot(qx - px, qy - py)
        off = ((x - px) * (qy - py) - (y - py) * (qx - px)) / length
        along = ((x - px) * (qx - px) + (y - py) * (qy - py)) / length
        if abs(off) <= SNAP and -SNAP <= along <= length + SNAP:
            return False
        if (py > y) != (qy > y) and x < px + (y - py) * (qx - px) / (qy - py):
            within = not within
    return within


def inner_point(shape: Iterable | None) -> Point | None:
    """Some point within a shape: the middle of its longest run on a line at mid height of its largest polygon."""
    polygons = polygons_of(shape)
    if not polygons:
        return None
    largest = max(polygons, key=lambda p: abs(signed_area(p[0])))
    heights = sorted({y for ring in largest for _, y in ring})
    low, high = max(zip(heights, heights[1:]), key=lambda ab: ab[1] - ab[0])
    y = (low + high) / 2
    hits = sorted(px + (y - py) * (qx - px) / (qy - py) for (px, py), (qx, qy) in _edges([largest]) if (py > y) != (qy > y))
    a, b = max(zip(hits[::2], hits[1::2]), key=lambda ab: ab[1] - ab[0])
    return (a + b) / 2, y


def outline(shapes: Iterable) -> list:
    """The dissolved border of disjoint shapes, as rings of points: common border cancels, also where corners do not meet."""
    polygons = [p for s in shapes for p in polygons_of(s)]
    corners = {(round(x / SNAP), round(y / SNAP)): (x, y) for p in polygons for ring in p for x, y in ring}
    count: dict[tuple, int] = {}
    for (px, py), (qx, qy) in _edges(polygons):
        length = math.hypot(qx - px, qy - py)
        on = [(((x - px) * (qx - px) + (y - py) * (qy - py)) / length, k) for k, (x, y) in corners.items() if abs((x - px) * (qy - py) - (y - py) * (qx - px)) / length <= SNAP]
        stops = [k for t, k in sorted(on) if -SNAP <= t <= length + SNAP]
        for a, b in zip(stops, stops[1:]):
            if count.get((b, a)):
                count[b, a] -= 1
            else:
                count[a, b] = count.get((a, b), 0) + 1
    after: dict[tuple, list] = {}
    for (a, b), n in sorted(count.items()):
        after.setdefault(a, []).extend([b] * n)
    rings = []
    while start := next((a for a in sorted(after) if after[a]), None):
        ring, at = [], start
        while after.get(at):
            ring.append(at)
            at = after[at].pop()
        rings.append([corners[k] for k in ring])
    return rings


def _edges(polygons: list[list[list[Point]]]) -> list[tuple[Point, Point]]:
    return [(p, q) for polygon in polygons for ring in polygon for p, q in zip(ring, ring[1:] + ring[:1]) if p != q]


def shared_edge(first: Iterable | None, second: Iterable | None) -> tuple[float, bool]:
    """Metres of common border, and whether the shapes touch at all.

    Border counts where edges lie on one line and run against each other, the insides being on opposite sides; shapes
    that overlap have none.
    """
    a, b = _edges(polygons_of(first)), _edges(polygons_of(second))
    metres, touch = 0.0, False
    for (px, py), (qx, qy) in a:
        length = math.hypot(qx - px, qy - py)
        ux, uy = (qx - px) / length, (qy - py) / length
        for (rx, ry), (sx, sy) in b:
            along = [(rx - px) * ux + (ry - py) * uy, (sx - px) * ux + (sy - py) * uy]
            off = [(rx - px) * uy - (ry - py) * ux, (sx - px) * uy - (sy - py) * ux]
            if max(map(abs, off)) <= SNAP:
                common = min(length, max(along)) - max(0.0, min(along))
                if common >= -SNAP:
                    touch = True
                    if common > SNAP and along[1] < along[0]:
                        metres += common
            elif off[0] * off[1] <= 0 or min(map(abs, off)) <= SNAP:  # the line is met: where?
                t = along[0] + (along[1] - along[0]) * off[0] / (off[0] - off[1])
                touch = touch or -SNAP <= t <= length + SNAP
    return metres, touch


POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SHAPE_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))


# Arrow functions see nested lists as they are, rings of unequal length included.


@F.arrow_udf(SHAPE_TYPE)
def mend(shape: pa.Array) -> pa.Array:
    return pa.array([None if s is None else mended(s) for s in shape.to_pylist()], to_arrow_type(SHAPE_TYPE))


@F.arrow_udf(T.BooleanType())
def crosses_itself(shape: pa.Array) -> pa.Array:
    return pa.array([crossing(s) for s in shape.to_pylist()], pa.bool_())


@F.arrow_udf(T.BooleanType())
def contains(shape: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array([inside(*row) for row in zip(shape.to_pylist(), x.to_pylist(), y.to_pylist())], pa.bool_())


@F.arrow_udf(POINT)
def representative_point(shape: pa.Array) -> pa.Array:
    found = [inner_point(s) for s in shape.to_pylist()]
    return pa.array([None if p is None else {"x": p[0], "y": p[1]} for p in found], to_arrow_type(POINT))


@F.arrow_udf(T.DoubleType())
def overlap_area(first: pa.Array, second: pa.Array) -> pa.Array:
    return pa.array([overlap(a, b) for a, b in zip(first.to_pylist(), second.to_pylist())], pa.float64())


BORDER = T.StructType([T.StructField("metres", T.DoubleType()), T.StructField("touch", T.BooleanType())])


@F.arrow_udf(BORDER)
def border(first: pa.Array, second: pa.Array) -> pa.Array:
    pairs = [shared_edge(a, b) for a, b in zip(first.to_pylist(), second.to_pylist())]
    return pa.array([{"metres": m, "touch": t} for m, t in pairs], to_arrow_type(BORDER))


def area_shares(children: DataFrame, parents: DataFrame, step: float) -> DataFrame:
    """(child_id, parent_id, area, share) of every overlap; sides (id, shape).

    A share is of the child's covered area, so ground outside every parent does not show here: slivers() has it.
    """
    pairs = near_pairs(children, parents, step).withColumn("area", overlap_area("left_shape", "right_shape")).filter("area > 0")
    pairs = pairs.select(F.col("left_id").alias("child_id"), F.col("right_id").alias("parent_id"), "area")
    total = pairs.groupBy("child_id").agg(F.sum("area").alias("total"))
    return pairs.join(total, "child_id").select("child_id", "parent_id", "area", (F.col("area") / F.col("total")).alias("share"))


def points_within(points: DataFrame, shapes: DataFrame, step: float) -> DataFrame:
    """(point_id, id) wherever a point (point_id, x, y) lies strictly within a shape (id, shape); none for points on a border.

    Shapes go to the squares of side step that their bounds meet, points to the one they are in: an equi-join, then the
    exact test. Points without coordinates lie nowhere.
    """
    cell = lambda c: F.floor(c / step).cast("long")
    held = shapes.filter(F.size("shape") > 0).select("id", "shape", bounds(F.col("shape")).alias("b"))
    held = held.withColumn("gx", F.explode(F.sequence(cell(F.col("b.x0")), cell(F.col("b.x1"))))).withColumn("gy", F.explode(F.sequence(cell(F.col("b.y0")), cell(F.col("b.y1")))))
    at = points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("point_id", "x", "y", cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
    near = (F.col("x") > F.col("b.x0")) & (F.col("x") < F.col("b.x1")) & (F.col("y") > F.col("b.y0")) & (F.col("y") < F.col("b.y1"))
    return at.join(held, ["gx", "gy"]).filter(near).filter(contains("shape", "x", "y")).select("point_id", "id")


def adjacency(shapes: DataFrame, step: float, rule: str = "rook", least_metres: float = 1.0) -> DataFrame:
    """(unit_a, unit_b, shared_edge_metres), unit_a < unit_b: by common border (rook) or any contact (queen)."""
    pairs = near_pairs(shapes, shapes, step).filter("left_id < right_id").withColumn("b", border("left_shape", "right_shape"))
    pairs = pairs.filter(F.col("b.metres") >= least_metres if rule == "rook" else F.col("b.touch"))
    return pairs.select(F.col("left_id").alias("unit_a"), F.col("right_id").alias("unit_b"), F.col("b.metres").alias("shared_edge_metres"))


def voronoi_cells(points: DataFrame) -> DataFrame:
    """(point_id, shape): each point's cell within the points' bounds, widened by their diagonal; points (point_id, x, y).

    Every cell is a box cut by the bisectors with other points, nearest first, until none can reach it any more.
    """
    n = points.count()
    if n > MOST_POINTS:
        raise ValueError(f"{n} points; cells are built with all of them in each task, {MOST_POINTS} at most; nearest.voronoi_cells takes more")
    every = sorted((float(r.x), float(r.y), r.point_id) for r in points.select("point_id", "x", "y").collect())
    if not every:
        return points.select("point_id").withColumn("shape", F.lit(None).cast(SHAPE))
    xs, ys = [p[0] for p in every], [p[1] for p in every]
    margin = math.hypot(max(xs) - min(xs), max(ys) - min(ys)) or 1.0
    box = [(min(xs) - margin, min(ys) - margin), (max(xs) + margin, min(ys) - margin), (max(xs) + margin, max(ys) + margin), (min(xs) - margin, max(ys) + margin)]

    def cell(x: float, y: float) -> list:
        ring = [(a - x, b - y) for a, b in box]
        others = sorted((math.hypot(a - x, b - y), a - x, b - y) for a, b, _ in every if (a, b) != (x, y))
        for d, a, b in others:
            if d > 2 * max(math.hypot(*p) for p in ring):
                break
            ring = clip_half(ring, a, b, (a * a + b * b) / 2)
        return [[[{"x": a + x, "y": b + y} for a, b in ring]]]

    @F.arrow_udf(SHAPE_TYPE)
    def cells(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([cell(a, b) for a, b in zip(x.to_pylist(), y.to_pylist())], to_arrow_type(SHAPE_TYPE))

    return points.select("point_id", cells(F.col("x").cast("double"), F.col("y").cast("double")).alias("shape"))


#: The ellipsoids, the national grid's projection, and the published seven-parameter shift from WGS 84.
WGS84 = (6378137.0, 6356752.314245)
AIRY = (6377563.396, 6356256.909)
SHIFT = {"tx": -446.448, "ty": 125.157, "tz": -542.060, "s": 20.4894e-6, "rx": -0.1502, "ry": -0.2470, "rz": -0.8421}
GRID = {"f0": 0.9996012717, "lat0": 49.0, "lon0": -2.0, "e0": 400000.0, "n0": -100000.0}


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once and named: formulas that use it many times stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_national_grid(points: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """points with x and y, metres of the British national grid: transverse Mercator after the shift, in columns only."""
    sec = math.pi / 180 / 3600
    rx, ry, rz, scale = SHIFT["rx"] * sec, SHIFT["ry"] * sec, SHIFT["rz"] * sec, 1 + SHIFT["s"]

    def earth_centred(phi: Column, lam: Column) -> Column:
        a, b = WGS84
        e2 = (a * a - b * b) / (a * a)
        nu = F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
        return F.struct((nu * F.cos(phi) * F.cos(lam)).alias("x"), (nu * F.cos(phi) * F.sin(lam)).alias("y"), (nu * (1 - e2) * F.sin(phi)).alias("z"))

    def shifted(v: Column) -> Column:
        x = SHIFT["tx"] + v["x"] * scale - v["y"] * rz + v["z"] * ry
        y = SHIFT["ty"] + v["x"] * rz + v["y"] * scale - v["z"] * rx
        z = SHIFT["tz"] - v["x"] * ry + v["y"] * rx + v["z"] * scale
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    a, b = AIRY
    e2, n = (a * a - b * b) / (a * a), (a - b) / (a + b)
    f0, lat0, lon0 = GRID["f0"], math.radians(GRID["lat0"]), math.radians(GRID["lon0"])

    def geodetic(v: Column) -> Column:
        p = F.hypot(v["x"], v["y"])
        nu = lambda phi: F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
        # five rounds: the latitude settles to far below a millimetre
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.atan2(v["z"], p * (1 - e2)), lambda phi, _: F.atan2(v["z"] + e2 * nu(phi) * F.sin(phi), p))
        return F.struct(phi.alias("phi"), (F.atan2(v["y"], v["x"]) - lon0).alias("w"))

    def terms(g: Column) -> Column:
        phi = g["phi"]
        curve = 1 - e2 * F.sin(phi) * F.sin(phi)
        d, t = phi - lat0, phi + lat0
        m = b * f0 * (
            (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d
            - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(t)
            + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * t)
            - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * t)
        )
        each = {"s": F.sin(phi), "c": F.cos(phi), "t2": F.tan(phi) * F.tan(phi), "nu": a * f0 / F.sqrt(curve), "rho": a * f0 * (1 - e2) / F.pow(curve, F.lit(1.5)), "m": m, "w": g["w"]}
        return F.struct(*[c.alias(k) for k, c in each.items()])

    def projected(v: Column) -> Column:
        s, c, t2, nu, w = v["s"], v["c"], v["t2"], v["nu"], v["w"]
        k, c3, c5 = v["nu"] / v["rho"] - 1, F.pow(v["c"], F.lit(3.0)), F.pow(v["c"], F.lit(5.0))
        north = v["m"] + GRID["n0"] + nu / 2 * s * c * w**2 + nu / 24 * s * c3 * (5 - t2 + 9 * k) * w**4 + nu / 720 * s * c5 * (61 - 58 * t2 + t2 * t2) * w**6
        east = GRID["e0"] + nu * c * w + nu / 6 * c3 * (nu / v["rho"] - t2) * w**3 + nu / 120 * c5 * (5 - 18 * t2 + t2 * t2 + 14 * k - 58 * t2 * k) * w**5
        return F.struct(east.alias("x"), north.alias("y"))

    start = F.struct(F.radians(latitude).alias("phi"), F.radians(longitude).alias("lam"))
    at = _let(_let(_let(_let(_let(start, lambda g: earth_centred(g["phi"], g["lam"])), shifted), geodetic), terms), projected)
    return points.withColumn("_at", at).withColumns({"x": F.col("_at.x"), "y": F.col("_at.y")}).drop("_at")
