"""Shapes put together and cut by each other: intersection, union, difference, and repair of rings that cross themselves.

All of it is one procedure on Arrow batches. Edges are split where they meet, equal pieces are added up with their
direction, and each piece is told how often every shape winds round the ground on its left and on its right. A rule
says what of that ground belongs to the result; pieces with the result on one side only are its border, and are walked
into rings. Concave shapes, holes, parts and common borders need no case of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from zonewright.functions.storage import materialize
from zonewright.operators.geometry import SHAPE_TYPE, Point, area, bounds, box_shape, clip_half, crossing, polygons_of, signed_area

#: Corners closer than this are one, in metres.
CLOSE = 1e-6

#: What ground belongs to the result, from whether each shape (column) covers it.
Rule = Callable[[np.ndarray], np.ndarray]
UNION: Rule = lambda inside: inside.any(axis=1)
INTERSECTION: Rule = lambda inside: inside.all(axis=1)
#: The first shape less all others; and where the first and the union of the others differ.
REST: Rule = lambda inside: inside[:, 0] & ~inside[:, 1:].any(axis=1)
EITHER: Rule = lambda inside: inside[:, 0] != inside[:, 1:].any(axis=1)


class Corners:
    """Numbers of corners; what lies within CLOSE of a known corner is that corner."""

    def __init__(self):
        self.places: list[Point] = []
        self.near: dict[tuple[int, int], int] = {}

    def number(self, x: float, y: float) -> int:
        kx, ky = math.floor(x / CLOSE), math.floor(y / CLOSE)
        for dx in (0, -1, 1):
            for dy in (0, -1, 1):
                n = self.near.get((kx + dx, ky + dy))
                if n is not None and math.dist(self.places[n], (x, y)) <= CLOSE:
                    return n
        self.near[kx, ky] = len(self.places)
        self.places.append((x, y))
        return len(self.places) - 1


def pieces(shapes: list[list[list[list[Point]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, ends, counts): corners, pieces between them as pairs of numbers, and how often each shape's border runs along."""
    corners = Corners()
    edges = []
    for label, polygons in enumerate(shapes):
        for ring in (r for p in polygons for r in p):
            at = [corners.number(*p) for p in ring]
            edges += [(a, b, label) for a, b in zip(at, at[1:] + at[:1]) if a != b]
    if not edges:
        return np.zeros((0, 2)), np.zeros((0, 2), dtype=int), np.zeros((0, len(shapes)), dtype=int)
    e = np.array(edges)
    p = np.array(corners.places)
    a, b = p[e[:, 0]], p[e[:, 1]]
    run = b - a
    length = np.hypot(run[:, 0], run[:, 1])
    low, high = np.minimum(a, b) - CLOSE, np.maximum(a, b) + CLOSE
    stops: list[set[tuple[float, int]]] = [set() for _ in edges]
    for i in range(len(edges)):
        near = np.flatnonzero((low[:, 0] <= high[i, 0]) & (low[i, 0] <= high[:, 0]) & (low[:, 1] <= high[i, 1]) & (low[i, 1] <= high[:, 1]))
        for end, place in ((0, a), (1, b)):  # corners of others on this edge
            off = place[near] - a[i]
            along = (off @ run[i]) / length[i]
            apart = np.abs(off[:, 0] * run[i, 1] - off[:, 1] * run[i, 0]) / length[i]
            for j in np.flatnonzero((apart <= CLOSE) & (along > 0) & (along < length[i])):
                stops[i].add((float(along[j]) / length[i], int(e[near[j], end])))
        later = near[near > i]
        cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
        s0, s1 = cross(run[i], a[later] - a[i]) / length[i], cross(run[i], b[later] - a[i]) / length[i]
        t0, t1 = cross(run[later], a[i] - a[later]) / length[later], cross(run[later], b[i] - a[later]) / length[later]
        proper = (np.minimum(s0, s1) < -CLOSE) & (np.maximum(s0, s1) > CLOSE) & (np.minimum(t0, t1) < -CLOSE) & (np.maximum(t0, t1) > CLOSE)
        for k in np.flatnonzero(proper):
            t = t0[k] / (t0[k] - t1[k])
            n = corners.number(*(a[i] + t * run[i]))
            stops[i].add((float(t), n))
            stops[later[k]].add((float(s0[k] / (s0[k] - s1[k])), n))
    found: dict[tuple[int, int], list[int]] = {}
    for (first, last, label), between in zip(edges, stops):
        path = [first, *(n for _, n in sorted(between)), last]
        for u, v in zip(path, path[1:]):
            if u != v:
                found.setdefault((min(u, v), max(u, v)), [0] * len(shapes))[label] += 1 if u < v else -1
    kept = {k: c for k, c in found.items() if any(c)}
    ends = np.array(list(kept), dtype=int).reshape(-1, 2)
    return np.array(corners.places), ends, np.array(list(kept.values()), dtype=int).reshape(-1, len(shapes))


def sides(places: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each shape winds round the ground just left and just right of every piece."""
    a, b = places[ends[:, 0]], places[ends[:, 1]]
    left, right = np.zeros_like(counts), np.zeros_like(counts)
    for i in range(len(ends)):
        x, y = (a[i] + b[i]) / 2
        steep = abs(b[i, 1] - a[i, 1]) >= abs(b[i, 0] - a[i, 0])
        # A ray to the right for steep pieces, upwards for flat ones; axis k runs along the ray, axis m across it.
        k, m, here = (0, 1, (x, y)) if steep else (1, 0, (y, x))
        over = (a[:, m] > here[1]) != (b[:, m] > here[1])
        over[i] = False
        j = np.flatnonzero(over)
        hit = a[j, k] + (here[1] - a[j, m]) * (b[j, k] - a[j, k]) / (b[j, m] - a[j, m])
        j = j[hit > here[0]]
        way = np.sign(b[j, m] - a[j, m]) * (1 if steep else -1)
        beyond = (counts[j] * way[:, None].astype(int)).sum(axis=0)
        own = np.sign(b[i, m] - a[i, m]) * (1 if steep else -1)
        left[i], right[i] = (beyond + counts[i], beyond) if own > 0 else (beyond, beyond - counts[i])
    return left, right


def border(shapes: list[list[list[list[Point]]]], rule: Rule) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Corners, and the result's border as pieces from corner to corner that have the result on their left."""
    places, ends, counts = pieces(shapes)
    if not len(ends):
        return places, []
    left, right = (rule(w != 0) for w in sides(places, ends, counts))
    return places, [(int(u), int(v)) if inside else (int(v), int(u)) for (u, v), inside, other in zip(ends, left, right) if inside != other]


def rings_of(places: np.ndarray, edges: list[tuple[int, int]]) -> list[list[Point]]:
    """The pieces walked into rings, keeping to the result on the left; a ring meets no corner twice."""
    leaving: dict[int, list[int]] = {}
    for u, v in edges:
        leaving.setdefault(u, []).append(v)
    turn = lambda u, v: math.atan2(places[v][1] - places[u][1], places[v][0] - places[u][0])
    rings = []
    for start in sorted(leaving):
        while leaving[start]:
            path, u, v = [start], start, leaving[start].pop()
            while v != start:
                path.append(v)
                back = turn(v, u)
                # the first way on, clockwise from the way back: what lies between is inside
                w = min(leaving[v], key=lambda n: (back - turn(v, n)) % (2 * math.pi) or 2 * math.pi)
                leaving[v].remove(w)
                u, v = v, w
            rings += _simple(path)
    return [[(float(places[n][0]), float(places[n][1])) for n in ring] for ring in rings]


def _simple(path: list[int]) -> list[list[int]]:
    """A closed walk as loops that meet no corner twice."""
    out, held, where = [], [], {}
    for n in path:
        if n in where:
            cut = where[n]
            out.append(held[cut:])
            for x in held[cut + 1 :]:
                del where[x]
            del held[cut + 1 :]
        else:
            where[n] = len(held)
            held.append(n)
    out.append(held)
    return [r for r in out if len(r) >= 3]


def _straightened(ring: list[Point]) -> list[Point]:
    """Without corners in the middle of a straight line."""
    out = []
    for i, (x, y) in enumerate(ring):
        (px, py), (qx, qy) = ring[i - 1], ring[(i + 1) % len(ring)]
        off = abs((x - px) * (qy - py) - (y - py) * (qx - px))
        if off > CLOSE * math.hypot(qx - px, qy - py):
            out.append((x, y))
    return out if len(out) >= 3 else ring


def _within(ring: list[Point], x: float, y: float) -> bool:
    inside = False
    for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
        if (py > y) != (qy > y) and x < px + (y - py) * (qx - px) / (qy - py):
            inside = not inside
    return inside


def _some_point(ring: list[Point]) -> Point:
    """A point inside a ring: the middle of a run at mid height between two of its corners."""
    heights = sorted({y for _, y in ring})
    low, high = max(zip(heights, heights[1:]), key=lambda ab: ab[1] - ab[0])
    y = (low + high) / 2
    hits = sorted(px + (y - py) * (qx - px) / (qy - py) for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]) if (py > y) != (qy > y))
    return (hits[0] + hits[1]) / 2, y


def overlaid(shapes: Iterable, rule: Rule) -> list:
    """The shape that the rule makes of shapes; parts apart, largest first, holes in the part that holds them."""
    places, edges = border([polygons_of(s) for s in shapes], rule)
    outer, holes = [], []
    for ring in rings_of(places, edges):
        ring = _straightened(ring)
        size = signed_area(ring)
        if abs(size) > CLOSE:
            (outer if size > 0 else holes).append((abs(size), ring))
    outer.sort(key=lambda r: (-r[0], r[1][0]))
    parts = [[ring] for _, ring in outer]
    for _, hole in sorted(holes, key=lambda r: -r[0]):
        x, y = _some_point(hole)
        around = [i for i, (_, ring) in enumerate(outer) if _within(ring, x, y)]
        if around:
            parts[around[-1]].append(hole)  # the smallest that holds it
    return [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]


def overlaid_area(shapes: Iterable, rule: Rule) -> float:
    """Area of what the rule makes of shapes."""
    places, edges = border([polygons_of(s) for s in shapes], rule)
    if not edges:
        return 0.0
    near = places - places[edges[0][0]]
    u, v = near[[e[0] for e in edges]], near[[e[1] for e in edges]]
    return float((u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2)


def repaired(shape: Iterable | None) -> list | None:
    """A shape as it is, if no edges of it cross; else the ground that its rings wind round, as parts that do not cross."""
    return shape if shape is None or not crossing(shape) else overlaid([shape], UNION)


def cut_to_square(shape: Iterable | None, x0: float, y0: float, x1: float, y1: float) -> list:
    """What a shape has in an upright square. Where it has several parts, their rings may hang together along the square's
    edges: there the border runs both ways and adds up to none."""
    out = []
    for polygon in polygons_of(shape):
        rings = []
        for ring in polygon:
            for a, b, c in ((1, 0, x1), (-1, 0, -x0), (0, 1, y1), (0, -1, -y0)):
                ring = clip_half(ring, a, b, c) if len(ring) >= 3 else []
            if len(ring) >= 3 and abs(signed_area(ring)) > 0:
                rings.append([{"x": x, "y": y} for x, y in ring])
        if rings:
            out.append(rings)
    return out


SHAPES_TYPE = T.ArrayType(SHAPE_TYPE)
_arrow = lambda rows: pa.array(rows, to_arrow_type(SHAPE_TYPE))


@F.arrow_udf(SHAPE_TYPE)
def intersection(first: pa.Array, second: pa.Array) -> pa.Array:
    return _arrow([overlaid(pair, INTERSECTION) for pair in zip(first.to_pylist(), second.to_pylist())])


@F.arrow_udf(SHAPE_TYPE)
def union_of(shapes: pa.Array) -> pa.Array:
    return _arrow([overlaid(s or [], UNION) for s in shapes.to_pylist()])


@F.arrow_udf(SHAPE_TYPE)
def repair(shape: pa.Array) -> pa.Array:
    return _arrow([repaired(s) for s in shape.to_pylist()])


@F.arrow_udf(SHAPE_TYPE)
def square_part(shape: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    return _arrow([cut_to_square(*row) for row in zip(*(c.to_pylist() for c in (shape, x0, y0, x1, y1)))])


@F.arrow_udf(T.DoubleType())
def differing_area(parent: pa.Array, children: pa.Array) -> pa.Array:
    return pa.array([overlaid_area([p, *(c or [])], EITHER) for p, c in zip(parent.to_pylist(), children.to_pylist())], pa.float64())


def in_squares(df: DataFrame, step: float) -> DataFrame:
    """df (..., shape) once for each square (gx, gy) of side step that the shape has ground in, its shape cut to the square."""
    b = df.withColumn("_b", bounds(F.col("shape"))).filter(F.size("shape") > 0)
    cell = lambda c: F.floor(F.col(f"_b.{c}") / step)
    b = b.withColumn("gx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("gy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    at = [(F.col(c) + d) * F.lit(float(step)) for c, d in (("gx", 0), ("gy", 0), ("gx", 1), ("gy", 1))]
    return b.withColumn("shape", square_part("shape", *at)).drop("_b").filter(F.size("shape") > 0)


#: Squares are put together 4 by 4, so many times over, before a group's pieces meet.
ROUNDS = 2


def dissolved(shapes: DataFrame, step: float) -> DataFrame:
    """(group_id, shape): the union of each group's shapes (group_id, shape), overlapping or not.

    Squares of side step are dissolved first, each by itself, so a task holds what lies in one square of one group. Neighbouring
    squares are then put together 4 by 4, ROUNDS times, and what is left by group: inner borders go as early as they can,
    and what meets last is little more than the group's own outline.
    """
    pieces = in_squares(shapes.select("group_id", "shape"), step)
    for _ in range(ROUNDS + 1):
        whole = pieces.groupBy("group_id", "gx", "gy").agg(F.collect_list("shape").alias("all"))
        pieces = whole.select("group_id", F.shiftright("gx", 2).alias("gx"), F.shiftright("gy", 2).alias("gy"), union_of("all").alias("shape"))
    return pieces.groupBy("group_id").agg(F.collect_list("shape").alias("all")).select("group_id", union_of("all").alias("shape"))


#: Squares with more pieces than this are cut 4 by 4, so many times over at most.
CROWD, FINER = 32, 6


def _crowds(pieces: DataFrame, side: float) -> DataFrame:
    """(parent_id, gx, gy, n, covered): how many pieces a square of a parent has, and whether one of them is the whole square."""
    ring = F.col("shape")[0][0]
    full = (F.size("shape") == 1) & (F.size(F.col("shape")[0]) == 1) & (F.size(ring) == 4) & (area(F.col("shape")) >= side * side * (1 - 1e-12))
    return pieces.groupBy("parent_id", "gx", "gy").agg(F.count("*").alias("n"), F.max(full).alias("covered"))


def differing_squares(children: DataFrame, parents: DataFrame, step: float, crowd: int = CROWD) -> DataFrame:
    """(parent_id, shape, kids): ground of parents (parent_id, shape) and of children (parent_id, shape), square by square.

    Equal pieces stand once, and a piece that is the whole square stands for all. Squares that still have more than `crowd`
    pieces are cut into smaller ones, so a task puts few shapes together, however many overlap or are alike.
    """
    at = ["parent_id", "gx", "gy"]
    whole, parts = in_squares(parents.select("parent_id", "shape"), step), in_squares(children.select("parent_id", "shape").distinct(), step)
    out = None
    for i in range(FINER + 1):
        side = step / 4**i
        whole, parts = materialize(whole, "sliver-parents"), materialize(parts.select(*at, "shape").distinct(), "sliver-pieces")
        squares = materialize(_crowds(parts, side), "sliver-squares")
        crowded = squares.filter(~F.col("covered") & (F.col("n") > crowd)).select(*at) if i < FINER else squares.select(*at).limit(0)
        corner = [(F.col(c) + d) * F.lit(float(side)) for d in (0, 1) for c in ("gx", "gy")]
        covered = squares.filter("covered").select(*at, F.array(box_shape(*corner)).alias("kids"))
        few = parts.join(squares.filter("NOT covered").select(*at), at, "left_semi").join(crowded, at, "left_anti")
        few = few.groupBy(*at).agg(F.collect_list("shape").alias("kids"))
        both = whole.join(crowded, at, "left_anti").join(covered.unionByName(few), at, "full").select("parent_id", "shape", "kids")
        out = both if out is None else out.unionByName(both)
        if i == FINER or crowded.isEmpty():
            return out
        whole, parts = (in_squares(df.join(crowded, at, "left_semi").select("parent_id", "shape"), side / 4) for df in (whole, parts))


def slivers(children: DataFrame, parents: DataFrame, step: float, smallest: float = 1.0) -> DataFrame:
    """(parent_id, sliver_area) where parents (id, shape) and the union of their children (id, parent_id, shape) differ by more.

    Worked out square by square and summed: children that overlap count their common ground once. Parents without children
    differ by all their area; children of unknown parents are left to the nesting check.
    """
    parents = parents.select(F.col("id").alias("parent_id"), "shape")
    children = children.join(parents.select("parent_id"), "parent_id", "left_semi")
    each = differing_squares(children, parents, step).select("parent_id", differing_area("shape", "kids").alias("area"))
    return each.groupBy("parent_id").agg(F.sum("area").alias("sliver_area")).filter(F.col("sliver_area") > smallest)


def part_areas(shapes: DataFrame) -> DataFrame:
    """(id, part, area) of every polygon of shapes (id, shape)."""
    each = shapes.select("id", F.posexplode("shape").alias("part", "polygon"))
    return each.select("id", "part", area(F.array("polygon")).alias("area"))
