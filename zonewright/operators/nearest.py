"""Nearest points, by descending two trees of squares at once.

Places and points are counted in the squares of one grid, halved twice a step. A square of places keeps those squares of
points that can hold one of the k nearest of any place in it, and goes down with them until its places and what it keeps
make few enough pairs for one task. Only squares are joined on the way, so what moves is every place once and every
point as often as there are blocks of places near it, however dense or thin the ground is; pairs are made inside tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from zonewright.functions.storage import materialize
from zonewright.operators import geometry

#: A block of places is done when its pairs are no more than (2 * LEAF ** 2) ** 2, or squares are this many steps down.
LEAF, DEEPEST = 32, 20
#: The first step: so many squares a side are met all with all.
FIRST = 2
#: Distances that a task holds at once.
AT_ONCE = 1 << 20
#: What a block of places is known by.
BLOCK = ("step", "ax", "ay", "part")
#: Cells of up to so many points are made by all of them in one task: its time grows with their square.
IN_TASK = 1_000
#: So many unfinished cells meet the squares that can cut them in one go, in tasks of so many points.
LAST_CELLS, LAST_POINTS = 4_096, 1 << 14


def _at(df: DataFrame) -> DataFrame:
    """Only rows with finite coordinates."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(fine("x") & fine("y"))


def _square(c: str, low: float, side: float) -> Column:
    """Row or column of a coordinate on the finest grid."""
    most = 4**DEEPEST - 1
    return F.least(F.greatest(F.floor((F.col(c) - low) / side), F.lit(0)), F.lit(most)).cast("long")


def _up(step: int, gx: str, gy: str) -> dict[str, Column]:
    """The square of a step that a row's finest square lies in."""
    return {a: F.shiftright(g, 2 * (DEEPEST - step)) for a, g in ((gx, "gx"), (gy, "gy"))}


def _counted(df: DataFrame, step: int, side: str) -> DataFrame:
    """Occupied squares of a step, (<side>x, <side>y), with their number of rows and the bounds of what they hold."""
    keys = _up(step, f"{side}x", f"{side}y")
    ends = [f(c).alias(f"{side}_{c}{n}") for c in ("x", "y") for f, n in ((F.min, 0), (F.max, 1))]
    return df.groupBy(*(k.alias(n) for n, k in keys.items())).agg(F.count("*").alias(f"{side}_n"), *ends)


def _kept(met: DataFrame, k: int) -> DataFrame:
    """(ax, ay, a_n, bx, by, b_n, held, bound): of squares of places (a) and points (b), the pairs that can hold one of a place's k nearest.

    met has the bounds of both squares, and the bound of the squares that they are in (within). held is the number of
    points in all squares that a square of places keeps; every point within bound of it is among them, and all points are
    where bound is null.
    """
    e = lambda n: F.col(n)
    near = [F.greatest(e(f"b_{c}0") - e(f"a_{c}1"), e(f"a_{c}0") - e(f"b_{c}1"), F.lit(0.0)) for c in ("x", "y")]
    far = [F.greatest(e(f"b_{c}1") - e(f"a_{c}0"), e(f"a_{c}1") - e(f"b_{c}0")) for c in ("x", "y")]
    met = met.select("ax", "ay", "a_n", "bx", "by", "b_n", F.hypot(*near).alias("near"), F.hypot(*far).alias("far"), "within")
    met = met.filter(F.col("within").isNull() | (F.col("near") <= F.col("within") * (1 + 1e-9))).drop("within")
    # Squares ordered by their furthest corner: as soon as k points are in, no nearest can be beyond that corner.
    block = Window.partitionBy("ax", "ay")
    upto = F.sum("b_n").over(block.orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = met.withColumn("upto", upto).withColumn("bound", F.min(F.when(F.col("upto") >= k, F.col("far"))).over(block))
    kept = met.filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-9)))
    return kept.withColumn("held", F.sum("b_n").over(block)).select("ax", "ay", "a_n", "bx", "by", "b_n", "held", "bound")


def _squared(*sides: DataFrame) -> list[DataFrame] | None:
    """The sides with each row's finest square (gx, gy) on one grid; None if a side is empty."""
    ends = [df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first() for df in sides]
    if any(e[0] is None for e in ends):
        return None
    x0, y0, x1, y1 = *(min(e[i] for e in ends) for i in (0, 1)), *(max(e[i] for e in ends) for i in (2, 3))
    finest = (max(x1 - x0, y1 - y0) or 1.0) * (1 + 1e-9) / 4**DEEPEST
    return [df.withColumns({"gx": _square("x", x0, finest), "gy": _square("y", y0, finest)}) for df in sides]


def _in_blocks(who: DataFrame, every: DataFrame, k: int, leaf: int, bounds: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """Places (place_id, x, y) and points (x, y, and more) by BLOCK; None if a side is empty. Both are read often: stored tables.

    A block has its places and all points that can be one of their k nearest, x and y of points as px and py. bounds: places
    tell their block's bound, as _kept has it.
    """
    if not (sides := _squared(every, who)):
        return None
    more = [c for c in every.columns if c not in ("x", "y")]
    every, who = sides
    most, few = (2 * leaf**2) ** 2, 4 * leaf * k
    told = ["bound"] if bounds else []
    left = right = None
    met = _counted(who, FIRST, "a").crossJoin(_counted(every, FIRST, "b")).withColumn("within", F.lit(None).cast("double"))  # 16 ** FIRST squares each, at most
    for step in range(FIRST, DEEPEST + 1):
        held = materialize(_kept(met, k).withColumn("parts", F.ceil(F.col("a_n") * F.col("held") / most).cast("int")), "nearest-held")
        ready = (F.col("parts") <= 1) | (F.col("held") <= few) | F.lit(step == DEEPEST)
        n = held.agg(F.count_if(ready).alias("ready"), F.count_if(~ready).alias("open")).first()
        if n["ready"]:
            done = held.filter(ready)
            part = F.pmod(F.xxhash64("place_id", "x", "y"), F.col("parts")).cast("int").alias("part")
            mine = who.withColumns(_up(step, "ax", "ay")).join(done.select("ax", "ay", "parts", *told).distinct(), ["ax", "ay"])
            mine = mine.select(F.lit(step).alias("step"), "ax", "ay", part, "place_id", "x", "y", *told)
            near = every.withColumns(_up(step, "bx", "by")).join(done.select("ax", "ay", "bx", "by", "parts"), ["bx", "by"])
            near = near.select(F.lit(step).alias("step"), "ax", "ay", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *more, F.col("x").alias("px"), F.col("y").alias("py"))
            left, right = (mine, near) if left is None else (left.unionByName(mine), right.unionByName(near))
        if not n["open"]:
            break
        above = held.filter(~ready).select("ax", "ay", "bx", "by", F.col("bound").alias("within")).withColumnsRenamed({c: f"up_{c}" for c in ("ax", "ay", "bx", "by")})
        inside = who.withColumns(_up(step, "up_ax", "up_ay")).join(above.select("up_ax", "up_ay").distinct(), ["up_ax", "up_ay"], "left_semi")
        below = lambda df, s: df.withColumns({f"up_{s}{c}": F.shiftright(f"{s}{c}", 2) for c in ("x", "y")})
        met = above.join(below(_counted(inside, step + 1, "a"), "a"), ["up_ax", "up_ay"]).join(below(_counted(every, step + 1, "b"), "b"), ["up_bx", "up_by"])
    return left, right


def _in_block(k: int):
    """The k nearest of a block's places among the points that it meets; ties to the smaller place in the order of ids."""

    def look(places: pa.Table, points: pa.Table) -> pa.Table:
        of = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(of(points, "nth"))
        px, py, x, y = of(points, "px")[order], of(points, "py")[order], of(places, "x"), of(places, "y")
        rows, cols, far, ranks = [], [], [], []
        some = max(1, AT_ONCE // max(1, len(px)))
        for i in range(0, len(x) if len(px) else 0, some):
            dx, dy = x[i : i + some, None] - px, y[i : i + some, None] - py
            square = dx * dx + dy * dy
            if k < len(px):
                edge = square.min(axis=1) if k == 1 else np.partition(square, k - 1, axis=1)[:, k - 1]
                r, c = np.nonzero(square <= edge[:, None] * (1 + 1e-12))  # roots of unlike squares can be alike
            else:
                r, c = np.nonzero(np.ones(square.shape, dtype=bool))
            m = np.sqrt(square[r, c])
            by = np.lexsort((c, m, r))
            r, c, m = r[by], c[by], m[by]
            rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
            rows.append(r[rank <= k] + i)
            cols.append(order[c[rank <= k]])
            far.append(m[rank <= k])
            ranks.append(rank[rank <= k])
        put = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        pick = lambda t, c, at: t.column(c).combine_chunks().take(pa.array(put(at, np.int64)))
        columns = [pick(places, "place_id", rows), pa.array(put(ranks, np.int32)), pick(points, "point_id", cols), pa.array(put(far, np.float64))]
        return pa.table(columns, names=["place_id", "rank", "point_id", "metres"])

    return look


def nearest_join(places: DataFrame, points: DataFrame, k: int = 1, leaf: int = LEAF) -> DataFrame:
    """(place_id, rank, point_id, metres): the k nearest points of every place, exactly; ties go to the smaller id.

    places (place_id, x, y), points (point_id, x, y). Of points at the very same spot the k smallest ids take part. Rows
    without finite coordinates take no part, on either side; fewer points than k give fewer rows, an empty side none. A
    place_id should stand once.
    """
    at = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    spot = Window.partitionBy("x", "y").orderBy("point_id")
    every = _at(points.select("point_id", *at)).withColumn("same", F.row_number().over(spot)).filter(F.col("same") <= k).drop("same")
    every = materialize(every.orderBy("point_id").withColumn("nth", F.monotonically_increasing_id()), "nearest-points")  # numbers rise with the ids
    who = materialize(_at(places.select("place_id", *at)), "nearest-places")
    kinds = (who.schema["place_id"].dataType, T.IntegerType(), every.schema["point_id"].dataType, T.DoubleType())
    out = T.StructType([T.StructField(c, t) for c, t in zip(("place_id", "rank", "point_id", "metres"), kinds)])
    if not (met := _in_blocks(who, every, k, leaf)):
        return places.sparkSession.createDataFrame([], out)
    left, right = (df.groupBy(*BLOCK) for df in met)
    return left.cogroup(right).applyInArrow(_in_block(k), out)


def nearest_point(places: DataFrame, points: DataFrame) -> DataFrame:
    """(place_id, point_id, metres): the point whose cell a place lies in, that is the nearest; ties to the smaller id."""
    return nearest_join(places, points).drop("rank")


def closest_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (unit_a, unit_b, metres): the closest two of two sets (unit_id, x, y); ties to the smaller ids. No row if a set is empty."""
    each = nearest_join(left.withColumnRenamed("unit_id", "place_id"), right.withColumnRenamed("unit_id", "point_id"))
    best = each.agg(F.min(F.struct("metres", F.col("place_id").alias("unit_a"), F.col("point_id").alias("unit_b"))).alias("best"))
    return best.filter("best IS NOT NULL").select("best.unit_a", "best.unit_b", "best.metres")


def _nearest_first(ring: list[geometry.Point], dx: np.ndarray, dy: np.ndarray) -> list[geometry.Point]:
    """A convex ring round (0, 0), cut by the bisectors with points (dx, dy), nearest first until none can reach it."""
    square = dx * dx + dy * dy
    edge, some = 0.0, min(len(square), LEAF)
    if some < len(square):
        first = np.argpartition(square, some - 1)[:some]
        edge = square[first].max()
    else:
        first = np.arange(len(square))
    for rows in (first, None):
        if rows is None:
            if some == len(square):
                break
            rows = np.flatnonzero((square >= edge) & (square <= reach))
        rows = rows[np.lexsort((dy[rows], dx[rows], square[rows]))]
        reach = 4 * max((p * p + q * q for p, q in ring), default=0.0)
        for d, a, b in zip(square[rows].tolist(), dx[rows].tolist(), dy[rows].tolist()):
            if d > reach:
                return ring
            if a or b:
                ring = geometry.clip_half(ring, a, b, (a * a + b * b) / 2)
                reach = 4 * max((p * p + q * q for p, q in ring), default=0.0)
    return ring


def _shapes(rings: list, xs: list, ys: list) -> pa.Array:
    """Rings round (0, 0) as shapes at their points."""
    return pa.array([[[[{"x": a + x, "y": b + y} for a, b in ring]]] for ring, x, y in zip(rings, xs, ys)], to_arrow_type(geometry.SHAPE_TYPE))


def _cells_in_block(box: list[geometry.Point]):
    """Cells of a block's places as a box cut by the block's points; final are those that no point beyond the block's bound can reach."""

    def look(places: pa.Table, points: pa.Table) -> pa.Table:
        px, py = (points.column(c).to_numpy() for c in ("px", "py"))
        xs, ys, bounds = (places.column(c).to_pylist() for c in ("x", "y", "bound"))
        rings = [_nearest_first([(a - x, b - y) for a, b in box], px - x, py - y) for x, y in zip(xs, ys)]
        final = [b is None or 2 * max((math.hypot(*p) for p in ring), default=0.0) <= b for ring, b in zip(rings, bounds)]
        return pa.table([places.column("place_id"), places.column("x"), places.column("y"), _shapes(rings, xs, ys), pa.array(final, pa.bool_())], names=["point_id", "x", "y", "shape", "final"])

    return look


def _ring_of(shape: list, x: float, y: float) -> list[geometry.Point]:
    """A cell's ring about its own point."""
    return [(c["x"] - x, c["y"] - y) for c in shape[0][0]]


@F.arrow_udf(geometry.SHAPE_TYPE)
def _cut(x: pa.Array, y: pa.Array, shape: pa.Array, cutters: pa.Array) -> pa.Array:
    """Cells of points (x, y), cut by the bisectors with other points (cutters) too."""
    rings, xs, ys = [], x.to_pylist(), y.to_pylist()
    for px, py, cell, others in zip(xs, ys, shape.to_pylist(), cutters.to_pylist()):
        at = np.array([(o["x"] - px, o["y"] - py) for o in others or []], dtype=float).reshape(-1, 2)
        rings.append(_nearest_first(_ring_of(cell, px, py), at[:, 0], at[:, 1]))
    return _shapes(rings, xs, ys)


def _nearer(own: Column | np.ndarray) -> Column | np.ndarray:
    """A point cuts a corner that is own from its cell's point if it is nearer to it than this."""
    return own * (1 - 1e-9) - 1e-6


def _nearer_to_corners(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, cut_by): points that are nearer to a corner of a cell (point_id, x, y, shape) than the cell's own."""
    corners = cells.select("point_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.posexplode(F.flatten(F.flatten("shape"))).alias("nth", "corner"))
    corners = corners.select(F.struct("point_id", "nth").alias("place_id"), "point_id", F.col("corner.x").alias("x"), F.col("corner.y").alias("y"), "ox", "oy")
    found = nearest_join(corners, points).select("place_id", F.col("point_id").alias("cut_by"), "metres")
    own = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return corners.join(found, "place_id").filter(F.col("metres") < _nearer(own)).select("point_id", "cut_by").distinct()


def _cutters_in_square(cells: pa.Table, points: pa.Table) -> pa.Table:
    """(point_id, at): points of a square that cut a cell, one after the other until none does."""
    px, py = (points.column(c).to_numpy() for c in ("px", "py"))
    rows, xs, ys = [], [], []
    for i, (x, y, shape) in enumerate(zip(*(cells.column(c).to_pylist() for c in ("x", "y", "shape")))):
        ring, qx, qy = _ring_of(shape, x, y), px - x, py - y
        while len(qx) and len(ring) > 2:
            v = np.array(ring)
            gain = (_nearer(np.hypot(v[:, 0], v[:, 1])) - np.hypot(qx[:, None] - v[:, 0], qy[:, None] - v[:, 1])).max(axis=1)
            if gain.max() <= 0:
                break
            a, b = float(qx[gain.argmax()]), float(qy[gain.argmax()])
            ring = geometry.clip_half(ring, a, b, (a * a + b * b) / 2)
            rows.append(i)
            xs.append(a + x)
            ys.append(b + y)
            gain[gain.argmax()] = 0
            qx, qy = qx[gain > 0], qy[gain > 0]  # what does not cut a cell does not cut a part of it
    at = pa.StructArray.from_arrays([pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], names=["x", "y"])
    return pa.table([cells.column("point_id").combine_chunks().take(pa.array(rows, pa.int64())), at], names=["point_id", "at"])


def _cutters(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, more): the points that cut cells (point_id, x, y, shape) further, by the squares that a corner's circle through the cell's own point meets."""
    every = _squared(points)[0]
    squares = _counted(every, FIRST, "b").withColumn("parts", F.ceil(F.col("b_n") / LAST_POINTS).cast("int"))
    off = lambda c, v: F.greatest(F.col(f"b_{c}0") - v[c], v[c] - F.col(f"b_{c}1"), F.lit(0.0))
    meets = F.exists(F.col("shape")[0][0], lambda v: F.hypot(off("x", v), off("y", v)) < F.hypot(v["x"] - F.col("x"), v["y"] - F.col("y")))
    asks = cells.crossJoin(F.broadcast(squares)).filter(meets)  # 16 ** FIRST squares, at most
    asks = asks.select("bx", "by", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "point_id", "x", "y", "shape")
    part = F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int").alias("part")
    near = every.withColumns(_up(FIRST, "bx", "by")).join(F.broadcast(squares.select("bx", "by", "parts")), ["bx", "by"])
    near = near.select("bx", "by", part, F.col("x").alias("px"), F.col("y").alias("py"))
    spot = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y")])
    out = T.StructType([T.StructField("point_id", cells.schema["point_id"].dataType), T.StructField("at", spot)])
    block = ("bx", "by", "part")
    found = asks.groupBy(*block).cogroup(near.groupBy(*block)).applyInArrow(_cutters_in_square, out)
    return found.groupBy("point_id").agg(F.collect_list("at").alias("more"))


def cells_by_neighbours(points: DataFrame, start: int = 12, last: int = LAST_CELLS) -> DataFrame:
    """(point_id, shape): Voronoi cells as geometry.voronoi_cells has them, for any number of points (point_id, x, y).

    Spots go to tasks in the blocks of a search for their nearest points. A block has every point within its bound, so a
    cell whose corners are less than half of that away is final: all but those on the rim and beside empty ground. Of
    the others each corner asks for the nearest point: if that is nearer than the cell's own point, it cuts the cell
    further, and new corners ask again; a cell none of whose corners has a nearer point is final, since whatever cuts a
    convex cell takes off a corner. As soon as they are few (last), they meet all that can cut them at once. Points at one
    spot have the same cell; points without finite coordinates have none.
    """
    points = materialize(_at(points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))), "sites")
    spots = materialize(points.groupBy("x", "y").agg(F.min("point_id").alias("point_id"), F.count("*").alias("n")), "spots")
    x0, y0, x1, y1, most = spots.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.max("n")).first()
    if x0 is None:
        return points.select("point_id").withColumn("shape", F.lit(None).cast(geometry.SHAPE))
    margin = math.hypot(x1 - x0, y1 - y0) or 1.0
    box = [(x0 - margin, y0 - margin), (x1 + margin, y0 - margin), (x1 + margin, y1 + margin), (x0 - margin, y1 + margin)]
    at = spots.select("x", "y")
    left, right = (df.groupBy(*BLOCK) for df in _in_blocks(spots.select(F.col("point_id").alias("place_id"), "x", "y"), at, start + 1, LEAF, bounds=True))
    kinds = [*spots.select("point_id", "x", "y").schema.fields, T.StructField("shape", geometry.SHAPE_TYPE), T.StructField("final", T.BooleanType())]
    cells = materialize(left.cogroup(right).applyInArrow(_cells_in_block(box), T.StructType(kinds)), "cells")
    out, open_ = cells.filter("final").select("point_id", "shape"), cells.filter("NOT final").drop("final")
    while n := open_.count():
        if n <= last:
            more = _cutters(open_, at)
            out = out.unionByName(materialize(open_.join(more, "point_id", "left").select("point_id", _cut("x", "y", "shape", "more").alias("shape")), "cells-last"))
            break
        near = _nearer_to_corners(open_, spots.select("point_id", "x", "y")).join(spots.select(F.col("point_id").alias("cut_by"), F.struct("x", "y").alias("at")), "cut_by")
        more = materialize(near.groupBy("point_id").agg(F.collect_list("at").alias("more")), "cells-cutters")
        out = out.unionByName(open_.join(more, "point_id", "left_anti").select("point_id", "shape"))
        open_ = materialize(open_.join(more, "point_id").select("point_id", "x", "y", _cut("x", "y", "shape", "more").alias("shape")), "cells-open")
    if most == 1:
        return out
    return points.join(spots.select("x", "y", F.col("point_id").alias("first")), ["x", "y"]).join(out.withColumnRenamed("point_id", "first"), "first").select("point_id", "shape")


def voronoi_cells(points: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(point_id, shape): by all points in each task, where they are few; by neighbours otherwise. The cells are the same."""
    return geometry.voronoi_cells(points) if points.count() <= in_task else cells_by_neighbours(points)
