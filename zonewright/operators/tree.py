"""Ward trees over a neighbour graph: distances in Spark, merging of the small matrix on the driver."""

from __future__ import annotations

import heapq
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of a tree: their distance matrix is held on the driver, at 8 bytes a pair.
MOST_POINTS = 5_000


#: So many days of a variable are multiplied together.
DAYS_A_BLOCK = 366


def _apart(block: pa.Table) -> pa.Table:
    """(point_a, point_b, squared_distance) over the days of a block, for all points that have any in common."""
    points, at = np.unique(np.array(block["point_id"].to_pylist(), dtype=object), return_inverse=True)
    days, on = np.unique(block["date"].cast("int32").to_numpy(), return_inverse=True)
    x, have = np.zeros((len(days), len(points))), np.zeros((len(days), len(points)))
    x[on, at], have[on, at] = block["value"].to_numpy(), 1.0
    x = (x - (x.sum(axis=1) / have.sum(axis=1))[:, None]) * have  # a day's mean cancels in differences: the products stay small
    square = (x * x).T @ have
    apart = np.maximum(square + square.T - 2 * (x.T @ x), 0.0)
    i, j = np.nonzero(np.triu(have.T @ have > 0, 1))
    return pa.table([pa.array(points[i], pa.string()), pa.array(points[j], pa.string()), pa.array(apart[i, j])], names=["point_a", "point_b", "squared_distance"])


def squared_distances(scores: DataFrame) -> DataFrame:
    """(point_a, point_b, squared_distance), point_a < point_b, over the common (date, variable) of scores (point_id, date, variable, value).

    |a|^2 + |b|^2 - 2ab by matrix products of DAYS_A_BLOCK days of a variable at a time; a sum for each pair and block moves,
    no pair of readings. Missing values are left out of their pairs; a point has one value for a day and variable.
    """
    have = scores.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("point_id", "variable", F.col("date").cast("date").alias("date"), F.col("value").cast("double").alias("value"))
    block = F.expr(f"unix_date(date) div {DAYS_A_BLOCK}").alias("_block")
    each = have.groupBy("variable", block).applyInArrow(_apart, "point_a string, point_b string, squared_distance double")
    return each.groupBy("point_a", "point_b").agg(F.sum("squared_distance").alias("squared_distance"))


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def ward_merges(points: list[str], distances: dict[tuple[str, str], float] | Pairs, edges: list[tuple[str, str]] | None) -> list[tuple[int, int, float]]:
    """(left, right, height) of each merge, closest first; only neighbours merge (None: any two).

    Lance and Williams' update of squared distances, given by pairs of points or as arrays (places, places, distances); a
    height is the square root. Leaves are 0 to n - 1 in the order of points, merge m makes node n + m, and takes the row of
    one of its sides in a matrix of n by n. Ties go to the smaller nodes. A graph in several parts gives a forest.
    """
    n = len(points)
    if n > MOST_POINTS:
        raise ValueError(f"{n} points; {MOST_POINTS} at most")
    at = {p: i for i, p in enumerate(points)}
    if isinstance(distances, dict):
        known = [(at[p], at[q], v) for (p, q), v in distances.items() if p in at and q in at]
        distances = tuple(np.array(c) for c in zip(*known)) if known else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    a, b, v = distances
    digits = 10.0 ** (11 - np.floor(np.log10(np.maximum(v, 1e-300))))
    matrix = np.zeros((n, n))
    matrix[a, b] = matrix[b, a] = np.where(v > 0, np.round(v * digits) / digits, 0.0)  # twelve digits: sums in another order are equal
    near: dict[int, set[int]] = {i: set() for i in range(n)} if edges is not None else {i: set(range(n)) - {i} for i in range(n)}
    for p, q in edges or ():
        if p in at and q in at and p != q:
            near[at[p]].add(at[q])
            near[at[q]].add(at[p])
    size, row = dict.fromkeys(range(n), 1), {i: i for i in range(n)}  # of the nodes that no merge has taken yet
    heap = [(matrix[i, j], i, j) for i in range(n) for j in near[i] if i < j]
    heapq.heapify(heap)
    merges: list[tuple[int, int, float]] = []
    while heap:
        v, i, j = heapq.heappop(heap)
        if i not in row or j not in row:
            continue
        new, ri, rj = n + len(merges), row.pop(i), row.pop(j)
        merges.append((i, j, math.sqrt(max(0.0, v))))
        others = np.array(list(row.values()), dtype=int)
        if len(others):
            sizes, a, b = np.array([size[o] for o in row]), size[i], size[j]
            matrix[ri, others] = ((a + sizes) * matrix[ri, others] + (b + sizes) * matrix[rj, others] - sizes * v) / (a + b + sizes)
            matrix[others, ri] = matrix[ri, others]
        size[new], row[new] = size.pop(i) + size.pop(j), ri
        near[new] = (near.pop(i) | near.pop(j)) - {i, j}
        for o in near[new]:
            near[o] -= {i, j}
            near[o].add(new)
            heapq.heappush(heap, (matrix[ri, row[o]], o, new))
    return merges


def members(n: int, merges: list[tuple[int, int, float]]) -> list[list[int]]:
    """Leaves of every node."""
    out = [[i] for i in range(n)]
    for left, right, _ in merges:
        out.append(sorted(out[left] + out[right]))
    return out


def cut(points: list[str], merges: list[tuple[int, int, float]], k: int) -> dict[str, str]:
    """point -> cluster after the first n - k merges; a cluster has the name of its smallest point."""
    n = len(points)
    if not n - len(merges) <= k <= n:
        raise ValueError(f"{k} clusters cannot be reached: from {n - len(merges)} to {n} can")
    leaves = members(n, merges)
    label: dict[str, str] = {p: p for p in points}
    for m in range(n - k):
        inside = [points[i] for i in leaves[n + m]]
        label.update(dict.fromkeys(inside, min(inside)))
    return label


def tree_table(spark: SparkSession, points: list[str], merges: list[tuple[int, int, float]]) -> DataFrame:
    """(merge, node, left, right, height, size, cluster, leaf_ids)."""
    n, leaves = len(points), members(len(points), merges)
    rows = [(m, n + m, *sorted((left, right)), float(h), len(leaves[n + m]), min(points[i] for i in leaves[n + m]), sorted(points[i] for i in leaves[n + m])) for m, (left, right, h) in enumerate(merges)]
    return spark.createDataFrame(rows, "merge int, node int, left int, right int, height double, size int, cluster string, leaf_ids array<string>")


def label_table(spark: SparkSession, points: list[str], merges: list[tuple[int, int, float]], cuts: list[int]) -> DataFrame:
    """(k, point_id, cluster)."""
    rows = [(k, p, c) for k in cuts for p, c in sorted(cut(points, merges, k).items())]
    return spark.createDataFrame(rows, "k int, point_id string, cluster string")


def ward_tree(scores: DataFrame, edges: DataFrame | None) -> tuple[list[str], list[tuple[int, int, float]]]:
    """(points, merges) of scores (point_id, date, variable, value) over edges (unit_a, unit_b)."""
    points = sorted(r.point_id for r in scores.select("point_id").distinct().limit(MOST_POINTS + 1).collect())
    if len(points) > MOST_POINTS:  # before any distance comes to the driver
        raise ValueError(f"more than {MOST_POINTS} points")
    pairs = squared_distances(scores).toArrow()  # as columns: at most MOST_POINTS points make them
    place = lambda c: pc.index_in(pairs[c], pa.array(points, pa.string())).to_numpy(zero_copy_only=False).astype(int)
    d = (place("point_a"), place("point_b"), pairs["squared_distance"].to_numpy())
    links = None if edges is None else [(r.unit_a, r.unit_b) for r in edges.select("unit_a", "unit_b").collect()]
    return points, ward_merges(points, d, links)


def inversions(tree: DataFrame) -> DataFrame:
    """(merge, child_merge, height, child_height): merges lower than one they are made of."""
    kids = tree.select(F.col("node").alias("kid"), F.col("merge").alias("child_merge"), F.col("height").alias("child_height"))
    sides = tree.select("merge", "height", F.explode(F.array("left", "right")).alias("kid"))
    return sides.join(kids, "kid").filter("height < child_height").select("merge", "child_merge", "height", "child_height")


def contingency(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b, n) of two labellings (point_id, cluster)."""
    a, b = first.select("point_id", F.col("cluster").alias("a")), second.select("point_id", F.col("cluster").alias("b"))
    return a.join(b, "point_id").groupBy("a", "b").agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row: the adjusted Rand index of a contingency table; 1 where both labellings are trivial alike."""
    two = lambda c: F.sum(c * (c - 1) / 2)
    rows, columns = (table.groupBy(x).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias(f"sum_{x}")) for x in "ab")
    every = table.agg(two(F.col("n")).alias("pairs"), F.sum("n").alias("n"))
    one = every.crossJoin(rows).crossJoin(columns)  # one row each
    expected = F.col("sum_a") * F.col("sum_b") / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("sum_a") + F.col("sum_b")) / 2
    return one.select(F.when(F.coalesce(most - expected, F.lit(0.0)) == 0, F.lit(1.0)).otherwise((F.col("pairs") - expected) / (most - expected)).alias("adjusted_rand"))


def compare(spark: SparkSession, main: DataFrame, other: DataFrame) -> DataFrame:
    """One row (adjusted_rand, differing array<string>): two labellings (point_id, cluster), and where they differ.

    The other's labels are first given the main one's names by the best matching; labels left over differ everywhere.
    """
    table = contingency(main, other)
    names = matched([(r.a, r.b, r.n) for r in table.collect()])
    renamed = other.join(spark.createDataFrame(list(names.items()) or [("", "")], "cluster string, name string"), "cluster", "left")
    both = main.join(renamed.select("point_id", "name"), "point_id")
    off = both.filter(~F.col("cluster").eqNullSafe(F.col("name"))).agg(F.sort_array(F.collect_list("point_id")).alias("differing"))
    return adjusted_rand(table).crossJoin(off)  # one row each


def matched(table: list[tuple[str, str, int]]) -> dict[str, str]:
    """b -> a by the assignment with the most common points; labels left over stay out. Labels are few.

    Shortest augmenting paths over the table of counts.
    """
    rows, columns = sorted({b for _, b, _ in table}), sorted({a for a, _, _ in table})
    n = max(len(rows), len(columns))
    cost = [[0.0] * n for _ in range(n)]
    for a, b, k in table:
        cost[rows.index(b)][columns.index(a)] = -float(k)
    if n <= 6:
        best = min(permutations(range(n)), key=lambda p: (sum(cost[i][p[i]] for i in range(n)), p))
        pairs = list(enumerate(best))
    else:
        pairs = _assignment(cost)
    return {rows[i]: columns[j] for i, j in pairs if i < len(rows) and j < len(columns) and cost[i][j] < 0}


def _assignment(cost: list[list[float]]) -> list[tuple[int, int]]:
    n, of_column = len(cost), [-1] * len(cost)
    u, v = [0.0] * n, [0.0] * n
    for row in range(n):
        slack, back, done, i, j = [math.inf] * n, [-1] * n, [False] * n, row, -1
        while True:
            if j >= 0:
                done[j] = True
                i = of_column[j]
            step, nxt = math.inf, -1
            for c in range(n):
                if not done[c]:
                    gap = cost[i][c] - u[i] - v[c]
                    if gap < slack[c]:
                        slack[c], back[c] = gap, j
                    if slack[c] < step:
                        step, nxt = slack[c], c
            u[row] += step
            for c in range(n):
                if done[c]:
                    u[of_column[c]] += step
                    v[c] -= step
                else:
                    slack[c] -= step
            j = nxt
            if of_column[j] < 0:
                break
        while j >= 0:
            prev = back[j]
            of_column[j] = of_column[prev] if prev >= 0 else row
            j = prev
    return [(of_column[c], c) for c in range(n)]
