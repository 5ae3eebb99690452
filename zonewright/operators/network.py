"""Neighbour graphs: parts, degrees, links, closest pairs, random contiguous maps."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.operators.components import connected_components
from zonewright.operators.nearest import closest_pair


def symmetric(edges: DataFrame, a: str = "unit_a", b: str = "unit_b") -> DataFrame:
    """Both directions of every edge, as (unit_id, near)."""
    there = edges.select(F.col(a).alias("unit_id"), F.col(b).alias("near"))
    return there.unionByName(edges.select(F.col(b).alias("unit_id"), F.col(a).alias("near")))


#: Graphs up to so many edges and units are walked on the driver, larger ones in rounds of joins.
SMALL_GRAPH = 100_000


def _walked(units: list[str], edges: list[tuple[str, str]]) -> dict[str, str]:
    """unit -> the smallest unit of its part."""
    root = {u: u for u in units}

    def find(u: str) -> str:
        while root[u] != u:
            root[u] = u = root[root[u]]
        return u

    for a, b in edges:
        if a in root and b in root:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {u: find(u) for u in units}


def connected_parts(units: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """(unit_id, root) for all units; root is the smallest unit of the part. Edges to units not asked for are ignored."""
    ids = units.select("unit_id")
    few = edges.select("unit_a", "unit_b").limit(small + 1).collect() if small else None
    names = ids.limit(small + 1).collect() if small and len(few) <= small else None
    if names is not None and len(names) <= small:
        roots = _walked([r.unit_id for r in names], [(r.unit_a, r.unit_b) for r in few])
        return units.sparkSession.createDataFrame(sorted(roots.items()), "unit_id string, root string")
    inside = edges.join(ids.select(F.col("unit_id").alias("unit_a")), "unit_a", "left_semi").join(ids.select(F.col("unit_id").alias("unit_b")), "unit_b", "left_semi")
    roots = connected_components(inside.select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b")), "parts")
    return ids.join(roots.withColumnRenamed("node", "unit_id"), "unit_id", "left").select("unit_id", F.coalesce("root", "unit_id").alias("root"))


def parts_within(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_id, root) of the parts within each group; units (unit_id, group_id)."""
    a = units.select(F.col("unit_id").alias("unit_a"), F.col("group_id").alias("ga"))
    b = units.select(F.col("unit_id").alias("unit_b"), F.col("group_id").alias("gb"))
    return connected_parts(units, edges.join(a, "unit_a").join(b, "unit_b").filter("ga = gb"))


def degrees(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_id, degree), 0 for units without an edge."""
    counts = symmetric(edges).groupBy("unit_id").agg(F.count("*").alias("degree"))
    return units.select("unit_id").join(counts, "unit_id", "left").select("unit_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def with_links(edges: DataFrame, units: DataFrame, links: DataFrame, source: str = "manual") -> DataFrame:
    """edges (unit_a, unit_b, shared_edge_metres, source) and links (unit_a, unit_b) that are new and between known units."""
    known = units.select("unit_id")
    tidy = links.select(F.least("unit_a", "unit_b").alias("unit_a"), F.greatest("unit_a", "unit_b").alias("unit_b")).filter("unit_a <> unit_b").distinct()
    tidy = tidy.join(known.withColumnRenamed("unit_id", "unit_a"), "unit_a", "left_semi").join(known.withColumnRenamed("unit_id", "unit_b"), "unit_b", "left_semi")
    fresh = tidy.join(edges, ["unit_a", "unit_b"], "left_anti")
    return edges.unionByName(fresh.select("unit_a", "unit_b", F.lit(0.0).alias("shared_edge_metres"), F.lit(source).alias("source")))


def join_nearest(edges: DataFrame, points: DataFrame) -> DataFrame:
    """edges with a link from the largest part to the closest other point, again and again until all is one part.

    points (unit_id, x, y). A round for each part: parts are few, the rows stay in Spark.
    """
    while True:
        parts = connected_parts(points, edges).join(points, "unit_id")
        sizes = parts.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(2).collect()
        if len(sizes) < 2:
            return edges
        main = F.col("root") == F.lit(sizes[0]["root"])
        pair = closest_pair(parts.filter(main), parts.filter(~main))
        edges = with_links(edges, points, pair.select("unit_a", "unit_b"), "join_nearest")


def random_partition(units: list[str], near: dict[str, list[str]], k: int, rng: np.random.Generator) -> dict[str, int]:
    """k connected regions grown from k seeds, a random region by a random free neighbour at a time."""
    seeds = [units[i] for i in rng.choice(len(units), k, replace=False)]
    region = {u: i for i, u in enumerate(seeds)}
    live = list(range(k))
    members: list[list[str]] = [[s] for s in seeds]
    while len(region) < len(units):
        if not live:
            raise ValueError("the graph is not connected: regions cannot reach every unit")
        r = live[int(rng.choice(len(live)))]
        free = sorted({n for u in members[r] for n in near.get(u, ()) if n not in region})
        if not free:
            live.remove(r)
            continue
        u = free[int(rng.integers(len(free)))]
        region[u] = r
        members[r].append(u)
    return region


def random_maps(spark: SparkSession, units: list[str], edges: list[tuple[str, str]], k: int, draws: int, seed: int) -> DataFrame:
    """(draw, unit_id, group_id) of random contiguous maps.

    One generator serves all draws, so they are made in order on the driver; the units are the areas of a map, few by
    nature. What is scored on them runs in Spark for all draws at once.
    """
    near: dict[str, list[str]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    rng = np.random.default_rng(seed)
    rows = [(d, u, f"R{r}") for d in range(draws) for u, r in sorted(random_partition(sorted(units), near, k, rng).items())]
    return spark.createDataFrame(rows, "draw int, unit_id string, group_id string")


def parts_of_groups(groups: dict[str, str], edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """group -> how many parts its units are in; the units are the areas of a map."""
    inside = [(a, b) for a, b, _ in edges if a in groups and groups[a] == groups.get(b)]
    roots = _walked(sorted(groups), inside)
    out: dict[str, set[str]] = {}
    for u, g in groups.items():
        out.setdefault(g, set()).add(roots[u])
    return {g: len(r) for g, r in out.items()}


def repair(groups: dict[str, str], edges: list[tuple[str, str, float]], rounds: int = 20) -> tuple[dict[str, str], list[tuple[str, str, str, float]]]:
    """Move stranded units to the neighbouring group with the longest border, until none is stranded; (groups, moves).

    In a round units go in order of id, each seeing the moves before it. The units are the areas of a map.
    """
    groups, moves = dict(groups), []
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, metres in edges:
        near.setdefault(a, []).append((b, metres))
        near.setdefault(b, []).append((a, metres))

    def parts(name: str) -> list[list[str]]:
        left, out = {u for u, g in groups.items() if g == name}, []
        while left:
            queue, part = [min(left)], []
            left.discard(queue[0])
            while queue:
                u = heapq.heappop(queue)
                part.append(u)
                for v, _ in near.get(u, ()):
                    if v in left:
                        left.discard(v)
                        heapq.heappush(queue, v)
            out.append(sorted(part))
        return sorted(out, key=lambda p: (-len(p), p[0]))

    for _ in range(rounds):
        lost = sorted(u for g in set(groups.values()) for p in parts(g)[1:] for u in p)
        moved = False
        for u in lost:
            border: dict[str, float] = {}
            for v, metres in near.get(u, ()):
                if v in groups and groups[v] != groups[u]:
                    border[groups[v]] = border.get(groups[v], 0.0) + metres
            if border:
                best = max(border, key=lambda g: (border[g], g))
                moves.append((u, groups[u], best, border[best]))
                groups[u], moved = best, True
        if not moved:
            break
    return groups, moves
