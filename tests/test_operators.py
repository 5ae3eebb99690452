import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewright.functions.calendar import calendar_slot
from zonewright.operators import allocate, anomaly, geometry, network, score, tree


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return [[ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


ELL = [[ring((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))]]
HOLED = [[box(0, 0, 4, 4)[0][0], box(1, 1, 3, 3)[0][0]]]


def test_calendar_slots(spark):
    days = ["2024-02-28", "2024-02-29", "2024-03-01", "2023-12-31", "2024-12-31", "2023-01-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(calendar_slot(F.col("d").cast("date")).alias("s"))
    assert [r.s for r in df.collect()] == [59, 59, 60, 365, 365, 1]


def test_a_spike_wraps_round_the_year(spark):
    rows = [("p", "v", s, 31.0 if s == 1 else 0.0) for s in range(1, 366)]
    df = spark.createDataFrame(rows, "point_id string, variable string, slot int, normal double")
    got = {r.slot: r.normal for r in anomaly.smoothed(df, 31).collect()}
    assert abs(sum(got.values()) - 31) < 1e-9 and abs(got[365] - 1) < 1e-9 and abs(got[351] - 1) < 1e-9 and abs(got[350]) < 1e-9 and abs(got[16] - 1) < 1e-9
    assert {r.slot: r.normal for r in anomaly.smoothed(df, 1).collect()} == {s: v for _, _, s, v in rows}
    with pytest.raises(ValueError):
        anomaly.smoothed(df, 30)


def test_interpolation_is_flat_at_the_ends(spark):
    df = spark.createDataFrame([("p", "v", 10, 1.0), ("p", "v", 20, 3.0)], "point_id string, variable string, slot int, normal double")
    got = {r.slot: r.normal for r in anomaly.interpolated(df).collect()}
    assert got[1] == 1.0 and got[15] == 2.0 and got[365] == 3.0 and len(got) == 365


def test_flat_series_are_refused(spark):
    df = spark.createDataFrame([("p", "v", 1.0)] * 3, "point_id string, variable string, regional_anomaly double")
    with pytest.raises(anomaly.FlatSeriesError, match="p v"):
        anomaly.build_parameters(df, refuse_flat=True)


@pytest.mark.parametrize(("a", "b", "area"), [(ELL, box(0, 0, 2, 2), 3), (ELL, box(1, 1, 2, 2), 0), (ELL, box(0.5, 0.5, 1.5, 1.5), 0.75), (HOLED, box(0, 0, 2, 2), 3), (box(4e5, 4e5, 4e5 + 2, 4e5 + 2), box(4e5 + 1, 4e5 + 1, 4e5 + 9, 4e5 + 9), 1), (box(0, 0, 1, 1) + box(5, 5, 6, 6), box(0, 0, 9, 9), 2), (None, box(0, 0, 1, 1), 0)])
def test_overlap(a, b, area):
    assert abs(geometry.overlap(a, b) - area) < 1e-9 and abs(geometry.overlap(b, a) - area) < 1e-9


@pytest.mark.parametrize(("a", "b", "edge"), [(box(0, 0, 10, 10), box(10, 0, 20, 20), (10, True)), (box(0, 0, 10, 10), box(10, 10, 20, 20), (0, True)), (box(0, 0, 10, 10), box(5, 5, 15, 15), (0, True)), (box(0, 0, 10, 10), box(30, 0, 40, 10), (0, False)), (box(0, 0, 10, 10), box(10, 2, 20, 5), (3, True))])
def test_shared_edges(a, b, edge):
    metres, touch = geometry.shared_edge(a, b)
    assert (round(metres, 6), touch) == edge


def test_shape_columns(spark):
    df = spark.createDataFrame([("ell", ELL), ("holed", HOLED), ("two", box(0, 0, 1, 1) + box(5, 5, 7, 6)), ("none", None), ("empty", [])], f"id string, shape {geometry.SHAPE}")
    got = {r.id: (r.a, r.n) for r in df.select("id", geometry.area(F.col("shape")).alias("a"), geometry.part_count(F.col("shape")).alias("n")).collect()}
    assert got == {"ell": (3.0, 1), "holed": (12.0, 1), "two": (3.0, 2), "none": (None, 0), "empty": (0.0, 0)}


def test_adjacency_rules(spark):
    df = spark.createDataFrame([("a", box(0, 0, 10, 10)), ("b", box(10, 10, 20, 20)), ("c", box(10, 0, 20, 10))], f"id string, shape {geometry.SHAPE}")
    rook = {(r.unit_a, r.unit_b) for r in geometry.adjacency(df, 7.0).collect()}
    assert rook == {("a", "c"), ("b", "c")}
    assert geometry.adjacency(df, 7.0, "queen").count() == 3


def test_cells_tile_the_widened_box_and_hold_their_points(spark):
    rng = np.random.default_rng(2)
    pts = [(f"p{i:02d}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((30, 2)) * 1000)]
    df = spark.createDataFrame(pts, "point_id string, x double, y double")
    cells = {r.point_id: r.shape for r in geometry.voronoi_cells(df).collect()}
    xs, ys = [p[1] for p in pts], [p[2] for p in pts]
    m = math.hypot(max(xs) - min(xs), max(ys) - min(ys))
    total = (max(xs) - min(xs) + 2 * m) * (max(ys) - min(ys) + 2 * m)
    assert abs(sum(geometry.overlap(c, c) for c in cells.values()) - total) < 1e-6 * total
    for name, x, y in pts:
        assert geometry.overlap(cells[name], box(x - 1e-3, y - 1e-3, x + 1e-3, y + 1e-3)) > 0


def test_projection_of_known_points(spark):
    known = [("P01", 52.5977924, -2.0014331, 400_000, 300_000), ("P16", 53.2667013, -0.8769688, 475_000, 375_000), ("P17", 52.0353236, 0.331156, 560_000, 240_000)]
    df = spark.createDataFrame([k[:3] for k in known], "point_id string, latitude double, longitude double")
    got = {r.point_id: (r.x, r.y) for r in geometry.to_national_grid(df).collect()}
    for name, _, _, e, n in known:
        assert abs(got[name][0] - e) < 0.05 and abs(got[name][1] - n) < 0.05


def test_eta_against_sums_of_squares(spark):
    """Random values in random groups, against the two sums of squares worked out plainly."""
    rng = np.random.default_rng(21)
    names = [f"z{i}" for i in range(31)]
    values, groups = rng.normal(size=31).round(3), rng.integers(4, size=31)
    s = spark.createDataFrame(list(zip(names, map(float, values))), "unit_id string, value double").withColumns({"date": F.lit(1), "variable": F.lit("v")})
    of = lambda g: spark.createDataFrame([(n, str(x)) for n, x in zip(names, g)], "unit_id string, group_id string")
    between = sum((groups == g).sum() * (values[groups == g].mean() - values.mean()) ** 2 for g in set(groups))
    want = between / ((values - values.mean()) ** 2).sum()
    assert abs(score.eta_squared(s, of(groups)).first().eta_squared - want) < 1e-9
    assert abs(score.eta_squared(s, of(range(31))).first().eta_squared - 1) < 1e-9
    assert score.eta_squared(s.withColumn("value", F.lit(0.5)), of(groups)).first().eta_squared is None


def lattice(rng, rows, cols, share):
    """Names and borders of a lattice with some borders left out."""
    names = [f"q{i:03d}" for i in range(rows * cols)]
    pairs = [(names[i], names[j]) for i in range(rows * cols) for j in (i + 1, i + cols) if j < rows * cols and (j != i + 1 or j % cols)]
    return names, [p for p in pairs if rng.random() < share]


def parts_of(names, pairs):
    """Name -> smallest name that it reaches, by spreading the smaller one until nothing changes."""
    root = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_parts_against_spreading(spark):
    names, pairs = lattice(np.random.default_rng(5), 7, 6, 0.45)
    units = spark.createDataFrame([(u,) for u in names], "unit_id string")
    edges = spark.createDataFrame([*pairs, (names[-1], "outside")], "unit_a string, unit_b string")
    want = parts_of(names, pairs)
    assert 3 < len(set(want.values())) < len(names)
    for small in (network.SMALL_GRAPH, 0):  # on the driver, and in rounds of joins
        assert {r.unit_id: r.root for r in network.connected_parts(units, edges, small).collect()} == want


def test_repair_leaves_no_group_in_parts():
    """Random groups on a whole lattice: every move is to a group next door, and groups that can be are whole afterwards."""
    rng = np.random.default_rng(11)
    names, pairs = lattice(rng, 5, 5, 1.1)
    lengths = [(a, b, float(rng.integers(1, 900))) for a, b in pairs]
    start = {n: "WE"[int(i % 5 > 2)] for i, n in enumerate(names)} | {names[4]: "W", names[20]: "E"}
    groups, moves = network.repair(start, lengths)
    inside = [(a, b) for a, b, _ in lengths if groups[a] == groups[b]]
    root = parts_of(names, inside)
    assert all(len({root[n] for n in names if groups[n] == g}) == 1 for g in set(groups.values()))
    assert {m[0] for m in moves} == {n for n in names if groups[n] != start[n]} == {names[4], names[20]}
    assert network.repair(groups, lengths) == (groups, [])


@pytest.mark.parametrize("k", [1, 4, 9])
def test_random_maps_are_whole(k):
    names, pairs = lattice(np.random.default_rng(2), 6, 4, 1.1)
    near = {u: sorted({b for a, b in pairs if a == u} | {a for a, b in pairs if b == u}) for u in names}
    rng = np.random.default_rng(3)
    for _ in range(30):
        regions = network.random_partition(names, near, k, rng)
        root = parts_of(names, [(a, b) for a, b in pairs if regions[a] == regions[b]])
        assert regions.keys() == set(names) and len(set(root.values())) == len(set(regions.values())) == k


def test_cuts_and_inversions(spark):
    """A cut undoes the last merges, whatever they are; inversions against a look at every pair of merges."""
    rng = np.random.default_rng(8)
    names = [f"s{i}" for i in range(9)]
    alive, merges = list(range(9)), []
    while len(alive) > 1:
        a, b = sorted(rng.choice(alive, 2, replace=False).tolist())
        alive = [x for x in alive if x not in (a, b)] + [9 + len(merges)]
        merges.append((a, b, float(rng.integers(1, 20))))
    for k in (1, 3, 9):
        held = {i: [names[i]] for i in range(9)}
        for m, (a, b, _) in enumerate(merges[: 9 - k]):
            held[9 + m] = held.pop(a) + held.pop(b)
        assert tree.cut(names, merges, k) == {n: min(g) for g in held.values() for n in g}
    with pytest.raises(ValueError):
        tree.cut(names, merges[:5], 2)
    want = sorted((m, c - 9) for m, (a, b, h) in enumerate(merges) for c in (a, b) if c >= 9 and h < merges[c - 9][2])
    assert want and sorted((r.merge, r.child_merge) for r in tree.inversions(tree.tree_table(spark, names, merges)).collect()) == want


def test_more_points_than_the_driver_holds_are_refused_first(spark, monkeypatch):
    monkeypatch.setattr(tree, "MOST_POINTS", 3)
    monkeypatch.setattr(tree, "squared_distances", lambda _: pytest.fail("distances were asked for"))
    with pytest.raises(ValueError, match="more than 3"):
        tree.ward_tree(spark.createDataFrame([(f"p{i}",) for i in range(5)], "point_id string"), None)


def test_parents_by_overlay(spark):
    kids = spark.createDataFrame([("a", None, 1), ("b", "Q", 2), ("c", None, 3)], "id string, parent_id string, shape int")
    shares = spark.createDataFrame([("a", "P", 0.6), ("a", "Q", 0.4), ("b", "P", 1.0), ("c", "Q", 0.5), ("c", "P", 0.5)], "child_id string, parent_id string, share double")
    assert {r.id: r.parent_id for r in allocate.with_parents(kids, shares).collect()} == {"a": "P", "b": "Q", "c": "P"}


def test_ward_against_centroids():
    """Lance and Williams' update against distances between centroids worked out anew at every merge."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((14, 5))
    names = [f"p{i:02d}" for i in range(14)]
    d = {(names[i], names[j]): float(((x[i] - x[j]) ** 2).sum()) for i in range(14) for j in range(i)}
    merges = tree.ward_merges(names, d, None)
    groups = {i: [i] for i in range(14)}
    for m, (a, b, h) in enumerate(merges):
        cost = {}
        for p in groups:
            for q in groups:
                if p < q:
                    gap = x[groups[p]].mean(0) - x[groups[q]].mean(0)
                    na, nb = len(groups[p]), len(groups[q])
                    cost[p, q] = 2 * na * nb / (na + nb) * float(gap @ gap)
        best = min(cost.values())
        assert abs(cost[min(a, b), max(a, b)] - best) < 1e-9 and abs(h - math.sqrt(best)) < 1e-9
        groups[14 + m] = groups.pop(a) + groups.pop(b)


def test_matching_of_labels():
    assert tree.matched([("x", "p", 5), ("y", "p", 1), ("y", "q", 4), ("z", "r", 1)]) == {"p": "x", "q": "y", "r": "z"}
    rng = np.random.default_rng(3)
    for _ in range(20):
        cost = rng.integers(0, 9, (5, 5)).astype(float).tolist()
        from itertools import permutations

        best = min(sum(cost[i][p[i]] for i in range(5)) for p in permutations(range(5)))
        assert sum(cost[i][j] for i, j in tree._assignment(cost)) == best


def test_majority_takes_the_smaller_name_of_equals(spark):
    shares = spark.createDataFrame([("u", "b", 0.5), ("u", "a", 0.5), ("v", "a", 0.2), ("v", "b", 0.8)], "unit_id string, cluster string, share double")
    rows = {r.unit_id: (r.majority_cluster, round(r.straddle_score, 9)) for r in allocate.majority(shares).collect()}
    assert rows == {"u": ("a", 0.5), "v": ("b", 0.2)}


def test_shapes_of_unequal_rings_pass_through_spark(spark):
    odd = HOLED + [[ring((9, 0), (12, 0), (10, 5))]]
    df = spark.createDataFrame([("a", odd), ("b", box(0, 0, 20, 20))], f"id string, shape {geometry.SHAPE}")
    got = {(r.child_id, r.parent_id): r.area for r in geometry.area_shares(df, df, 5.0).collect()}
    assert abs(got["a", "b"] - 19.5) < 1e-9 and abs(got["a", "a"] - 19.5) < 1e-9
    row = df.filter("id = 'a'").select(geometry.mend("shape").alias("shape"), geometry.representative_point("shape").alias("p"), geometry.crosses_itself("shape").alias("x")).first()
    assert len(row["shape"]) == 2 and not row.x and geometry.inside(odd, row.p.x, row.p.y)
    assert df.select(geometry.contains("shape", F.lit(2.0), F.lit(2.0)).alias("c"), "id").filter("c").collect()[0].id == "b"


def test_maps_of_one_form_are_scored_once(spark):
    maps = [(0, "a", "x"), (0, "b", "x"), (0, "c", "y"), (1, "a", "q"), (1, "b", "q"), (1, "c", "p"), (2, "a", "x"), (2, "b", "y"), (2, "c", "y")]
    df = spark.createDataFrame(maps, "draw int, unit_id string, group_id string")
    draws, forms = score.distinct_maps(df)
    form = {r.draw: r.form for r in draws.collect()}
    assert form[0] == form[1] != form[2] and forms.count() == 6
    series = spark.createDataFrame([(u, d, "v", float(ord(u) * d % 5)) for u in "abc" for d in range(9)], "unit_id string, date int, variable string, value double")
    got = {r.draw: r.eta_squared for r in score.map_scores(series, df).collect()}
    each = {d: score.mean_eta(score.eta_squared(series, df.filter(F.col("draw") == d).drop("draw"))).first().eta_squared for d in range(3)}
    assert all(abs(got[d] - each[d]) < 1e-12 for d in each)
