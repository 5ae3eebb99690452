"""The whole run: layers and points to a graph, weather to scores, scores to clusters, clusters to a new map, judged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.operators import allocate, anomaly, geometry, nearest, network, overlay, score, tree


class NestingError(ValueError):
    """Layers do not nest: an area's parent is unknown, or not where it lies."""


class DisconnectedError(ValueError):
    """The neighbour graph is in several parts, and nothing says what to do about it."""


class MissingDataError(ValueError):
    """Readings are missing, and nothing says what to do about it."""


class DemandError(ValueError):
    """Areas lack demand on held-out days."""


Notice = Callable[[str], None]
#: Areas of a map, their borders and cuts are few; more than so many rows of them do not come to the driver.
MOST_ROWS = 200_000


def silent(text: str) -> None:
    """For runs without a record."""


def few(df: DataFrame, what: str) -> list:
    """The rows of a table that is small by nature, which is checked."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} {what}: too many for one map")
    return rows


def named(rows: list, most: int = 10) -> str:
    """The first ids of rows, and how many more there are."""
    return ", ".join(str(r[0]) for r in rows[:most]) + (f" and {len(rows) - most} more" if len(rows) > most else "")


@dataclass(frozen=True)
class Settings:
    """Choices of a run; problems() lists all that is wrong with them at once."""

    build_start: str | None = None
    build_end: str = "2024-08-31"
    held_out_start: str = "2024-09-01"
    held_out_end: str = "2025-08-31"
    neighbour_rule: str = "rook"
    least_edge_metres: float = 1.0
    disconnected_parts: str = "stop"
    manual_links: tuple[tuple[str, str], ...] = ()
    log1p: tuple[str, ...] = ("rain",)
    smoothing_days: int = 31
    weighted_national_mean: bool = False
    missing_data: str = "stop"
    number_of_regions: int = 2
    cuts_to_save: tuple[int, ...] = (2,)
    contiguity_repair: bool = True
    random_partitions: int = 500
    seed: int = 20260921
    grid_step: float = 25_000.0
    unconstrained_diagnostic: bool = True
    sensitivity_sets: tuple[tuple[str, tuple[str, ...]], ...] = (("temperature_only", ("tmin", "tmax")), ("all_variables", ("tmin", "tmax", "rain", "wind")))

    def problems(self) -> list[str]:
        out = []
        choices = {"neighbour_rule": ("rook", "queen"), "disconnected_parts": ("stop", "join_nearest", "fixed_regions"), "missing_data": ("stop", "drop_day", "fill_from_neighbours")}
        out += [f"{name} must be one of {', '.join(of)}" for name, of in choices.items() if getattr(self, name) not in of]
        if self.smoothing_days < 1 or self.smoothing_days % 2 == 0:
            out.append("smoothing_days must be odd and at least 1")
        if self.number_of_regions < 1 or any(k < 1 for k in self.cuts_to_save):
            out.append("numbers of regions must be at least 1")
        days = [d for d in (self.build_start, self.build_end, self.held_out_start, self.held_out_end) if d is not None]
        if days != sorted(days) or self.build_end >= self.held_out_start:
            out.append("windows must follow each other: build, then held out")
        return out


def check_nesting(children: DataFrame, parents: DataFrame, step: float, least_share: float = 0.999) -> list[str]:
    """What is wrong with children (id, parent_id, shape) in parents (id, shape), in order of id: unknown parents first. One job."""
    shares = geometry.area_shares(children.select("id", "shape"), parents.select("id", "shape"), step)
    best = allocate.majority(shares.select(F.col("child_id").alias("unit_id"), F.col("parent_id").alias("cluster"), F.round("share", 9).alias("share")))
    known = parents.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    placed = children.select(F.col("id").alias("unit_id"), "parent_id").join(best, "unit_id", "left").join(known, "parent_id", "left")
    fine = F.col("known") & (F.col("majority_share") >= least_share) & (F.col("parent_id") == F.col("majority_cluster"))
    wrong = few(placed.filter(~F.coalesce(fine, F.lit(False))).orderBy("unit_id"), "units that do not nest")
    out = [f"{r.unit_id} names {r.parent_id}, which is not there" for r in wrong if not r.known]
    for r in wrong:
        if r.majority_cluster is None:
            out.append(f"{r.unit_id} lies in no parent")
        elif r.majority_share < least_share:
            out.append(f"{r.unit_id} straddles: {r.majority_share:.4f} of it lies in {r.majority_cluster}")
        elif r.parent_id is not None and r.parent_id != r.majority_cluster:
            out.append(f"{r.unit_id} names {r.parent_id} but lies in {r.majority_cluster}")
    return out


def geometry_checks(layers: dict[str, DataFrame], step: float) -> DataFrame:
    """(layer, units, multi_part, crossing, slivers, not_contiguous) of the layers ra, pga and nca, one row each."""
    out = None
    below = {"nca": "pga", "pga": "ra"}
    for name, layer in layers.items():
        shape = F.col("shape")
        counts = layer.agg(F.count("*").alias("units"), F.count_if(geometry.part_count(shape) > 1).alias("multi_part"), F.count_if(geometry.crosses_itself(shape)).alias("crossing"))
        row = counts.withColumn("layer", F.lit(name))
        if kid := below.get(name):
            kids = layers[kid]
            n = overlay.slivers(kids.select("id", "parent_id", "shape"), layer.select("id", "shape"), step).agg(F.count("*").alias("slivers"))
            units = kids.select(F.col("id").alias("unit_id"), F.col("parent_id").alias("group_id"))
            parts = network.parts_within(units, geometry.adjacency(kids.select("id", "shape"), step)).join(units, "unit_id")
            split = parts.groupBy("group_id").agg(F.countDistinct("root").alias("n")).agg(F.count_if(F.col("n") > 1).alias("not_contiguous"))
            row = row.crossJoin(n).crossJoin(split)  # one row each
        else:
            row = row.withColumn("slivers", F.lit(0).cast("long")).withColumn("not_contiguous", F.lit(0).cast("long"))
        row = row.select("layer", "units", "multi_part", "crossing", "slivers", "not_contiguous")
        out = row if out is None else out.unionByName(row)
    return out


def clipped_cells(cells: DataFrame, land: DataFrame, step: float) -> DataFrame:
    """(point_id, shape): each cell's part of the land, its pieces in the units of land put together; cells that have none are left out."""
    pairs = geometry.near_pairs(cells.select(F.col("point_id").alias("id"), "shape"), land.select("id", "shape"), step)
    pieces = pairs.select(F.col("left_id").alias("point_id"), "right_id", overlay.intersection("left_shape", "right_shape").alias("part")).filter(F.size("part") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("right_id", "part")))
    return pieces.groupBy("point_id").agg(F.transform(ordered, lambda s: s["part"]).alias("parts")).select("point_id", overlay.union_of("parts").alias("shape"))


def build_graph(points: DataFrame, land: DataFrame, settings: Settings, notice: Notice = silent) -> tuple[DataFrame, DataFrame]:
    """(cells, edges): cells (point_id, shape, inside_outline) of the points that have land; edges (unit_a, unit_b, shared_edge_metres, source).

    A point itself may lie off the land, or on its border, while its cell has some: inside_outline tells.
    """
    within = geometry.points_within(points, land, settings.grid_step).select("point_id").distinct().withColumn("inside", F.lit(True))
    cells = clipped_cells(nearest.voronoi_cells(points), land, settings.grid_step).join(within, "point_id", "left")
    cells = materialize(cells.select("point_id", "shape", F.coalesce("inside", F.lit(False)).alias("inside_outline")), "cells")
    shapes = cells.select(F.col("point_id").alias("id"), "shape")
    edges = geometry.adjacency(shapes, settings.grid_step, settings.neighbour_rule, settings.least_edge_metres).withColumn("source", F.lit("computed"))
    kept = cells.select(F.col("point_id").alias("unit_id"))
    if settings.manual_links:
        links = points.sparkSession.createDataFrame(list(settings.manual_links), "unit_a string, unit_b string")
        linked = network.with_links(edges, kept, links)
        if notice is not silent:
            _notice_links(links, edges, kept, notice)
        edges = linked
    edges = materialize(edges, "edges")
    if notice is not silent:
        if gone := few(points.select("point_id").join(cells, "point_id", "left_anti").orderBy("point_id"), "points"):
            notice(f"dropped {len(gone)} point(s) whose cells have no land: {named(gone)}")
        if off := few(cells.filter("NOT inside_outline").select("point_id").orderBy("point_id"), "points"):
            notice(f"{len(off)} point(s) lie outside the outline, though their cells have land: {named(off)}")
    if network.connected_parts(kept, edges).select("root").distinct().count() > 1:
        if settings.disconnected_parts == "stop":
            raise DisconnectedError("the neighbour graph is in several parts; link them or choose join_nearest")
        if settings.disconnected_parts == "fixed_regions":  # every part has a tree of its own
            notice("the neighbour graph is in several parts, and each has a tree of its own")
            return cells, edges
        edges = materialize(network.join_nearest(edges, points.join(kept, F.col("point_id") == F.col("unit_id")).select("unit_id", "x", "y")), "edges")
        for r in few(edges.filter("source = 'join_nearest'").orderBy("unit_a", "unit_b"), "links"):
            notice(f"linked {r.unit_a} and {r.unit_b}, the closest of two parts")
    return cells, edges


def _notice_links(links: DataFrame, edges: DataFrame, kept: DataFrame, notice: Notice) -> None:
    """Which of the links asked for are not made, and why."""
    a, b = (kept.select(F.col("unit_id").alias(c), F.lit(True).alias(f"has_{c}")) for c in ("unit_a", "unit_b"))
    tidy = links.select(F.least("unit_a", "unit_b").alias("unit_a"), F.greatest("unit_a", "unit_b").alias("unit_b"))
    known = edges.select("unit_a", "unit_b", F.lit(True).alias("there"))
    for r in few(tidy.join(a, "unit_a", "left").join(b, "unit_b", "left").join(known, ["unit_a", "unit_b"], "left").orderBy("unit_a", "unit_b"), "links"):
        if not (r.has_unit_a and r.has_unit_b):
            notice(f"skipped the link of {r.unit_a} and {r.unit_b}: not both are in the graph")
        elif r.there:
            notice(f"skipped the link of {r.unit_a} and {r.unit_b}: they are neighbours already")


def _some(missing: DataFrame) -> str:
    """The first ten of (point_id, variable, date), and how many more there are."""
    first, n = missing.orderBy("variable", "date", "point_id").limit(10).collect(), missing.count()
    return ", ".join(f"{r.point_id} {r.variable} {r.date}" for r in first) + (f" and {n - 10} more" if n > 10 else "")


def build_scores(weather: DataFrame, cells: DataFrame, edges: DataFrame, settings: Settings, notice: Notice = silent) -> dict[str, DataFrame]:
    """anomalies (point_id, date, variable, window, regional_anomaly, z_score) and the parameters they come from."""
    readings = weather.join(cells.select("point_id"), "point_id", "left_semi")
    missing = materialize(anomaly.holes(readings, cells), "missing")
    if not missing.isEmpty():
        if settings.missing_data == "stop":
            raise MissingDataError("missing: " + _some(missing))
        if settings.missing_data == "drop_day":
            readings = anomaly.without_days(readings, missing)
            days = few(missing.select(F.col("date").cast("string")).distinct().orderBy("date"), "days")
            notice(f"dropped {len(days)} date(s) at every point and variable because a reading was missing: {named(days)}")
        else:
            links = edges.select(F.col("unit_a").alias("point_a"), F.col("unit_b").alias("point_b"))
            fills = materialize(anomaly.neighbour_fills(readings, missing, links), "fills")
            left = missing.join(fills, ["point_id", "variable", "date"], "left_anti")
            if not left.isEmpty():
                raise MissingDataError("no neighbour has a value for: " + _some(left))
            if notice is not silent:
                n, first = fills.count(), fills.orderBy("variable", "date", "point_id").limit(10).collect()
                notice(f"filled {n} reading(s): " + ", ".join(f"{r.point_id} {r.variable} on {r.date} from the mean of {r.neighbours} neighbour(s)" for r in first))
            readings = materialize(anomaly.with_fills(readings, fills), "filled")
    readings = materialize(anomaly.transformed(readings, settings.log1p), "readings")
    weights = cells.select("point_id", geometry.area(F.col("shape")).alias("weight")) if settings.weighted_national_mean else None
    normals = materialize(anomaly.seasonal_normals(anomaly.in_window(readings, settings.build_start, settings.build_end), settings.smoothing_days), "normals")
    regional = materialize(anomaly.regional_anomaly(anomaly.seasonal_anomaly(readings, normals), weights), "regional")
    parameters = materialize(anomaly.build_parameters(anomaly.in_window(regional, settings.build_start, settings.build_end), refuse_flat=True), "parameters")
    scored = anomaly.z_scores(regional, parameters).withColumn("window", anomaly.window_label(settings.build_end))
    return {"anomalies": materialize(scored, "scores"), "parameters": anomaly.parameter_table(normals, parameters)}


def cluster(scores: DataFrame, edges: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """tree, labels (k, point_id, cluster) and inversions, from build days alone."""
    build = scores.filter("window = 'build'").select("point_id", "date", "variable", F.col("z_score").alias("value"))
    points, merges = tree.ward_tree(build, edges)
    spark = scores.sparkSession
    cuts = sorted({*settings.cuts_to_save, settings.number_of_regions})
    table = tree.tree_table(spark, points, merges)
    return {"tree": table, "labels": tree.label_table(spark, points, merges, cuts), "inversions": tree.inversions(table)}


def sensitivity(scores: DataFrame, edges: DataFrame, main: DataFrame, subsets: dict[str, tuple[str, ...]], k: int, free: bool = True) -> DataFrame:
    """(run, adjusted_rand, differing): clusters from subsets of the variables, and without the graph, against main (point_id, cluster)."""
    spark, out = scores.sparkSession, None
    build = scores.filter("window = 'build'").select("point_id", "date", "variable", F.col("z_score").alias("value"))
    runs = {name: (build.filter(F.col("variable").isin(*keep)), edges) for name, keep in subsets.items()}
    runs |= {"unconstrained": (build, None)} if free else {}
    for name, (values, links) in runs.items():
        points, merges = tree.ward_tree(values, links)
        labels = tree.label_table(spark, points, merges, [k]).select("point_id", "cluster")
        row = tree.compare(spark, main, labels).withColumn("run", F.lit(name)).select("run", "adjusted_rand", "differing")
        out = row if out is None else out.unionByName(row)
    return out


def beats(eta: DataFrame, ceiling: DataFrame) -> DataFrame:
    """(variable, current, new, gain, share_of_ceiling) from scores rounded to six places."""
    side = lambda n: F.round(F.max(F.when(F.col("map") == n, F.col("eta_squared"))), 6).alias(n)
    wide = eta.groupBy("variable").agg(side("current"), side("new"))
    top = ceiling.select("variable", F.round("eta_squared", 6).alias("top"))
    gain = F.round(F.col("new") - F.col("current"), 6).alias("gain")
    return wide.join(top, "variable", "left").select("variable", "current", "new", gain, F.round(F.col("new") / F.when(F.col("top") > 0, F.col("top")), 6).alias("share_of_ceiling"))


def fragments_of(units: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """(unit_id, point_id, area): what each cell has of each unit; serves every cut and every weight."""
    shares = geometry.area_shares(units.select("id", "shape"), cells.select(F.col("point_id").alias("id"), "shape"), step)
    return shares.select(F.col("child_id").alias("unit_id"), F.col("parent_id").alias("point_id"), "area")


def map_areas(pga: DataFrame, cells: DataFrame, labels: DataFrame, settings: Settings, notice: Notice = silent) -> dict[str, DataFrame]:
    """Every saved cut as a map of whole areas, repaired: assignments, regions, outlines and moves at the number of regions, and all cuts side by side.

    Shares of all cuts come from one pass; areas, borders and cuts are few, and the repair walks them in order on the driver.
    """
    spark, step = pga.sparkSession, settings.grid_step
    fragments = materialize(fragments_of(pga, cells, step), "pga-fragments")
    best = few(allocate.majority_by_cut(fragments, labels).orderBy("k", "unit_id"), "areas")
    borders = [(r.unit_a, r.unit_b, r.shared_edge_metres) for r in few(geometry.adjacency(pga.select("id", "shape"), step), "borders")]
    clusters: dict[int, set[str]] = {}
    for r in few(labels.select("k", "cluster").distinct(), "clusters"):
        clusters.setdefault(r.k, set()).add(r.cluster)
    placed, moved, cuts = [], [], []
    for k in sorted({r.k for r in best}):
        at_k = [r for r in best if r.k == k]
        groups, moves = {r.unit_id: f"NCA-{r.majority_cluster}" for r in at_k}, []
        if settings.contiguity_repair:
            groups, moves = network.repair(groups, borders)
        unused = sorted(clusters[k] - {g.removeprefix("NCA-") for g in groups.values()})
        for c in unused:
            notice(f"at k = {k}, cluster {c} wins no area, so it is not on the map")
        for unit, a, b, metres in moves:
            notice(f"at k = {k}, moved {unit} from {a} to {b}, with which it shares {metres:.0f} m of border")
        straddle = [r.straddle_score for r in at_k]
        whole = all(n == 1 for n in network.parts_of_groups(groups, borders).values())
        cuts.append((k, len(set(groups.values())), whole, max(straddle), sum(straddle) / len(straddle), len(moves), unused))
        placed += [(k, r.unit_id, groups[r.unit_id], r.majority_cluster, r.majority_share, r.straddle_score) for r in at_k]
        moved += [(k, *m) for m in moves]
    every = spark.createDataFrame(placed, "k int, unit_id string, group_id string, majority_cluster string, majority_share double, straddle_score double")
    every_move = spark.createDataFrame(moved, "k int, unit_id string, from_group string, to_group string, shared_edge_metres double")
    touching = spark.createDataFrame(borders, "unit_a string, unit_b string, shared_edge_metres double")
    main = F.col("k") == settings.number_of_regions
    assignments = every.filter(main).drop("k")
    shapes = pga.select(F.col("id").alias("unit_id"), "shape").join(assignments.select("unit_id", "group_id"), "unit_id").select("group_id", "shape")
    outlines = overlay.dissolved(shapes, step)
    return {
        "fragments": fragments,
        "assignments": assignments,
        "regions": materialize(allocate.region_summary(assignments, network.parts_within(assignments.select("unit_id", "group_id"), touching)), "regions"),
        "outlines": outlines.withColumns({"area": geometry.area(F.col("shape")), "parts": geometry.part_count(F.col("shape"))}),
        "moves": every_move.filter(main).drop("k"),
        "borders": touching,
        "cut_assignments": every,
        "cut_moves": every_move,
        "cuts": spark.createDataFrame(cuts, "k int, regions int, contiguous boolean, highest_straddle double, mean_straddle double, moves int, clusters_without_area array<string>"),
    }


def evaluate(scores: DataFrame, cells: DataFrame, layers: dict[str, DataFrame], mapped: dict[str, DataFrame], labels: DataFrame, demand: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """eta (map, variable, eta_squared), ceiling, variance_explained, correlations, benchmark and misfits, on held-out days."""
    held = scores.filter(F.col("window") == "held_out")
    held = anomaly.in_window(held, settings.held_out_start, settings.held_out_end).select("point_id", "date", "variable", F.col("z_score").alias("value"))
    step = settings.grid_step
    pga_series = materialize(score.unit_series(held, score.share_weights(mapped["fragments"])), "pga-series")
    ra_series = materialize(score.unit_series(held, score.share_weights(fragments_of(layers["ra"], cells, step))), "ra-series")
    own = anomaly.in_window(demand, settings.held_out_start, settings.held_out_end).select(F.col("pga_id").alias("unit_id"), "date", F.lit("demand").alias("variable"), F.col("demand").alias("value"))
    days = held.select("date").distinct()
    have = own.filter(F.col("value").isNotNull()).join(days, "date", "left_semi").groupBy("unit_id").agg(F.countDistinct("date").alias("n"))
    units = layers["pga"].select(F.col("id").alias("unit_id")).join(have, "unit_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = units.join(F.broadcast(days.agg(F.count("*").alias("days"))), F.col("n") < F.col("days")).orderBy("unit_id")  # one row a unit
    if lacking := few(short, "areas"):
        raise DemandError("demand is missing: " + ", ".join(f"{r.unit_id} on {r.days - r.n} days" for r in lacking[:10]) + (f" and {len(lacking) - 10} more" if len(lacking) > 10 else ""))
    both = pga_series.unionByName(own)
    current = layers["pga"].select(F.col("id").alias("unit_id"), F.col("parent_id").alias("group_id"))
    new = mapped["assignments"].select("unit_id", "group_id")
    maps = {"current": current, "new": new}
    tagged = lambda f: [f(m).withColumn("map", F.lit(n)) for n, m in maps.items()]
    union = lambda xs: xs[0].unionByName(xs[1])
    eta = union(tagged(lambda m: score.mean_eta(score.eta_squared(both, m))))
    parent = layers["ra"].select(F.col("id").alias("unit_id"), F.col("parent_id").alias("group_id"))
    at_points = labels.filter(F.col("k") == settings.number_of_regions).select(F.col("point_id").alias("unit_id"), F.col("cluster").alias("group_id"))
    pairs = score.pair_correlations(pga_series)
    edges = mapped["borders"].select(F.col("unit_a").alias("parent_a"), F.col("unit_b").alias("parent_b"))
    as_parent = lambda m: m.select(F.col("unit_id").alias("parent_id"), "group_id")
    parents = parent.withColumnRenamed("group_id", "parent_id")
    out = {
        "eta": eta,
        "ceiling": score.mean_eta(score.eta_squared(ra_series, parent)),
        "variance_explained": score.mean_eta(score.eta_squared(held.withColumnRenamed("point_id", "unit_id"), at_points)),
        "correlations": union(tagged(lambda m: score.within_between(pairs, m))),
        "misfits": union(tagged(lambda m: score.misfits(ra_series, parents, as_parent(m), edges))),
    }
    if settings.random_partitions:
        units = sorted(r.unit_id for r in few(current, "areas"))
        links = [(r.unit_a, r.unit_b) for r in few(mapped["borders"], "borders")]
        draws = network.random_maps(cells.sparkSession, units, links, new.select("group_id").distinct().count(), settings.random_partitions, settings.seed)
        out["benchmark"] = score.map_scores(both, draws)
    return out


def measures(judged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What follows from the judged tables: weather_means, and of random maps their spread and the placings of the two maps among them.

    A mean over the weather's variables, demand left out, is a variable of its own, weather_mean.
    """
    mean = lambda df, *by: df.filter("variable <> 'demand'").groupBy(*by).agg(F.avg("eta_squared").alias("eta_squared"))
    eta = mean(judged["eta"], "map").select(F.concat(F.lit("eta_"), "map").alias("measure"), "eta_squared")
    rest = [mean(judged[name]).select(F.lit(name).alias("measure"), "eta_squared") for name in ("ceiling", "variance_explained")]
    out = {"weather_means": eta.unionByName(rest[0]).unionByName(rest[1])}
    if "benchmark" in judged:
        whole = lambda df, by: df.select(by, "variable", "eta_squared").unionByName(mean(df, by).select(by, F.lit("weather_mean").alias("variable"), "eta_squared"))
        draws = whole(judged["benchmark"], "draw")
        own = whole(judged["eta"], "map").withColumnRenamed("eta_squared", "own")
        out["spread"] = score.spread(draws)
        out["placings"] = draws.join(own, "variable").groupBy("map", "variable").agg(F.max("own").alias("eta_squared"), score.placing(F.col("eta_squared"), F.col("own")).alias("percentile"))
    return out


def covered(layers: dict[str, DataFrame], step: float, notice: Notice = silent) -> dict[str, DataFrame]:
    """The layers, with parents worked out by overlay for areas that name none."""
    out = dict(layers)
    orphans = [out[c].filter("parent_id IS NULL").select(F.lit(c).alias("layer")) for c in ("pga", "ra")]
    counts = {r["layer"]: r["count"] for r in orphans[0].unionByName(orphans[1]).groupBy("layer").count().collect()}
    for child, parent in (("ra", "pga"), ("pga", "nca")):
        if n := counts.get(child, 0):
            notice(f"{n} unit(s) of {child} name no parent; they go to the {parent} that covers most of them")
            shares = geometry.area_shares(out[child].filter("parent_id IS NULL").select("id", "shape"), out[parent].select("id", "shape"), step)
            out[child] = materialize(allocate.with_parents(out[child], shares), f"{child}-parents")
    return out


def run(spark: SparkSession, points: DataFrame, layers: dict[str, DataFrame], weather: DataFrame, demand: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """All stages. points (point_id, x, y), layers ra, pga, nca, long weather and demand; the tables of every stage.

    Demand goes to evaluate() alone, after the clusters and the map stand.
    """
    if problems := settings.problems():
        raise ValueError("; ".join(problems))
    layers = covered(layers, settings.grid_step)
    wrong = check_nesting(layers["ra"], layers["pga"], settings.grid_step) + check_nesting(layers["pga"], layers["nca"], settings.grid_step)
    if wrong:
        raise NestingError("; ".join(wrong))
    cells, edges = build_graph(points, layers["ra"], settings)
    scored = build_scores(weather, cells, edges, settings)
    clustered = cluster(scored["anomalies"], edges, settings)
    mapped = map_areas(layers["pga"], cells, clustered["labels"], settings)
    judged = evaluate(scored["anomalies"], cells, layers, mapped, clustered["labels"], demand, settings)
    return {"cells": cells, "edges": edges, **scored, **clustered, **mapped, **judged, **measures(judged)}
