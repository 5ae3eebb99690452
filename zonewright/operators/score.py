"""Judging a map: variance explained, ceilings, correlations, random maps, misfits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.stats import TINY, correlation


def eta_squared(series: DataFrame, groups: DataFrame, by: tuple[str, ...] = ("date", "variable"), unit: str = "unit_id", group: str = "group_id") -> DataFrame:
    """(by, eta_squared): the share of the variance between units that lies between their groups; null where there is none.

    series has unit, by and value; groups has unit and group. Two levels of sums: units to groups, groups to the whole.
    Means and squares are merged as Spark's variance does, without the cancellation of plain sums of squares.
    """
    keys = list(by)
    joined = series.filter(F.col("value").isNotNull()).join(groups, unit)
    parts = joined.groupBy(*keys, group).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    both = parts.join(whole, keys)
    away = F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))
    sums = both.groupBy(*keys).agg(F.sum(away).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    total = F.col("between") + F.col("within")
    return sums.select(*keys, (F.col("between") / F.when(total > TINY, total)).alias("eta_squared"))


def mean_eta(etas: DataFrame, by: tuple[str, ...] = ("variable",)) -> DataFrame:
    """(by, eta_squared): the mean over days; days without variance are left out."""
    return etas.groupBy(*by).agg(F.avg("eta_squared").alias("eta_squared"))


def unit_series(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(unit_id, date, variable, value): weighted sums of the points' scores; weights (unit_id, point_id, weight)."""
    joined = scores.join(weights, "point_id")
    return joined.groupBy("unit_id", "date", "variable").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def share_weights(areas: DataFrame) -> DataFrame:
    """(unit_id, point_id, weight) from areas (unit_id, point_id, area): a unit's weights add up to 1."""
    total = areas.groupBy("unit_id").agg(F.sum("area").alias("total"))
    return areas.join(total, "unit_id").select("unit_id", "point_id", (F.col("area") / F.when(F.col("total") != 0, F.col("total")).otherwise(1.0)).alias("weight"))


#: Days of a variable that are multiplied together.
DAYS_A_BLOCK = 366


def _together(block: pa.Table) -> pa.Table:
    """(variable, unit_a, unit_b, n, sums and products) of each two units over the days of a block that both have."""
    units, at = np.unique(np.array(block["unit_id"].to_pylist(), dtype=object), return_inverse=True)
    days, on = np.unique(block["date"].cast("int32").to_numpy(), return_inverse=True)
    x, have = np.zeros((len(days), len(units))), np.zeros((len(days), len(units)))
    x[on, at], have[on, at] = block["value"].to_numpy(), 1.0
    n, sx, sxx, sxy = have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x
    i, j = np.nonzero(np.triu(n > 0, 1))
    name = pa.array([block["variable"][0].as_py()] * len(i), pa.string())
    sums = [n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]]
    return pa.table([name, pa.array(units[i], pa.string()), pa.array(units[j], pa.string()), *map(pa.array, sums)], names=["variable", "unit_a", "unit_b", "n", "sx", "sy", "sxx", "syy", "sxy"])


def pair_correlations(series: DataFrame) -> DataFrame:
    """(variable, unit_a, unit_b, correlation) of each two units over their common dates; null where either side is constant.

    By matrix products of DAYS_A_BLOCK days of a variable at a time, on departures from each unit's own mean, which keep the
    sums small: no pair of values moves, only six sums for each pair and block. A unit has one value for a day and variable.
    """
    have = series.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("unit_id", "variable", F.col("date").cast("date").alias("date"), F.col("value").cast("double").alias("value"))
    means = have.groupBy("unit_id", "variable").agg(F.avg("value").alias("mean"))
    off = have.join(means, ["unit_id", "variable"]).select("unit_id", "variable", "date", (F.col("value") - F.col("mean")).alias("value"))
    block = F.expr(f"unix_date(date) div {DAYS_A_BLOCK}").alias("_block")
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    each = off.groupBy("variable", block).applyInArrow(_together, "variable string, unit_a string, unit_b string, " + ", ".join(f"{c} double" for c in names))
    total = each.groupBy("variable", "unit_a", "unit_b").agg(*[F.sum(c).alias(c) for c in names])
    spread = lambda s, ss: F.sqrt(F.greatest(F.col(ss) / F.col("n") - (F.col(s) / F.col("n")) ** 2, F.lit(0.0)))
    scale = spread("sx", "sxx") * spread("sy", "syy")
    covariance = F.col("sxy") / F.col("n") - F.col("sx") * F.col("sy") / (F.col("n") * F.col("n"))
    return total.select("variable", "unit_a", "unit_b", (covariance / F.when(scale > TINY, scale)).alias("correlation"))


def within_between(correlations: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: the mean correlation of pairs in one group, and of pairs across; null without such pairs."""
    a = groups.select(F.col("unit_id").alias("unit_a"), F.col("group_id").alias("group_a"))
    b = groups.select(F.col("unit_id").alias("unit_b"), F.col("group_id").alias("group_b"))
    same = F.col("group_a") == F.col("group_b")
    return correlations.join(a, "unit_a").join(b, "unit_b").agg(F.avg(F.when(same, F.col("correlation"))).alias("within"), F.avg(F.when(~same, F.col("correlation"))).alias("between"))


def distinct_maps(maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(draws (draw, form), forms (form, unit_id, group_id)): maps that split the units alike have one form, whatever the names.

    A form is a hash of every unit with the smallest unit of its group, summed over the units in any order.
    """
    first = maps.groupBy("draw", "group_id").agg(F.min("unit_id").alias("first"))
    named = maps.join(first, ["draw", "group_id"]).select("draw", "unit_id", F.col("first").alias("group_id"))
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "unit_id", "group_id").cast("decimal(38,0)")).cast("string")
    draws = named.groupBy("draw").agg(F.concat_ws("/", part(1), part(2)).alias("form"))
    one = draws.groupBy("form").agg(F.min("draw").alias("draw"))
    return draws, named.join(one, "draw").select("form", "unit_id", "group_id")


def map_scores(series: DataFrame, maps: DataFrame) -> DataFrame:
    """(draw, variable, eta_squared) of many maps (draw, unit_id, group_id) at once: one plan for all, each form once."""
    draws, forms = distinct_maps(maps)
    etas = eta_squared(series, forms, by=("form", "date", "variable"))
    scores = etas.groupBy("form", "variable").agg(F.avg("eta_squared").alias("eta_squared"))
    return draws.join(scores, "form").select("draw", "variable", "eta_squared")


def spread(scores: DataFrame, column: str = "eta_squared", by: tuple[str, ...] = ("variable",)) -> DataFrame:
    """(by, minimum, median, maximum, mean)."""
    return scores.groupBy(*by).agg(F.min(column).alias("minimum"), F.median(column).alias("median"), F.max(column).alias("maximum"), F.avg(column).alias("mean"))


def placing(scores: Column, own: Column) -> Column:
    """Percent of draws that score no more than a map does, as an aggregate; both rounded to 6 places first."""
    return F.round(100 * F.avg((F.round(scores, 6) <= F.round(own, 6)).cast("int")), 3)


def misfits(areas: DataFrame, parents: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_id, own_group, best_group, own_score, best_score, misfit) of small areas against groups of their parents.

    areas (unit_id, date, variable, value), parents (unit_id, parent_id), groups (parent_id, group_id), edges
    (parent_a, parent_b). An area is compared with its own group and those of its parent's neighbours, by the mean
    over variables of its correlation with the mean of the group's areas; areas of its own parent are left out. Areas
    without a score for their own group and one other have no row. Ties go to the largest name.
    """
    both = edges.select("parent_a", "parent_b").unionByName(edges.select(F.col("parent_b").alias("parent_a"), F.col("parent_a").alias("parent_b")))
    near = both.join(groups.select(F.col("parent_id").alias("parent_b"), "group_id"), "parent_b").select(F.col("parent_a").alias("parent_id"), "group_id")
    rivals = near.unionByName(groups.select("parent_id", "group_id")).distinct()
    placed = areas.join(parents, "unit_id").join(groups, "parent_id")
    sums = placed.groupBy("group_id", "date", "variable").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    own_sums = placed.groupBy("parent_id", "group_id", "date", "variable").agg(F.sum("value").alias("own_s"), F.count("value").alias("own_n"))
    others = rivals.join(sums, "group_id").join(own_sums, ["parent_id", "group_id", "date", "variable"], "left")
    n = F.col("n") - F.coalesce("own_n", F.lit(0))
    others = others.select("parent_id", "group_id", "date", "variable", ((F.col("s") - F.coalesce("own_s", F.lit(0.0))) / F.when(n > 0, n)).alias("mean"))
    pairs = areas.join(parents, "unit_id").join(others, ["parent_id", "date", "variable"])
    each = pairs.groupBy("unit_id", "parent_id", "group_id", "variable").agg(correlation(F.col("value"), F.col("mean")).alias("c"))
    scored = each.groupBy("unit_id", "parent_id", "group_id").agg(F.avg("c").alias("score")).filter(F.col("score").isNotNull())
    own = groups.select("parent_id", F.col("group_id").alias("own_group"))
    tally = scored.join(own, "parent_id").groupBy("unit_id", "own_group").agg(
        F.max(F.struct(F.round("score", 9).alias("score"), "group_id")).alias("best"),
        F.max(F.when(F.col("group_id") == F.col("own_group"), F.round("score", 9))).alias("own_score"),
        F.count("*").alias("n"),
    )
    out = tally.filter((F.col("n") >= 2) & F.col("own_score").isNotNull())
    return out.select("unit_id", "own_group", F.col("best.group_id").alias("best_group"), "own_score", F.col("best.score").alias("best_score"), (F.col("best.group_id") != F.col("own_group")).alias("misfit"))
