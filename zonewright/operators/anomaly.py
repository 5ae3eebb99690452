"""Seasonally adjusted, nationally centred scores of long series (point_id, date, variable, value).

Every function takes and returns DataFrames in long form. Parameters come from build days alone: callers filter the
build window first, so nothing of the held-out days can reach them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.calendar import calendar_slot
from zonewright.functions.stats import TINY, no_nan
from zonewright.functions.storage import materialize

SLOTS = 365
KEYS = ["point_id", "variable"]


class FlatSeriesError(ValueError):
    """A series without any spread in the build window has no z-score."""


def in_window(readings: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends included; None leaves a side open. The filter reaches a Parquet scan."""
    if start is not None:
        readings = readings.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        readings = readings.filter(F.col("date") <= F.lit(end).cast("date"))
    return readings


def with_slots(readings: DataFrame) -> DataFrame:
    return readings.withColumn("slot", calendar_slot(F.col("date")))


def transformed(readings: DataFrame, log1p: tuple[str, ...] = ("rain",)) -> DataFrame:
    """log(1 + x) for the named variables, others as they are."""
    value = no_nan(F.col("value"))
    return readings.withColumn("value", F.when(F.col("variable").isin(*log1p), F.log1p(value)).otherwise(value))


def slot_normals(build: DataFrame) -> DataFrame:
    """(point_id, variable, slot, normal): the mean of each calendar slot over the build days."""
    return with_slots(build).groupBy(*KEYS, "slot").agg(F.avg("value").alias("normal"))


def interpolated(normals: DataFrame) -> DataFrame:
    """All 365 slots of each series: empty ones between their neighbours on a line, at the ends as the nearest."""
    series = normals.select(*KEYS).distinct()
    grid = series.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(SLOTS))))
    full = grid.join(normals.filter(F.col("normal").isNotNull()), [*KEYS, "slot"], "left")
    order = Window.partitionBy(*KEYS).orderBy("slot")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("normal").isNotNull(), F.col("slot"))
    full = full.select(
        *KEYS,
        "slot",
        "normal",
        F.last("normal", ignorenulls=True).over(back).alias("v0"),
        F.last(at, ignorenulls=True).over(back).alias("s0"),
        F.first("normal", ignorenulls=True).over(ahead).alias("v1"),
        F.first(at, ignorenulls=True).over(ahead).alias("s1"),
    )
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("slot") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    inside = F.col("s0").isNotNull() & F.col("s1").isNotNull() & (F.col("s1") > F.col("s0"))
    return full.select(*KEYS, "slot", F.coalesce("normal", F.when(inside, line), "v0", "v1").alias("normal"))


def smoothed(normals: DataFrame, window: int = 31) -> DataFrame:
    """Moving average of an odd number of slots, round the year's end; a window of 1 changes nothing."""
    if window % 2 != 1 or not 1 <= window <= 2 * SLOTS + 1:
        raise ValueError(f"smoothing must be odd and from 1 to {2 * SLOTS + 1}, not {window}")
    half = window // 2
    turns = F.array(*[F.col("slot") + F.lit(k * SLOTS) for k in ((-1, 0, 1) if half else (0,))])
    wide = normals.withColumn("place", F.explode(turns))
    span = Window.partitionBy(*KEYS).orderBy("place").rowsBetween(-half, half)
    return wide.withColumn("normal", F.avg("normal").over(span)).filter(F.col("place").between(1, SLOTS)).select(*KEYS, "slot", "normal")


def seasonal_normals(build: DataFrame, window: int = 31) -> DataFrame:
    return smoothed(interpolated(slot_normals(build)), window)


def seasonal_anomaly(readings: DataFrame, normals: DataFrame) -> DataFrame:
    """The value less its slot's normal. Readings without a normal (a point unknown to the build window) go."""
    joined = with_slots(readings).join(normals, [*KEYS, "slot"])
    return joined.withColumn("anomaly", F.col("value") - F.col("normal")).drop("normal", "slot", "value")


def national_means(anomalies: DataFrame, weights: DataFrame | None = None, column: str = "anomaly") -> DataFrame:
    """(date, variable, national): the day's mean over points, plain or by weights (point_id, weight)."""
    by = ["date", "variable"]
    if weights is None:
        return anomalies.groupBy(*by).agg(F.avg(column).alias("national"))
    w = F.when(F.col(column).isNotNull(), F.col("weight"))
    total = F.sum(w)
    return anomalies.join(weights, "point_id").groupBy(*by).agg((F.sum(w * F.col(column)) / F.when(total != 0, total)).alias("national"))


def regional_anomaly(anomalies: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Less the day's national mean: one sum for each day moves, not the day's points."""
    joined = anomalies.join(national_means(anomalies, weights), ["date", "variable"])
    return joined.withColumn("regional_anomaly", F.col("anomaly") - F.col("national")).drop("national", "anomaly")


def build_parameters(build: DataFrame, refuse_flat: bool = False) -> DataFrame:
    """(point_id, variable, build_mean, build_std) of regional anomalies; the deviation is the population's."""
    out = build.groupBy(*KEYS).agg(F.avg("regional_anomaly").alias("build_mean"), F.stddev_pop("regional_anomaly").alias("build_std"))
    if refuse_flat and (flat := out.filter(F.col("build_std") <= TINY).orderBy(*KEYS).limit(10).collect()):
        raise FlatSeriesError("no spread in the build window: " + ", ".join(f"{r.point_id} {r.variable}" for r in flat))
    return out


def z_scores(anomalies: DataFrame, parameters: DataFrame) -> DataFrame:
    """By stored parameters; null where the build window is flat."""
    spread = F.when(F.col("build_std") > TINY, F.col("build_std"))
    joined = anomalies.join(parameters, KEYS)
    return joined.withColumn("z_score", (F.col("regional_anomaly") - F.col("build_mean")) / spread).drop("build_mean", "build_std")


def window_label(build_end: str):
    return F.when(F.col("date") <= F.lit(build_end).cast("date"), "build").otherwise("held_out")


def parameter_table(normals: DataFrame, parameters: DataFrame) -> DataFrame:
    """(point_id, variable, parameter, day_of_year, value): the stored parameters in one long table."""
    named = [("build_mean", "build_mean"), ("build_standard_deviation", "build_std")]
    rest = [parameters.select(*KEYS, F.lit(n).alias("parameter"), F.lit(0).alias("day_of_year"), F.col(c).alias("value")) for n, c in named]
    out = normals.select(*KEYS, F.lit("seasonal_normal").alias("parameter"), F.col("slot").alias("day_of_year"), F.col("normal").alias("value"))
    for x in rest:
        out = out.unionByName(x)
    return out


def holes(readings: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, variable, date) that have no value, over all dates and variables of the readings and all points.

    Each series is summed up first: how many values it has, and the sum of its dates' hashes. Only series that differ in that
    from the calendar are laid out day by day and compared, so whole series never move.
    """
    sums = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.xxhash64("date").cast("decimal(38)")).alias("marks"))
    have = readings.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("point_id", "variable", "date")
    calendar = materialize(readings.groupBy("date").agg(F.collect_set("variable").alias("names")), "calendar")  # a row a day
    dates, names = calendar.select("date"), F.array_distinct(F.flatten(F.collect_list(F.array_sort("names"))))
    whole = calendar.agg(F.count("*").alias("n"), F.sum(F.xxhash64("date").cast("decimal(38)")).alias("marks"), F.min("date").alias("first"), F.max("date").alias("last"), names.alias("names")).first()
    if not whole["n"]:
        return have.limit(0)
    every = points.select("point_id").distinct().withColumn("variable", F.explode(F.array(*map(F.lit, sorted(whole["names"])))))
    full = sums(have, "point_id", "variable").filter((F.col("n") == whole["n"]) & (F.col("marks") == F.lit(whole["marks"])))
    short = every.join(full, ["point_id", "variable"], "left_anti")
    first, last = whole["first"], whole["last"]
    days = short.withColumn("date", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(dates, "date", "left_semi")
    return days.join(have, ["point_id", "variable", "date"], "left_anti").select("point_id", "variable", "date")


def without_days(readings: DataFrame, bad: DataFrame) -> DataFrame:
    """Drop every reading of a date that bad has, of all points and variables."""
    return readings.join(bad.select("date").distinct(), "date", "left_anti")


def _in_turn(day: pa.Table) -> pa.Table:
    """The holes of a variable on a day in order of point: each the mean of its neighbours' values, earlier fills among them."""
    rows = sorted(zip(*(day[c].to_pylist() for c in ("point_id", "total", "n", "feeders"))))
    filled: dict[str, float] = {}
    used = []
    for point, total, n, feeders in rows:
        fed = [filled[f] for f in feeders if f in filled]
        if n + len(fed):
            filled[point] = ((total or 0.0) + sum(fed)) / (n + len(fed))
            used.append(n + len(fed))
    same = lambda c: pa.array([day[c][0].as_py()] * len(filled), day.schema.field(c).type)
    return pa.table([pa.array(list(filled), pa.string()), same("variable"), same("date"), pa.array(list(filled.values()), pa.float64()), pa.array(used, pa.int64())], names=["point_id", "variable", "date", "value", "neighbours"])


def neighbour_fills(readings: DataFrame, missing: DataFrame, edges: DataFrame) -> DataFrame:
    """(point_id, variable, date, value, neighbours): what the missing readings get from neighbours (point_a, point_b).

    On a day, the points of a variable are filled in order of their ids, each by the mean of what its neighbours have by
    then: a value filled earlier counts like a reading, one still missing does not. A point none of whose neighbours has
    anything at its turn gets no row. Known values are summed by join; only holes that wait for others, and the holes of
    their day, are walked in order, a task for each variable and day.
    """
    both = edges.select("point_a", "point_b").unionByName(edges.select(F.col("point_b").alias("point_a"), F.col("point_a").alias("point_b"))).distinct()
    near = missing.join(both, F.col("point_id") == F.col("point_a")).select("point_id", "variable", "date", F.col("point_b").alias("near"))
    values = readings.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("point_id").alias("near"), "variable", "date", "value")
    gaps = missing.select(F.col("point_id").alias("near"), "variable", "date", F.lit(True).alias("gap"))
    met = near.join(values, ["near", "variable", "date"], "left").join(gaps, ["near", "variable", "date"], "left")
    waits = F.col("gap") & (F.col("near") < F.col("point_id"))
    each = met.groupBy("point_id", "variable", "date").agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.array_sort(F.collect_list(F.when(waits, F.col("near")))).alias("feeders"))
    waiting = each.filter(F.size("feeders") > 0).select("variable", "date").distinct()
    plain = each.join(waiting, ["variable", "date"], "left_anti").filter("n > 0").select("point_id", "variable", "date", (F.col("total") / F.col("n")).alias("value"), F.col("n").alias("neighbours"))
    day = each.join(waiting, ["variable", "date"], "left_semi").groupBy("variable", "date")
    return plain.unionByName(day.applyInArrow(_in_turn, "point_id string, variable string, date date, value double, neighbours long"))


def with_fills(readings: DataFrame, fills: DataFrame) -> DataFrame:
    """The readings that have a value, and the fills."""
    kept = readings.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("point_id", "variable", "date", "value")
    return kept.unionByName(fills.select("point_id", "variable", "date", "value"))


def filled_from_neighbours(readings: DataFrame, missing: DataFrame, edges: DataFrame) -> DataFrame:
    """Readings plus the missing ones that neighbours (point_a, point_b) can fill, in order (neighbour_fills)."""
    return with_fills(readings, neighbour_fills(readings, missing, edges))
