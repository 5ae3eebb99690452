"""Scoring readings as they arrive, against stored normals and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.functions.calendar import calendar_slot
from zonewright.functions.stats import TINY


def departures(readings: DataFrame, normals: DataFrame) -> DataFrame:
    """(ts, point_id, variable, departure) of a stream (ts timestamp, point_id, variable, value); no state is kept.

    normals (point_id, variable, slot, normal) are a stored table: Spark broadcasts it if its size allows.
    """
    slotted = readings.filter(F.col("value").isNotNull()).withColumn("slot", calendar_slot(F.col("ts").cast("date")))
    joined = slotted.join(normals, ["point_id", "variable", "slot"])
    return joined.select("ts", "point_id", "variable", (F.col("value") - F.col("normal")).alias("departure"))


def daily_means(deps: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, variable, national, points): the mean of each day over the points, once the watermark has passed it.

    State is a sum for each open day and variable, whatever the number of points.
    """
    open_days = deps.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "variable")
    return open_days.agg(F.avg("departure").alias("national"), F.count("*").alias("points"))


def stream_scores(readings: DataFrame, normals: DataFrame, parameters: DataFrame, late: str = "2 days") -> DataFrame:
    """(ts, point_id, variable, regional_anomaly, z_score) in append mode: a day comes out when it can get no more readings.

    The departures wait, within the watermark, for their day's mean; parameters (point_id, variable, build_mean,
    build_std) are a stored table.
    """
    deps = departures(readings, normals).withWatermark("ts", late)
    means = deps.groupBy(F.window("ts", "1 day").alias("day"), F.col("variable").alias("v")).agg(F.avg("departure").alias("national"))
    means = means.select(F.window_time("day").alias("until"), F.col("day.start").alias("start"), "v", "national")
    same_day = (F.date_trunc("day", "ts") == F.col("start")) & (F.col("ts") <= F.col("until")) & (F.col("ts") > F.col("until") - F.expr("INTERVAL 1 DAY"))
    both = deps.join(means, same_day & (F.col("variable") == F.col("v"))).drop("until", "start", "v")
    scored = both.withColumn("regional_anomaly", F.col("departure") - F.col("national")).join(parameters, ["point_id", "variable"])
    spread = F.when(F.col("build_std") > TINY, F.col("build_std"))
    return scored.select("ts", "point_id", "variable", "regional_anomaly", ((F.col("regional_anomaly") - F.col("build_mean")) / spread).alias("z_score"))
