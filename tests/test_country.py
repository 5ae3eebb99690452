"""The data source of the planted country, and the way back from metres to degrees."""

import pytest
from pyspark.sql import functions as F

from zonewright.operators import geometry
from zonewright.operators.projection import to_degrees
from zonewright.sources import planted
from zonewright.sources.country import DAYS_A_PART, CountrySource, RealSourceError, WeatherReader, country, refuse_real


def test_weather_through_the_source(spark):
    key = ["point_id", "date", "variable"]
    got = country(spark)
    want = planted.weather(spark).withColumnRenamed("value", "want")
    both = got.join(want, key, "full")
    assert got.count() == want.count() == both.count()
    assert both.filter(~F.abs(F.col("value") - F.col("want")).eqNullSafe(0.0) & ~(F.col("value").isNull() & F.col("want").isNull()) & ~(F.abs(F.col("value") - F.col("want")) < 1e-9)).count() == 0
    assert both.filter("value IS NULL").count() == 1


def test_windows_are_cut_where_they_are_made(spark):
    some = country(spark, variables="rain, wind", start="2024-06-25", end="2024-07-05")
    assert some.count() == 2 * 11 * 18 and some.filter("variable = 'rain' AND date >= '2024-07-01' AND value <> 0").count() == 0
    assert {r.variable for r in some.select("variable").distinct().collect()} == {"rain", "wind"}
    parts = WeatherReader(["tmin"], planted.START, planted.END).partitions()
    assert len(parts) == -(-731 // DAYS_A_PART) and (parts[0].first, parts[-1].last) == (planted.START, planted.END)
    with pytest.raises(Exception, match="unknown variables: snow"):
        country(spark, variables="snow").count()


def test_the_real_one_is_not_connected(spark):
    with pytest.raises(Exception, match="not connected"):
        country(spark, source="real", path="/data/real").count()
    with pytest.raises(RealSourceError, match="real points input at p.csv"):
        refuse_real("points", "p.csv")
    assert CountrySource.name() == "zonewright-country"


def test_there_and_back(spark):
    rows = [(f"{a}/{b}", 49.9 + a * 0.7, -6.4 + b * 0.8) for a in range(12) for b in range(11)]
    df = spark.createDataFrame(rows, "point_id string, latitude double, longitude double")
    back = to_degrees(geometry.to_national_grid(df).select("point_id", "x", "y"))
    again = geometry.to_national_grid(back).select("point_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    off = back.join(again, "point_id").agg(F.max(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))).first()[0]
    assert off < 5e-4
    degrees = back.join(df.withColumnsRenamed({"latitude": "a", "longitude": "b"}), "point_id").agg(F.max(F.abs(F.col("latitude") - F.col("a"))), F.max(F.abs(F.col("longitude") - F.col("b")))).first()
    assert max(degrees) < 1e-8
    assert to_degrees(spark.createDataFrame([("n", None, 1.0)], "point_id string, x double, y double")).first().latitude is None
