from datetime import datetime, timedelta

from pyspark.sql import functions as F

from zonewright.operators import anomaly
from zonewright.streaming.scoring import daily_means, departures, stream_scores

SCHEMA = "ts timestamp, point_id string, variable string, value double"


def readings(days=12):
    start = datetime(2024, 3, 1, 6)
    return [(start + timedelta(days=d, minutes=i), f"p{i}", "tmin", float(d * i % 7 + i)) for d in range(days) for i in range(4)]


def stream(spark, tmp_path, name):
    path = str(tmp_path / name)
    for k, chunk in enumerate((readings()[:24], readings()[24:], [(datetime(2024, 6, 1), "p0", "tmin", 0.0)], [(datetime(2024, 6, 2), "p0", "tmin", 0.0)])):
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def stored(spark):
    points = [(f"p{i}", "tmin", s, 0.5 * i) for i in range(4) for s in range(1, 366)]
    normals = spark.createDataFrame(points, "point_id string, variable string, slot int, normal double")
    parameters = spark.createDataFrame([(f"p{i}", "tmin", 0.1, 2.0) for i in range(4)], "point_id string, variable string, build_mean double, build_std double")
    return normals, parameters


def test_daily_means_of_a_stream(spark, tmp_path):
    normals, _ = stored(spark)
    out = drained(spark, daily_means(departures(stream(spark, tmp_path, "in1"), normals)), tmp_path, "means")
    got = {r.day.start.date(): (round(r.national, 9), r.points) for r in out.collect()}
    batch = departures(spark.createDataFrame(readings(), SCHEMA), normals).groupBy(F.col("ts").cast("date").alias("d")).agg(F.avg("departure").alias("m"), F.count("*").alias("n"))
    want = {r.d: (round(r.m, 9), r.n) for r in batch.collect()}
    assert {d: v for d, v in got.items() if d.month == 3} == want


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    normals, parameters = stored(spark)
    out = drained(spark, stream_scores(stream(spark, tmp_path, "in2"), normals, parameters), tmp_path, "scores")
    got = {(r.point_id, r.ts.date()): round(r.z_score, 9) for r in out.collect() if r.ts.month == 3}
    batch = spark.createDataFrame(readings(), SCHEMA).withColumn("date", F.col("ts").cast("date"))
    z = anomaly.z_scores(anomaly.regional_anomaly(anomaly.seasonal_anomaly(batch, normals)), parameters)
    assert got == {(r.point_id, r.date): round(r.z_score, 9) for r in z.collect()}
