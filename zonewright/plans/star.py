"""Bindings of the star schema: nations are points and areas on a 5 x 5 lattice of 25 km, regions the present map.

Orders by nation of the customer give the series; build days end with 1999, 2000 is held out, 2001 sealed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.operators.geometry import box_shape

BUILD_END, HELD_START, HELD_END, SEALED = "1999-12-31", "2000-01-01", "2000-12-31", "2001-01-01"
SIDE = 25_000
#: Values are in units of so much, at a rate of exchange: no sum of prices then ends on a rounding tie.
UNIT = 1173.7


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nation_id(key: str | Column) -> Column:
    return F.concat(F.lit("N"), F.lpad((F.col(key) if isinstance(key, str) else key).cast("string"), 2, "0"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """(unit_id, group_id, key, x, y): lattice places in metres."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        nation_id("n_nationkey").alias("unit_id"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("group_id"),
        k.alias("key"),
        ((k % 5) * SIDE).cast("double").alias("x"),
        (F.floor(k / 5) * SIDE).cast("double").alias("y"),
    )


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(id, shape): each nation's square."""
    n = nations(spark, d)
    return n.select(F.col("unit_id").alias("id"), box_shape(F.col("x"), F.col("y"), F.col("x") + SIDE, F.col("y") + SIDE).alias("shape"))


def districts(spark: SparkSession, d: str) -> DataFrame:
    """(id, shape): larger squares of 60 km, off the nations' grid."""
    step = 60_000
    k = F.col("r_regionkey")
    x, y = (k % 2) * step - 10_000, F.floor(k / 2) * step - 10_000
    return table(spark, d, "region").select(F.concat(F.lit("D"), k.cast("string")).alias("id"), box_shape(x, y, x + step, y + step).alias("shape"))


def priced_orders(spark: SparkSession, d: str) -> DataFrame:
    """(point_id, segment, date, price): one row an order; the price is decimal, so sums are exact."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    c = table(spark, d, "customer").select("c_custkey", nation_id("c_nationkey").alias("point_id"), F.col("c_mktsegment").alias("segment"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("point_id", "segment", "date", "price")


def long_series(orders: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, variable, value): value in UNIT, and the number of orders."""
    sums = orders.groupBy(*keys).agg((F.sum("price").cast("double") / UNIT).alias("value"), F.count("*").cast("double").alias("orders"))
    return sums.unpivot(keys, ["value", "orders"], "variable", "value")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return long_series(priced_orders(spark, d), ["point_id", "date"])


def monthly(spark: SparkSession, d: str, unit: tuple[str, ...] = ("point_id",)) -> DataFrame:
    o = priced_orders(spark, d).withColumn("date", F.trunc("date", "month"))
    return long_series(o, [*unit, "date"])


def small_areas(spark: SparkSession, d: str) -> DataFrame:
    """(unit_id, parent_id, date, variable, value) by month: a market segment of a nation is a small area."""
    s = monthly(spark, d, ("point_id", "segment"))
    return s.select(F.concat_ws("/", "point_id", "segment").alias("unit_id"), F.col("point_id").alias("parent_id"), "date", "variable", "value")


#: The same for the SQL twins.
SQL = {
    "nations": f"""nations AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS unit_id, 'R' || n_regionkey AS group_id, n_nationkey AS key,
        CAST((n_nationkey % 5) * {SIDE} AS DOUBLE) AS x, CAST((n_nationkey // 5) * {SIDE} AS DOUBLE) AS y FROM nation)""",
    "rook": f"rook AS (SELECT a.unit_id AS unit_a, b.unit_id AS unit_b, CAST({SIDE} AS DOUBLE) AS shared_edge_metres FROM nations a JOIN nations b ON a.unit_id < b.unit_id AND abs(a.x - b.x) + abs(a.y - b.y) = {SIDE})",
    "priced": """priced AS (SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS point_id, c_mktsegment AS segment, CAST(o_orderdate AS DATE) AS date,
        CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "daily": f"""daily0 AS (SELECT point_id, date, CAST(sum(price) AS DOUBLE) / {UNIT} AS v, CAST(count(*) AS DOUBLE) AS n FROM priced GROUP BY 1, 2),
        daily AS (SELECT point_id, date, 'value' AS variable, v AS value FROM daily0 UNION ALL SELECT point_id, date, 'orders', n FROM daily0)""",
    "monthly": f"""monthly0 AS (SELECT point_id, CAST(date_trunc('month', date) AS DATE) AS date, CAST(sum(price) AS DOUBLE) / {UNIT} AS v, CAST(count(*) AS DOUBLE) AS n FROM priced GROUP BY 1, 2),
        monthly AS (SELECT point_id, date, 'value' AS variable, v AS value FROM monthly0 UNION ALL SELECT point_id, date, 'orders', n FROM monthly0)""",
    "small": f"""small0 AS (SELECT point_id || '/' || segment AS unit_id, point_id AS parent_id, CAST(date_trunc('month', date) AS DATE) AS date, CAST(sum(price) AS DOUBLE) / {UNIT} AS v, CAST(count(*) AS DOUBLE) AS n FROM priced GROUP BY 1, 2, 3),
        small AS (SELECT unit_id, parent_id, date, 'value' AS variable, v AS value FROM small0 UNION ALL SELECT unit_id, parent_id, date, 'orders', n FROM small0)""",
}
