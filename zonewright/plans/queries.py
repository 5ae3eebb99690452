"""The engine's queries over the star schema, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.functions.calendar import calendar_slot
from zonewright.functions.stats import tidy
from zonewright.operators import allocate, anomaly, components, geometry, nearest, network, overlay, projection, score, tree
from zonewright.plans import star
from zonewright.plans.star import BUILD_END, SEALED, SIDE, SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *parts: str) -> Callable[[Query], Query]:
    """Registers a query; sql may use the named parts of SQL as common tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(SQL.get(p, p) for p in parts)
            body = sql.strip()
            start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), "")
            ORACLES[f.__name__] = f"{start or 'WITH '}{head}{', ' if start else ' '}{body[len(start) :]}" if head else body
        return f

    return add


SLOT = "dayofyear(make_date(2001, CAST(month(date) AS INT), CAST(CASE WHEN month(date) = 2 AND day(date) = 29 THEN 28 ELSE day(date) END AS INT)))"
R6 = "round({}, 6) + 0.0".format
#: Shares of variance of whole numbers are fractions that end on a tie at six places now and then.
R9 = "round({}, 9) + 0.0".format


# ---- scans, filters, joins -------------------------------------------------------------------------------------------


@query("SELECT point_id, date, variable, round(value, 3) AS value FROM daily WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'", "priced", "daily")
def scan_window_filter(spark, d):
    return anomaly.in_window(star.daily(spark, d), "1998-01-01", BUILD_END).withColumn("value", F.round("value", 3))


@query(f"SELECT count(*) AS rows, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '{SEALED}') AS sealed_rows, min(CAST(o_orderdate AS DATE)) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '{SEALED}') AS first_sealed FROM orders")
def sealed_guard_counts(spark, d):
    day = F.col("o_orderdate").cast("date")
    sealed = day >= F.lit(SEALED).cast("date")
    return star.table(spark, d, "orders").agg(F.count("*").alias("rows"), F.count(F.when(sealed, 1)).alias("sealed_rows"), F.min(F.when(sealed, day)).alias("first_sealed"))


@query("SELECT date, variable, 'R' || n_regionkey AS region_id, round(sum(value), 3) AS value FROM monthly JOIN nation ON point_id = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') GROUP BY 1, 2, 3", "priced", "monthly")
def unpivot_long(spark, d):
    regions = [f"R{k}" for k in range(5)]
    s = star.monthly(spark, d).join(star.nations(spark, d).select(F.col("unit_id").alias("point_id"), "group_id"), "point_id")
    wide = s.groupBy("date", "variable").pivot("group_id", regions).agg(F.sum("value"))
    return wide.unpivot(["date", "variable"], regions, "region_id", "value").filter(F.col("value").isNotNull()).withColumn("value", F.round("value", 3))


@query("SELECT point_id, " + ", ".join(f"max(value) FILTER (WHERE month(date) = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM monthly WHERE year(date) = 1999 AND variable = 'orders' GROUP BY 1", "priced", "monthly")
def pivot_matrix(spark, d):
    s = star.monthly(spark, d).filter((F.year("date") == 1999) & (F.col("variable") == "orders"))
    return s.withColumn("m", F.date_format("date", "'m'MM")).groupBy("point_id").pivot("m", [f"m{m:02d}" for m in range(1, 13)]).agg(F.first("value"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def kept_semi(spark, d):
    kept = star.table(spark, d, "supplier").filter("s_acctbal > 9000")
    return star.table(spark, d, "customer").join(kept, F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def orphan_anti(spark, d):
    o = star.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return star.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


# ---- seasonal anomalies ----------------------------------------------------------------------------------------------


@query(f"SELECT CAST({SLOT} AS INT) AS slot, count(*) AS n, count(DISTINCT date) AS days FROM (SELECT CAST(o_orderdate AS DATE) AS date FROM orders) GROUP BY 1")
def leap_slot(spark, d):
    o = star.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return o.groupBy(calendar_slot(F.col("date")).alias("slot")).agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"))


@query(f"SELECT point_id, date, variable, {R6('CASE WHEN variable = $$value$$ THEN ln(1 + value) ELSE value END')} AS value FROM monthly".replace("$$", "'"), "priced", "monthly")
def transform_log1p(spark, d):
    return anomaly.transformed(star.monthly(spark, d), ("value",)).withColumn("value", tidy(F.col("value"))).select("point_id", "date", "variable", "value")


BUILD = f"build AS (SELECT *, CAST({SLOT} AS INT) AS slot FROM daily WHERE date <= DATE '{BUILD_END}')"
NORMALS = "normals AS (SELECT point_id, variable, slot, avg(value) AS normal FROM build GROUP BY 1, 2, 3)"
FILLED = """grid AS (SELECT point_id, variable, CAST(i AS INT) AS slot FROM (SELECT DISTINCT point_id, variable FROM normals), range(1, 366) t(i)),
 around AS (SELECT g.point_id, g.variable, g.slot, n.normal,
   last_value(n.normal IGNORE NULLS) OVER b AS v0, last_value(n.slot IGNORE NULLS) OVER b AS s0,
   first_value(n.normal IGNORE NULLS) OVER a AS v1, first_value(n.slot IGNORE NULLS) OVER a AS s1
   FROM grid g LEFT JOIN normals n ON g.point_id = n.point_id AND g.variable = n.variable AND g.slot = n.slot
   WINDOW b AS (PARTITION BY g.point_id, g.variable ORDER BY g.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          a AS (PARTITION BY g.point_id, g.variable ORDER BY g.slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 filled AS (SELECT point_id, variable, slot, CASE WHEN normal IS NOT NULL THEN normal WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL THEN v0
   ELSE v0 + (v1 - v0) * (slot - s0) / (s1 - s0) END AS normal FROM around)"""
SMOOTH = """turned AS (SELECT point_id, variable, slot, slot + 365 * k AS place, normal FROM filled, (VALUES (-1), (0), (1)) t(k)),
 smooth AS (SELECT point_id, variable, slot, normal FROM (SELECT point_id, variable, slot, place, avg(normal) OVER (PARTITION BY point_id, variable ORDER BY place ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS normal FROM turned) WHERE place BETWEEN 1 AND 365)"""
ANOMALY = f"anomalies AS (SELECT d.point_id, d.date, d.variable, d.value - s.normal AS anomaly FROM (SELECT *, CAST({SLOT} AS INT) AS slot FROM daily) d JOIN smooth s ON d.point_id = s.point_id AND d.variable = s.variable AND d.slot = s.slot)"
REGIONAL = "regional AS (SELECT point_id, a.date, a.variable, anomaly - national AS regional_anomaly FROM anomalies a JOIN (SELECT date, variable, avg(anomaly) AS national FROM anomalies GROUP BY 1, 2) n ON a.date = n.date AND a.variable = n.variable)"
PARAMS = f"params AS (SELECT point_id, variable, avg(regional_anomaly) AS build_mean, stddev_pop(regional_anomaly) AS build_std FROM regional WHERE date <= DATE '{BUILD_END}' GROUP BY 1, 2)"
CHAIN = ("priced", "daily", BUILD, NORMALS, FILLED, SMOOTH)


def _normals(spark, d):
    return anomaly.slot_normals(anomaly.in_window(star.daily(spark, d), end=BUILD_END))


def _smooth(spark, d):
    return anomaly.smoothed(anomaly.interpolated(_normals(spark, d)), 31)


def _anomalies(spark, d):
    return anomaly.seasonal_anomaly(star.daily(spark, d), _smooth(spark, d))


def _regional(spark, d):
    return anomaly.regional_anomaly(_anomalies(spark, d))


def _params(spark, d):
    return anomaly.build_parameters(anomaly.in_window(_regional(spark, d), end=BUILD_END))


def _z(spark, d):
    return anomaly.z_scores(_regional(spark, d), _params(spark, d))


@query(f"SELECT point_id, variable, slot, {R6('normal')} AS normal FROM normals", *CHAIN[:4])
def slot_normals(spark, d):
    return _normals(spark, d).withColumn("normal", tidy(F.col("normal")))


@query(f"SELECT point_id, variable, slot, {R6('normal')} AS normal FROM filled", *CHAIN[:5])
def normals_interpolated(spark, d):
    return anomaly.interpolated(_normals(spark, d)).withColumn("normal", tidy(F.col("normal")))


@query(f"SELECT point_id, variable, slot, {R6('normal')} AS normal FROM smooth", *CHAIN)
def normals_smoothed(spark, d):
    return _smooth(spark, d).withColumn("normal", tidy(F.col("normal")))


@query(f"SELECT date, variable, {R6('avg(anomaly)')} AS national FROM anomalies GROUP BY 1, 2", *CHAIN, ANOMALY)
def national_mean_plain(spark, d):
    return anomaly.national_means(_anomalies(spark, d)).withColumn("national", tidy(F.col("national")))


WEIGHTS = "weights AS (SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS point_id, CAST(count(*) AS DOUBLE) AS weight FROM customer GROUP BY 1)"


@query(f"SELECT date, variable, {R6('sum(weight * anomaly) / sum(weight)')} AS national FROM anomalies JOIN weights USING (point_id) GROUP BY 1, 2", *CHAIN, ANOMALY, WEIGHTS)
def national_mean_weighted(spark, d):
    weights = star.table(spark, d, "customer").groupBy(star.nation_id("c_nationkey").alias("point_id")).agg(F.count("*").cast("double").alias("weight"))
    return anomaly.national_means(_anomalies(spark, d), weights).withColumn("national", tidy(F.col("national")))


@query(f"SELECT point_id, date, variable, {R6('regional_anomaly')} AS regional_anomaly FROM regional", *CHAIN, ANOMALY, REGIONAL)
def regional_anomaly(spark, d):
    return _regional(spark, d).withColumn("regional_anomaly", tidy(F.col("regional_anomaly")))


@query(f"SELECT r.point_id, date, r.variable, CASE WHEN date <= DATE '{BUILD_END}' THEN 'build' ELSE 'held_out' END AS window_label, {R6('(regional_anomaly - build_mean) / CASE WHEN build_std > 1e-12 THEN build_std END')} AS z_score FROM regional r JOIN params p ON r.point_id = p.point_id AND r.variable = p.variable", *CHAIN, ANOMALY, REGIONAL, PARAMS)
def build_zscore(spark, d):
    z = _z(spark, d).withColumn("window_label", anomaly.window_label(BUILD_END))
    return z.select("point_id", "date", "variable", "window_label", tidy(F.col("z_score")).alias("z_score"))


@query(
    f"""SELECT point_id, variable, 'seasonal_normal' AS parameter, slot AS day_of_year, {R6('normal')} AS value FROM smooth
    UNION ALL SELECT point_id, variable, 'build_mean', 0, {R6('build_mean')} FROM params UNION ALL SELECT point_id, variable, 'build_standard_deviation', 0, {R6('build_std')} FROM params""",
    *CHAIN, ANOMALY, REGIONAL, PARAMS,
)
def stored_parameters(spark, d):
    return anomaly.parameter_table(_smooth(spark, d), _params(spark, d)).withColumn("value", tidy(F.col("value")))


POINTS = "points AS (SELECT unit_id AS point_id FROM nations)"
HOLES = "holes AS (SELECT p.point_id, v.variable, t.date FROM points p, (SELECT DISTINCT variable FROM daily) v, (SELECT DISTINCT date FROM daily) t WHERE NOT EXISTS (SELECT 1 FROM daily x WHERE x.point_id = p.point_id AND x.variable = v.variable AND x.date = t.date))"


def _holes(spark, d):
    return anomaly.holes(star.daily(spark, d), star.nations(spark, d).select(F.col("unit_id").alias("point_id")))


@query("SELECT point_id, variable, date FROM holes", "priced", "daily", "nations", POINTS, HOLES)
def missing_holes(spark, d):
    return _holes(spark, d)


@query(
    """SELECT 'day' AS period, point_id, date, variable, round(value, 3) AS value FROM daily WHERE date NOT IN (SELECT date FROM holes)
    UNION ALL SELECT 'month', point_id, date, variable, round(value, 3) FROM monthly WHERE date NOT IN (SELECT date FROM month_holes)""",
    "priced", "daily", "monthly", "nations", POINTS, HOLES, HOLES.replace("daily", "monthly").replace("holes AS", "month_holes AS"),
)
def drop_day(spark, d):
    """Days without a hole, and months: each day of the smaller tables has a nation without orders."""
    points = star.nations(spark, d).select(F.col("unit_id").alias("point_id"))
    whole = lambda s, period: anomaly.without_days(s, anomaly.holes(s, points)).select(F.lit(period).alias("period"), "point_id", "date", "variable", F.round("value", 3).alias("value"))
    return whole(star.daily(spark, d), "day").unionByName(whole(star.monthly(spark, d), "month"))


@query(
    """WITH RECURSIVE place AS (SELECT unit_id AS point_id, row_number() OVER (ORDER BY unit_id) AS k, row_number() OVER (ORDER BY unit_id) - 1 AS z FROM nations),
    every AS (SELECT v.variable, dt.date, place.point_id, k FROM (SELECT DISTINCT variable FROM daily) v, (SELECT DISTINCT date FROM daily) dt, place),
    walk AS (SELECT variable, date, list(value ORDER BY k) AS v, CAST(0 AS BIGINT) AS step FROM every LEFT JOIN daily USING (variable, date, point_id) GROUP BY ALL
      UNION ALL SELECT variable, date, list_concat(v[1:step], [CASE WHEN v[step + 1] IS NOT NULL THEN v[step + 1] ELSE list_avg([CASE WHEN step >= 5 THEN v[step - 4] END, CASE WHEN step % 5 > 0 THEN v[step] END,
        CASE WHEN step % 5 < 4 THEN v[step + 2] END, CASE WHEN step < 20 THEN v[step + 6] END]) END], v[step + 2:]), step + 1 FROM walk WHERE step < 25)
    SELECT point_id, date, variable, round(v[k], 3) AS value FROM walk, place WHERE step = 25 AND v[k] IS NOT NULL""",
    "priced", "daily", "nations",
)
def fill_from_neighbours(spark, d):
    edges = _rook(spark, d).select(F.col("unit_a").alias("point_a"), F.col("unit_b").alias("point_b"))
    return anomaly.filled_from_neighbours(star.daily(spark, d), _holes(spark, d), edges).withColumn("value", F.round("value", 3))


@query(
    f"""SELECT 'P' || lpad(CAST(i AS VARCHAR), 2, '0') AS point_id, DATE '2023-09-01' + CAST(t AS INT) AS date,
    round(5 + 6 * sin(2 * pi() * (t + 138) / 365.25) + 1.6 * sin(2 * pi() * t / 97) + CASE WHEN i % 4 >= 2 THEN 2.4 ELSE -2.4 END * sin(2 * pi() * t / 53) + 0.35 * sin(2 * pi() * (t + 7 * i) / 29), 6) + 0.0 AS value
    FROM range(0, 16) a(i), range(0, 731) b(t)"""
)
def synth_weather(spark, d):
    """The planted minimum temperature of the sixteen grid points, unrounded."""
    from zonewright.sources.planted import VARIABLES, weather_value

    grid = spark.range(16).select(F.col("id").cast("int").alias("i")).crossJoin(F.broadcast(spark.range(731).select(F.col("id").cast("int").alias("t"))))  # fixed sizes
    value = weather_value(VARIABLES["tmin"], F.col("t"), F.col("i"), F.col("i") % 4 >= 2)
    return grid.select(F.concat(F.lit("P"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("point_id"), F.date_add(F.lit("2023-09-01").cast("date"), F.col("t")).alias("date"), tidy(value).alias("value"))


# ---- geometry --------------------------------------------------------------------------------------------------------


def _rook(spark, d):
    return geometry.adjacency(star.boxes(spark, d), SIDE)


@query("SELECT * FROM rook", "nations", "rook")
def lattice_adjacency_rook(spark, d):
    return _rook(spark, d)


@query(f"SELECT a.unit_id AS unit_a, b.unit_id AS unit_b, CASE WHEN abs(a.x - b.x) + abs(a.y - b.y) = {SIDE} THEN {SIDE}.0 ELSE 0.0 END::DOUBLE AS shared_edge_metres FROM nations a JOIN nations b ON a.unit_id < b.unit_id AND abs(a.x - b.x) <= {SIDE} AND abs(a.y - b.y) <= {SIDE}", "nations")
def lattice_adjacency_queen(spark, d):
    return geometry.adjacency(star.boxes(spark, d), SIDE, "queen")


@query("SELECT unit_id, (SELECT count(*) FROM rook WHERE unit_a = unit_id OR unit_b = unit_id) AS degree FROM nations", "nations", "rook")
def degree(spark, d):
    return network.degrees(star.nations(spark, d), _rook(spark, d))


def _sites(spark, d):
    """(unit_id, x, y): every supplier at a place of its own, off the lattice, within its nation."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    x, y = n % 5 * SIDE + k * 7919 % 24989, F.floor(n / 5) * SIDE + k * 104729 % 24977
    return star.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.lpad(k.cast("string"), 8, "0")).alias("unit_id"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def _places(spark, d):
    """(unit_id, x, y): every customer, likewise."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    x, y = n % 5 * SIDE + k * 15485863 % 24979, F.floor(n / 5) * SIDE + k * 32452843 % 24967
    return star.table(spark, d, "customer").select(F.concat(F.lit("C"), F.lpad(k.cast("string"), 9, "0")).alias("unit_id"), x.cast("double").alias("x"), y.cast("double").alias("y"))


SITES = f"""sites AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS unit_id, CAST(s_nationkey % 5 * {SIDE} + s_suppkey * 7919 % 24989 AS DOUBLE) AS x,
   CAST(s_nationkey // 5 * {SIDE} + s_suppkey * 104729 % 24977 AS DOUBLE) AS y FROM supplier),
 places AS (SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS unit_id, CAST(c_nationkey % 5 * {SIDE} + c_custkey * 15485863 % 24979 AS DOUBLE) AS x,
   CAST(c_nationkey // 5 * {SIDE} + c_custkey * 32452843 % 24967 AS DOUBLE) AS y FROM customer)"""


BOX_OVERLAP = f"""districts AS (SELECT 'D' || r_regionkey AS id, CAST((r_regionkey % 2) * 60000 - 10000 AS DOUBLE) AS x, CAST((r_regionkey // 2) * 60000 - 10000 AS DOUBLE) AS y FROM region),
 laps AS (SELECT unit_id, id, greatest(0, least(n.x + {SIDE}, d.x + 60000) - greatest(n.x, d.x)) * greatest(0, least(n.y + {SIDE}, d.y + 60000) - greatest(n.y, d.y)) AS area FROM nations n, districts d),
 shares AS (SELECT unit_id AS child_id, id AS parent_id, area, area / sum(area) OVER (PARTITION BY unit_id) AS share FROM laps WHERE area > 0)"""


def _shares(spark, d):
    return geometry.area_shares(star.boxes(spark, d), star.districts(spark, d), SIDE)


@query("SELECT child_id, parent_id, round(area, 2) AS area, round(share, 6) AS share FROM shares", "nations", BOX_OVERLAP)
def overlap_shares(spark, d):
    return _shares(spark, d).select("child_id", "parent_id", F.round("area", 2).alias("area"), F.round("share", 6).alias("share"))


@query(
    """WITH ranked AS (SELECT child_id, parent_id, round(share, 9) AS share, row_number() OVER (PARTITION BY child_id ORDER BY round(share, 9) DESC, parent_id) AS r FROM shares)
    SELECT child_id AS unit_id, parent_id AS majority_cluster, round(share, 6) AS majority_share, round(1 - share, 6) AS straddle_score FROM ranked WHERE r = 1""",
    "nations", BOX_OVERLAP,
)
def majority_straddle(spark, d):
    shares = _shares(spark, d).select(F.col("child_id").alias("unit_id"), F.col("parent_id").alias("cluster"), F.round("share", 9).alias("share"))
    return allocate.majority(shares).select("unit_id", "majority_cluster", F.round("majority_share", 6).alias("majority_share"), F.round("straddle_score", 6).alias("straddle_score"))


@query(
    f"""WITH best AS (SELECT child_id, parent_id, row_number() OVER (PARTITION BY child_id ORDER BY round(share, 9) DESC, parent_id) AS r FROM shares),
    kids AS (SELECT b.parent_id, count(*) * {SIDE}.0 * {SIDE} AS b, sum(s.area) AS both_area FROM best b JOIN shares s ON s.child_id = b.child_id AND s.parent_id = b.parent_id WHERE r = 1 GROUP BY 1)
    SELECT d.id AS parent_id, round(60000.0 * 60000 + coalesce(b, 0) - 2 * coalesce(both_area, 0), 1) AS sliver_area FROM districts d LEFT JOIN kids k ON k.parent_id = d.id""",
    "nations", BOX_OVERLAP,
)
def slivers(spark, d):
    best = majority_straddle(spark, d).select(F.col("unit_id").alias("id"), F.col("majority_cluster").alias("parent_id"))
    out = overlay.slivers(star.boxes(spark, d).join(best, "id"), star.districts(spark, d), SIDE)
    return out.withColumn("sliver_area", F.round("sliver_area", 1))


def _grounds(spark, d):
    """(id, parent_id, shape): 10 km squares of all suppliers, on whole kilometres; those of a nation overlap each other."""
    s = _sites(spark, d).join(star.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("unit_id"), star.nation_id("s_nationkey").alias("parent_id")), "unit_id")
    x, y = (F.floor(F.col(c) / 1000) * 1000 for c in ("x", "y"))
    return s.select(F.col("unit_id").alias("id"), "parent_id", geometry.box_shape(x, y, x + 10_000, y + 10_000).alias("shape"))


@query(
    """WITH kilometres AS (SELECT CAST(floor(x / 1000) AS BIGINT) AS gx, CAST(floor(y / 1000) AS BIGINT) AS gy, s_nationkey AS n FROM sites JOIN supplier ON unit_id = 'S' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0')),
    kids AS (SELECT DISTINCT n, gx + i AS cx, gy + j AS cy FROM kilometres, range(0, 10) a(i), range(0, 10) b(j)),
    whole AS (SELECT n_nationkey AS n, n_nationkey % 5 * 25 + i AS cx, n_nationkey // 5 * 25 + j AS cy FROM nation, range(0, 25) a(i), range(0, 25) b(j)),
    off AS (SELECT coalesce(w.n, k.n) AS n FROM whole w FULL JOIN kids k ON k.n = w.n AND k.cx = w.cx AND k.cy = w.cy WHERE w.n IS NULL OR k.n IS NULL)
    SELECT 'N' || lpad(CAST(n AS VARCHAR), 2, '0') AS parent_id, count(*) * 1000000.0::DOUBLE AS sliver_area FROM off GROUP BY n""",
    SITES,
)
def slivers_of_overlapping(spark, d):
    """Where nations and the ground that their suppliers' overlapping squares cover together differ."""
    return overlay.slivers(_grounds(spark, d), star.boxes(spark, d), SIDE).withColumn("sliver_area", F.round("sliver_area", 1))


@query(
    f"""SELECT unit_id AS point_id, id FROM places p, districts d WHERE p.x > d.x AND p.x < d.x + 60000 AND p.y > d.y AND p.y < d.y + 60000""",
    "nations", BOX_OVERLAP, SITES,
)
def points_in_districts(spark, d):
    """Every customer with the districts whose ground it lies on."""
    return geometry.points_within(_places(spark, d).withColumnRenamed("unit_id", "point_id"), star.districts(spark, d), SIDE)


@query(
    f"""WITH RECURSIVE inside AS (SELECT r.unit_a AS a, r.unit_b AS b FROM rook r JOIN nations x ON x.unit_id = unit_a JOIN nations y ON y.unit_id = unit_b WHERE x.group_id = y.group_id),
    reach AS (SELECT unit_id AS a, unit_id AS b FROM nations UNION SELECT reach.a, CASE WHEN i.a = reach.b THEN i.b ELSE i.a END FROM reach JOIN inside i ON reach.b IN (i.a, i.b)),
    roots AS (SELECT a AS unit_id, min(b) AS root FROM reach GROUP BY 1)
    SELECT group_id, count(DISTINCT root) AS parts, round(count(*) * {SIDE}.0 * {SIDE}, 1)::DOUBLE AS area FROM nations JOIN roots USING (unit_id) GROUP BY 1""",
    "nations", "rook",
)
def dissolved_regions(spark, d):
    """Regions as shapes: parts and ground of the union of their nations."""
    shapes = star.boxes(spark, d).join(star.nations(spark, d).select(F.col("unit_id").alias("id"), "group_id"), "id").select("group_id", "shape")
    out = overlay.dissolved(shapes, SIDE)
    return out.select("group_id", geometry.part_count(F.col("shape")).cast("long").alias("parts"), F.round(geometry.area(F.col("shape")), 1).alias("area"))


@query("SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id, true AS crossing, CAST(2 AS BIGINT) AS parts, round((100 + s_suppkey % 50) * (200 + s_suppkey % 70) / 2.0, 3)::DOUBLE AS area FROM supplier")
def repaired_bow_ties(spark, d):
    """A ring that crosses itself at every supplier, taken apart."""
    k, x, y = F.col("unit_id").substr(2, 8).cast("long"), F.col("x"), F.col("y")
    w, h = 100 + k % 50, 200 + k % 70
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    bow = F.array(F.array(F.array(corner(x, y), corner(x + w, y + h), corner(x + w, y), corner(x, y + h))))
    s = _sites(spark, d).select(F.col("unit_id").alias("id"), bow.alias("shape")).withColumns({"crossing": geometry.crosses_itself("shape"), "mended": overlay.repair("shape")})
    return s.select("id", "crossing", geometry.part_count(F.col("mended")).cast("long").alias("parts"), F.round(geometry.area(F.col("mended")), 3).alias("area"))


@query("SELECT a.unit_id AS unit_a, b.unit_id AS unit_b, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), 4) AS metres FROM places a, sites b ORDER BY sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), 1, 2 LIMIT 1", SITES)
def closest_pair(spark, d):
    return nearest.closest_pair(_places(spark, d), _sites(spark, d)).withColumn("metres", F.round("metres", 4))


RANKED = """WITH r AS (SELECT n.unit_id AS place_id, s.unit_id AS point_id, sqrt((n.x - s.x) ^ 2 + (n.y - s.y) ^ 2) AS m FROM places n, sites s),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY m, point_id) AS k FROM r) """


@query(RANKED + "SELECT place_id, point_id, round(m, 4) AS metres FROM ranked WHERE k = 1", SITES)
def nearest_point_cell(spark, d):
    """The cell that each customer lies in, by the supplier nearest to it."""
    out = nearest.nearest_point(_places(spark, d).withColumnRenamed("unit_id", "place_id"), _sites(spark, d).withColumnRenamed("unit_id", "point_id"))
    return out.withColumn("metres", F.round("metres", 4))


@query(RANKED + "SELECT place_id, CAST(k AS INT) AS rank, point_id, round(m, 4) AS metres FROM ranked WHERE k <= 5", SITES)
def nearest_five(spark, d):
    out = nearest.nearest_join(_places(spark, d).withColumnRenamed("unit_id", "place_id"), _sites(spark, d).withColumnRenamed("unit_id", "point_id"), 5)
    return out.withColumn("metres", F.round("metres", 4))


@query()
def voronoi_areas(spark, d):
    """Cell areas of all sites; their sum is the widened box."""
    cells = nearest.voronoi_cells(_sites(spark, d).withColumnRenamed("unit_id", "point_id"))
    return cells.select("point_id", F.round(geometry.area(F.col("shape")), 1).alias("area"))


def _geodetic(spark, d):
    k = F.col("n_nationkey")
    return star.table(spark, d, "nation").select(star.nation_id("n_nationkey").alias("point_id"), (50.0 + k % 5 * 1.5).alias("latitude"), (-5.0 + F.floor(k / 5) * 1.3).cast("double").alias("longitude"))


@query("SELECT unit_id, x + 300000 AS x, y + 200000 AS y FROM sites", SITES)
def there_and_back(spark, d):
    """Every supplier's place to degrees and to the grid again: the centimetre is the same."""
    away = _sites(spark, d).select("unit_id", (F.col("x") + 300_000).alias("x"), (F.col("y") + 200_000).alias("y"))
    back = geometry.to_national_grid(projection.to_degrees(away).select("unit_id", "latitude", "longitude"))
    return back.select("unit_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def _grid_sql() -> str:
    """The projection step by step, as the published formulas have it."""
    from math import pi, radians

    sec = pi / 180 / 3600
    h, g = geometry.SHIFT, geometry.GRID
    a, b = geometry.WGS84
    e2 = (a * a - b * b) / (a * a)
    rx, ry, rz, s = h["rx"] * sec, h["ry"] * sec, h["rz"] * sec, 1 + h["s"]
    steps = ["g0 AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS point_id, radians(50.0 + n_nationkey % 5 * 1.5) AS phi, radians(-5.0 + n_nationkey // 5 * 1.3) AS lam FROM nation)"]
    steps += [f"g1 AS (SELECT *, {a!r} / sqrt(1 - {e2!r} * sin(phi) * sin(phi)) AS nu FROM g0)"]
    steps += [f"g2 AS (SELECT point_id, nu * cos(phi) * cos(lam) AS x, nu * cos(phi) * sin(lam) AS y, nu * (1 - {e2!r}) * sin(phi) AS z FROM g1)"]
    steps += [f"g3 AS (SELECT point_id, {h['tx']} + x * {s!r} - y * ({rz!r}) + z * ({ry!r}) AS x, {h['ty']} + x * ({rz!r}) + y * {s!r} - z * ({rx!r}) AS y, {h['tz']} - x * ({ry!r}) + y * ({rx!r}) + z * {s!r} AS z FROM g2)"]
    a, b = geometry.AIRY
    e2 = (a * a - b * b) / (a * a)
    steps += [f"h0 AS (SELECT point_id, z, sqrt(x * x + y * y) AS p, atan2(y, x) AS lam, atan2(z, sqrt(x * x + y * y) * (1 - {e2!r})) AS phi FROM g3)"]
    for i in range(5):
        steps += [f"h{i + 1} AS (SELECT point_id, z, p, lam, atan2(z + {e2!r} * {a!r} / sqrt(1 - {e2!r} * sin(phi) * sin(phi)) * sin(phi), p) AS phi FROM h{i})"]
    f0, lat0, lon0, n = g["f0"], radians(g["lat0"]), radians(g["lon0"]), (a - b) / (a + b)
    steps += [f"i0 AS (SELECT point_id, phi, sin(phi) AS s, cos(phi) AS c, tan(phi) * tan(phi) AS t2, {a * f0!r} / sqrt(1 - {e2!r} * sin(phi) * sin(phi)) AS nu, {a * f0 * (1 - e2)!r} / pow(1 - {e2!r} * sin(phi) * sin(phi), 1.5) AS rho, phi - {lat0!r} AS d, phi + {lat0!r} AS t, lam - ({lon0!r}) AS w FROM h5)"]
    m = f"{b * f0!r} * ({1 + n + 5 / 4 * n**2 + 5 / 4 * n**3!r} * d - {3 * n + 3 * n**2 + 21 / 8 * n**3!r} * sin(d) * cos(t) + {15 / 8 * n**2 + 15 / 8 * n**3!r} * sin(2 * d) * cos(2 * t) - {35 / 24 * n**3!r} * sin(3 * d) * cos(3 * t))"
    steps += [f"i1 AS (SELECT *, nu / rho - 1 AS k, {m} AS m FROM i0)"]
    east = f"{g['e0']} + nu * c * w + nu / 6 * c ** 3 * (nu / rho - t2) * w ** 3 + nu / 120 * c ** 5 * (5 - 18 * t2 + t2 * t2 + 14 * k - 58 * t2 * k) * w ** 5"
    north = f"m + ({g['n0']}) + nu / 2 * s * c * w ** 2 + nu / 24 * s * c ** 3 * (5 - t2 + 9 * k) * w ** 4 + nu / 720 * s * c ** 5 * (61 - 58 * t2 + t2 * t2) * w ** 6"
    return f"WITH {', '.join(steps)} SELECT point_id, round({east}, 3) AS x, round({north}, 3) AS y FROM i1"


@query(_grid_sql())
def project_bng(spark, d):
    return geometry.to_national_grid(_geodetic(spark, d)).select("point_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


# ---- networks and trees ----------------------------------------------------------------------------------------------

#: Edges within a residue of 3 only, so that there are several parts.
CUT_EDGES = "cut AS (SELECT r.* FROM rook r JOIN nations a ON a.unit_id = unit_a JOIN nations b ON b.unit_id = unit_b WHERE (a.key * 7 % 3 = 0) = (b.key * 7 % 3 = 0))"
REACH = """both_ways AS (SELECT unit_a AS a, unit_b AS b FROM cut UNION ALL SELECT unit_b, unit_a FROM cut),
 reach AS (SELECT unit_id AS a, unit_id AS b FROM nations UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b), roots AS (SELECT a AS unit_id, min(b) AS root FROM reach GROUP BY 1)"""


def _cut_edges(spark, d):
    n = star.nations(spark, d)
    side = lambda u, f: n.select(F.col("unit_id").alias(u), (F.col("key") * 7 % 3 == 0).alias(f))
    return _rook(spark, d).join(side("unit_a", "fa"), "unit_a").join(side("unit_b", "fb"), "unit_b").filter("fa = fb").select("unit_a", "unit_b", "shared_edge_metres")


@query("SELECT unit_id, root FROM roots", "RECURSIVE " + SQL["nations"], "rook", CUT_EDGES, REACH)
def connected_parts(spark, d):
    return network.connected_parts(star.nations(spark, d), _cut_edges(spark, d))


@query(
    """WITH RECURSIVE both_sides AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_discount = 0 AND l_quantity >= 49),
    steps AS (SELECT DISTINCT x.s AS a, y.s AS b FROM both_sides x JOIN both_sides y USING (p)),
    reach AS (SELECT s_suppkey AS a, s_suppkey AS b FROM supplier UNION SELECT r.a, e.b FROM reach r JOIN steps e ON e.a = r.b)
    SELECT 'S' || a AS unit_id, 'S' || min(b) AS root FROM reach GROUP BY a ORDER BY 1""",
    "nations",
)
def connected_parts_in_rounds(spark, d):
    """Suppliers that are linked by parts which both deliver in bulk and without discount: the way of large graphs, in rounds of grouped minima."""
    both = star.table(spark, d, "lineitem").filter("l_discount = 0 AND l_quantity >= 49").select("l_partkey", "l_suppkey").distinct()
    first = both.groupBy("l_partkey").agg(F.min("l_suppkey").alias("first"))  # a star for each part, not all its pairs
    edges = both.join(first, "l_partkey").filter("l_suppkey <> first").select(F.col("l_suppkey").alias("a"), F.col("first").alias("b"))
    roots = components.connected_components(edges, "supplier-parts")
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    units = star.table(spark, d, "supplier").join(roots.withColumnRenamed("node", "s_suppkey"), "s_suppkey", "left")
    return units.select(name(F.col("s_suppkey")).alias("unit_id"), name(F.coalesce("root", "s_suppkey")).alias("root"))


@query(
    """WITH grouped AS (SELECT n.group_id, r.root, count(*) AS k, min(n.unit_id) AS first FROM striped n JOIN roots r USING (unit_id) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY k DESC, first) AS rk FROM grouped)
    SELECT n.group_id, n.unit_id FROM striped n JOIN roots r USING (unit_id) JOIN ranked x ON x.group_id = n.group_id AND x.root = r.root WHERE rk > 1""",
    "RECURSIVE " + SQL["nations"], "rook", "striped AS (SELECT unit_id, 'G' || CAST(CAST(substr(unit_id, 2) AS INT) % 3 AS VARCHAR) AS group_id FROM nations)",
    "cut AS (SELECT r.* FROM rook r JOIN striped a ON a.unit_id = unit_a JOIN striped b ON b.unit_id = unit_b WHERE a.group_id = b.group_id)", REACH,
)
def stranded(spark, d):
    """Over groups that lie in stripes across the lattice, in several parts each."""
    units = star.nations(spark, d).select("unit_id", F.concat(F.lit("G"), (F.substring("unit_id", 2, 9).cast("int") % 3).cast("string")).alias("group_id"))
    return allocate.stranded(network.parts_within(units, _rook(spark, d)), units)


@query(
    """SELECT a.group_id, string_agg(a.unit_id, ',' ORDER BY a.unit_id) AS members, count(*) AS n, count(DISTINCT r.root) = 1 AS connected,
    round(max(a.straddle_score), 6) AS highest_straddle, round(avg(a.straddle_score), 6) AS mean_straddle FROM given a JOIN roots r USING (unit_id) GROUP BY 1""",
    "RECURSIVE " + SQL["nations"], "rook", BOX_OVERLAP,
    "given AS (SELECT child_id AS unit_id, parent_id AS group_id, 1 - round(share, 9) AS straddle_score FROM (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY round(share, 9) DESC, parent_id) AS r FROM shares) WHERE r = 1)",
    "cut AS (SELECT r.* FROM rook r JOIN given a ON a.unit_id = unit_a JOIN given b ON b.unit_id = unit_b WHERE a.group_id = b.group_id)", REACH,
)
def region_summary(spark, d):
    """Member lists, connectedness and straddle of the regions that nations go to by majority."""
    shares = _shares(spark, d).select(F.col("child_id").alias("unit_id"), F.col("parent_id").alias("cluster"), F.round("share", 9).alias("share"))
    given = allocate.majority(shares).select("unit_id", F.col("majority_cluster").alias("group_id"), "straddle_score")
    out = allocate.region_summary(given, network.parts_within(given.select("unit_id", "group_id"), _rook(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("highest_straddle", "mean_straddle")})


@query(
    """WITH near AS (SELECT unit_a AS u, unit_b AS v, shared_edge_metres AS m FROM rook UNION ALL SELECT unit_b, unit_a, shared_edge_metres FROM rook),
    s AS (SELECT u, b.group_id, sum(m) AS metres FROM near JOIN nations a ON a.unit_id = u JOIN nations b ON b.unit_id = v WHERE a.group_id <> b.group_id GROUP BY 1, 2)
    SELECT u AS unit_id, group_id, metres AS shared_edge_metres FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY metres DESC, group_id DESC) AS r FROM s) WHERE r = 1""",
    "nations", "rook",
)
def best_neighbour(spark, d):
    units = star.nations(spark, d).select("unit_id", "group_id")
    return allocate.best_neighbour(units, _rook(spark, d), units)


SCORES = f"scores AS (SELECT point_id, date, variable, log(1 + value) AS value FROM monthly WHERE date <= DATE '{BUILD_END}')"


def _scores(spark, d):
    s = anomaly.in_window(star.monthly(spark, d), end=BUILD_END)
    return s.withColumn("value", F.log10(1 + F.col("value")))


@query(f"SELECT a.point_id AS point_a, b.point_id AS point_b, {R6('sum((a.value - b.value) ^ 2)')} AS squared_distance FROM scores a JOIN scores b ON a.date = b.date AND a.variable = b.variable AND a.point_id < b.point_id GROUP BY 1, 2", "priced", "monthly", SCORES)
def pairwise_sqdist(spark, d):
    return tree.squared_distances(_scores(spark, d)).withColumn("squared_distance", tidy(F.col("squared_distance")))



@query(
    f"""WITH full_days AS (SELECT date FROM monthly WHERE variable = 'value' AND date <= DATE '{BUILD_END}' GROUP BY 1 HAVING count(*) = 25),
    m AS (SELECT point_id, date, value FROM monthly WHERE variable = 'value' AND date IN (SELECT date FROM full_days)),
    z AS (SELECT point_id, date, (value - avg(value) OVER (PARTITION BY point_id)) / stddev_pop(value) OVER (PARTITION BY point_id) AS value FROM m)
    SELECT a.point_id AS point_a, b.point_id AS point_b, {R6('sum((a.value - b.value) ^ 2) / (2 * count(*))')} AS half_distance, {R6('1 - covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value))')} AS one_minus_r
    FROM z a JOIN z b ON a.date = b.date AND a.point_id < b.point_id GROUP BY 1, 2""",
    "priced", "monthly",
)
def distance_identity(spark, d):
    """On z-scores |a - b|^2 = 2n(1 - r)."""
    m = anomaly.in_window(star.monthly(spark, d).filter("variable = 'value'"), end=BUILD_END)
    full = m.groupBy("date").count().filter("count = 25").select("date")
    m = m.join(full, "date", "left_semi")
    p = m.groupBy("point_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = m.join(p, "point_id").select("point_id", "date", "variable", ((F.col("value") - F.col("mean")) / F.col("std")).alias("value"))
    dist = tree.squared_distances(z).crossJoin(F.broadcast(full.agg(F.count("*").alias("n"))))
    corr = score.pair_correlations(z.withColumnRenamed("point_id", "unit_id")).select(F.col("unit_a").alias("point_a"), F.col("unit_b").alias("point_b"), "correlation")
    return dist.join(corr, ["point_a", "point_b"]).select("point_a", "point_b", tidy(F.col("squared_distance") / (2 * F.col("n"))).alias("half_distance"), tidy(1 - F.col("correlation")).alias("one_minus_r"))


def _tree(spark, d):
    return tree.ward_tree(_scores(spark, d), _rook(spark, d))


@query()
def ward_tree(spark, d):
    return tree.tree_table(spark, *_tree(spark, d)).withColumn("height", F.round("height", 9))


@query()
def ward_cuts(spark, d):
    return tree.label_table(spark, *_tree(spark, d), [2, 3, 5, 8])


@query()
def inversions(spark, d):
    return tree.inversions(tree.tree_table(spark, *_tree(spark, d)))


TABLE = "tab AS (SELECT n_regionkey AS a, n_nationkey % 4 AS b, count(*) AS n FROM nation GROUP BY 1, 2)"


def _labellings(spark, d):
    n = star.table(spark, d, "nation")
    of = lambda c: n.select(F.col("n_nationkey").alias("point_id"), c.alias("cluster"))
    return of(F.col("n_regionkey")), of(F.col("n_nationkey") % 4)


@query("SELECT a, b, n FROM tab", TABLE)
def contingency(spark, d):
    return tree.contingency(*_labellings(spark, d))


@query(
    """WITH s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM tab) AS ij, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM tab GROUP BY a)) AS i, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM tab GROUP BY b)) AS j, (SELECT sum(n) FROM tab) AS n)
    SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 9) AS adjusted_rand FROM s""",
    TABLE,
)
def adjusted_rand(spark, d):
    return tree.adjusted_rand(tree.contingency(*_labellings(spark, d))).withColumn("adjusted_rand", F.round("adjusted_rand", 9))


# ---- judging a map ---------------------------------------------------------------------------------------------------


def eta_sql(series: str, group: str, by: str = "date, variable") -> str:
    """Common tables parts, whole and etas: variance between and within groups."""
    match = " AND ".join(f"p.{c.strip()} = w.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"p.{c.strip()}" for c in by.split(","))
    return f"""parts AS (SELECT {by}, {group} AS g, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM {series} GROUP BY {by}, g),
    whole AS (SELECT {by}, sum(n * m) / sum(n) AS mean FROM parts GROUP BY {by}),
    sums AS (SELECT {cols}, sum(n * (m - mean) ^ 2) AS b, sum(n * v) AS w FROM parts p JOIN whole w ON {match} GROUP BY {cols}),
    etas AS (SELECT {by}, CASE WHEN b + w > 1e-12 THEN b / (b + w) END AS eta FROM sums)"""


MAPPED = "mapped AS (SELECT m.point_id AS unit_id, date, variable, value, group_id, key FROM monthly m JOIN nations n ON n.unit_id = m.point_id)"
MAP_CHAIN = ("priced", "monthly", "nations", MAPPED)


def _units(spark, d):
    return star.monthly(spark, d).withColumnRenamed("point_id", "unit_id")


def _groups(spark, d):
    return star.nations(spark, d).select("unit_id", "group_id")


def _etas(spark, d):
    return score.eta_squared(_units(spark, d), _groups(spark, d))


@query(f"SELECT date, variable, {R9('eta')} AS eta_squared FROM etas", *MAP_CHAIN, eta_sql("mapped", "group_id"))
def eta_monthly(spark, d):
    """How much of the variance of monthly orders between nations lies between regions."""
    return _etas(spark, d).withColumn("eta_squared", tidy(F.col("eta_squared"), 9))


@query(f"SELECT date, variable, {R9('eta')} AS eta_squared FROM etas", "priced", "daily", "nations", "mapped AS (SELECT m.point_id AS unit_id, date, variable, value, group_id FROM daily m JOIN nations n ON n.unit_id = m.point_id)", eta_sql("mapped", "group_id"))
def eta_daily(spark, d):
    s = star.daily(spark, d).withColumnRenamed("point_id", "unit_id")
    return score.eta_squared(s, _groups(spark, d)).withColumn("eta_squared", tidy(F.col("eta_squared"), 9))


@query(f"WITH by_variable AS (SELECT variable, avg(eta) AS e FROM etas GROUP BY 1) SELECT variable, {R6('e')} AS eta_squared FROM by_variable UNION ALL SELECT 'mean', {R6('avg(e)')} FROM by_variable", *MAP_CHAIN, eta_sql("mapped", "group_id"))
def eta_summary(spark, d):
    each = score.mean_eta(_etas(spark, d))
    every = each.agg(F.avg("eta_squared").alias("eta_squared")).select(F.lit("mean").alias("variable"), "eta_squared")
    return each.unionByName(every).withColumn("eta_squared", tidy(F.col("eta_squared")))


@query(f"SELECT variable, {R6('avg(eta)')} AS ceiling FROM etas GROUP BY 1", "priced", "small", eta_sql("small", "parent_id"))
def ceiling(spark, d):
    """Between-parent share of the small areas' variance: what any map of whole parents can reach."""
    s = star.small_areas(spark, d)
    groups = s.select("unit_id", F.col("parent_id").alias("group_id")).distinct()
    return score.mean_eta(score.eta_squared(s.drop("parent_id"), groups)).select("variable", tidy(F.col("eta_squared")).alias("ceiling"))


@query(f"SELECT variable, {R6('avg(eta)')} AS variance_explained FROM etas GROUP BY 1", *MAP_CHAIN, eta_sql("mapped", "key % 3"))
def point_variance(spark, d):
    clusters = star.nations(spark, d).select("unit_id", (F.col("key") % 3).alias("group_id"))
    return score.mean_eta(score.eta_squared(_units(spark, d), clusters)).select("variable", tidy(F.col("eta_squared")).alias("variance_explained"))


SHARE_W = "share_w AS (SELECT parent_id AS unit_id, child_id AS point_id, area / sum(area) OVER (PARTITION BY parent_id) AS weight FROM shares)"


@query("SELECT unit_id, date, variable, round(sum(weight * value), 4) AS value FROM share_w JOIN monthly USING (point_id) GROUP BY 1, 2, 3", "priced", "monthly", "nations", BOX_OVERLAP, SHARE_W)
def unit_series(spark, d):
    areas = _shares(spark, d).select(F.col("parent_id").alias("unit_id"), F.col("child_id").alias("point_id"), "area")
    return score.unit_series(star.monthly(spark, d), score.share_weights(areas)).withColumn("value", F.round("value", 4))


@query(
    f"""WITH pairs AS (SELECT a.variable, a.unit_id AS ua, b.unit_id AS ub, a.group_id = b.group_id AS same, covar_pop(a.value, b.value) / CASE WHEN stddev_pop(a.value) * stddev_pop(b.value) > 1e-12 THEN stddev_pop(a.value) * stddev_pop(b.value) END AS c
    FROM mapped a JOIN mapped b ON a.date = b.date AND a.variable = b.variable AND a.unit_id < b.unit_id GROUP BY 1, 2, 3, 4)
    SELECT {R6('avg(c) FILTER (WHERE same)')} AS within, {R6('avg(c) FILTER (WHERE NOT same)')} AS between FROM pairs""".replace("AS between", 'AS "between"').replace("AS within", 'AS "within"'),
    *MAP_CHAIN,
)
def corr_within_between(spark, d):
    out = score.within_between(score.pair_correlations(_units(spark, d)), _groups(spark, d))
    return out.select(tidy(F.col("within")).alias("within"), tidy(F.col("between")).alias("between"))


DRAWS = "drawn AS (SELECT t.i AS draw, m.unit_id, m.date, m.variable, m.value, (m.key * (2 * t.i + 1) + t.i) % 7 % 5 AS g FROM mapped m, range(0, 20) t(i))"


def _fixed_draws(spark, d):
    """Maps by arithmetic, so that SQL has the same."""
    n = star.nations(spark, d).select("unit_id", "key")
    i = F.col("draw")
    return n.withColumn("draw", F.explode(F.expr("sequence(0L, 19L)"))).select("draw", "unit_id", ((F.col("key") * (2 * i + 1) + i) % 7 % 5).alias("group_id"))


ETAS_DRAWN = (*MAP_CHAIN, DRAWS, eta_sql("drawn", "g", "draw, date, variable"), "draws AS (SELECT draw, variable, avg(eta) AS e FROM etas GROUP BY 1, 2)")


@query(f"SELECT draw, variable, {R6('e')} AS eta_squared FROM draws", *ETAS_DRAWN)
def map_benchmark(spark, d):
    return score.map_scores(_units(spark, d), _fixed_draws(spark, d)).withColumn("eta_squared", tidy(F.col("eta_squared")))


@query(f"SELECT variable, {R6('min(e)')} AS minimum, {R6('median(e)')} AS median, {R6('max(e)')} AS maximum, {R6('avg(e)')} AS mean FROM draws GROUP BY 1", *ETAS_DRAWN)
def benchmark_spread(spark, d):
    out = score.spread(score.map_scores(_units(spark, d), _fixed_draws(spark, d)))
    return out.select("variable", *[tidy(F.col(c)).alias(c) for c in ("minimum", "median", "maximum", "mean")])


@query(
    "WITH base AS (SELECT variable, e AS own FROM draws WHERE draw = 7) SELECT d.variable, round(100 * avg(CASE WHEN round(e, 6) <= round(own, 6) THEN 1 ELSE 0 END), 3) AS placing FROM draws d JOIN base USING (variable) GROUP BY 1",
    *ETAS_DRAWN,
)
def percentile_placing(spark, d):
    draws = score.map_scores(_units(spark, d), _fixed_draws(spark, d))
    own = draws.filter("draw = 7").select("variable", F.col("eta_squared").alias("own"))
    return draws.join(own, "variable").groupBy("variable").agg(score.placing(F.col("eta_squared"), F.col("own")).alias("placing"))


@query("SELECT variable, CAST(least(25, floor((e - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 25) + 1) AS INT) AS bin, count(*) AS n FROM draws JOIN (SELECT variable, min(e) AS lo, max(e) AS hi FROM draws GROUP BY 1) USING (variable) GROUP BY 1, 2", *ETAS_DRAWN)
def histogram_25(spark, d):
    draws = score.map_scores(_units(spark, d), _fixed_draws(spark, d))
    ends = draws.groupBy("variable").agg(F.min("eta_squared").alias("lo"), F.max("eta_squared").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    bin_ = F.least(F.lit(25), F.floor((F.col("eta_squared") - F.col("lo")) / width * 25) + 1).cast("int")
    return draws.join(ends, "variable").groupBy("variable", bin_.alias("bin")).agg(F.count("*").alias("n"))


@query()
def random_benchmark(spark, d):
    """Random contiguous maps of as many regions as the present map has, scored."""
    units = [r.unit_id for r in star.nations(spark, d).select("unit_id").collect()]  # the lattice's 25
    edges = [(r.unit_a, r.unit_b) for r in _rook(spark, d).collect()]
    maps = network.random_maps(spark, units, edges, 5, 100, 20260921)
    return score.map_scores(_units(spark, d), maps).withColumn("eta_squared", tidy(F.col("eta_squared")))


NO_WINNER = "won AS (SELECT date, point_id FROM (SELECT date, point_id, row_number() OVER (PARTITION BY date ORDER BY round(value, 3) DESC, point_id) AS r FROM monthly WHERE variable = 'value') WHERE r = 1)"


@query("SELECT unit_id AS cluster FROM nations WHERE unit_id NOT IN (SELECT point_id FROM won)", "priced", "monthly", "nations", NO_WINNER)
def no_winner_anti(spark, d):
    """Nations that are the largest of no month."""
    shares = star.monthly(spark, d).filter("variable = 'value'").select(F.col("date").alias("unit_id"), F.col("point_id").alias("cluster"), F.round("value", 3).alias("share"))
    return allocate.winning_none(star.nations(spark, d).select(F.col("unit_id").alias("cluster")), allocate.majority(shares))


@query(
    """WITH near AS (SELECT unit_a AS parent_id, unit_b AS o FROM rook UNION ALL SELECT unit_b, unit_a FROM rook),
    rivals AS (SELECT DISTINCT parent_id, n.group_id FROM near JOIN nations n ON n.unit_id = o UNION SELECT unit_id, group_id FROM nations),
    placed AS (SELECT s.*, group_id FROM small s JOIN nations n ON n.unit_id = parent_id),
    sums AS (SELECT group_id, date, variable, sum(value) AS s, count(*) AS n FROM placed GROUP BY 1, 2, 3),
    own AS (SELECT parent_id, group_id, date, variable, sum(value) AS s, count(*) AS n FROM placed GROUP BY 1, 2, 3, 4),
    others AS (SELECT r.parent_id, r.group_id, x.date, x.variable, (x.s - coalesce(o.s, 0)) / nullif(x.n - coalesce(o.n, 0), 0) AS mean FROM rivals r JOIN sums x USING (group_id)
      LEFT JOIN own o ON o.parent_id = r.parent_id AND o.group_id = r.group_id AND o.date = x.date AND o.variable = x.variable),
    each AS (SELECT s.unit_id, s.parent_id, o.group_id, s.variable, covar_pop(s.value, o.mean) / CASE WHEN stddev_pop(s.value) * stddev_pop(o.mean) > 1e-12 THEN stddev_pop(s.value) * stddev_pop(o.mean) END AS c
      FROM small s JOIN (SELECT * FROM others WHERE mean IS NOT NULL) o ON o.parent_id = s.parent_id AND o.date = s.date AND o.variable = s.variable GROUP BY 1, 2, 3, 4),
    scored AS (SELECT unit_id, parent_id, group_id, round(avg(c), 9) AS score FROM each GROUP BY 1, 2, 3 HAVING avg(c) IS NOT NULL),
    ranked AS (SELECT s.*, n.group_id AS own_group, row_number() OVER (PARTITION BY s.unit_id ORDER BY score DESC, s.group_id DESC) AS r, count(*) OVER (PARTITION BY s.unit_id) AS n,
      max(score) FILTER (WHERE s.group_id = n.group_id) OVER (PARTITION BY s.unit_id) AS own_score FROM scored s JOIN nations n ON n.unit_id = s.parent_id)
    SELECT unit_id, own_group, group_id AS best_group, round(own_score, 6) AS own_score, round(score, 6) AS best_score, group_id <> own_group AS misfit FROM ranked WHERE r = 1 AND n >= 2 AND own_score IS NOT NULL""",
    "priced", "small", "nations", "rook",
)
def misfits(spark, d):
    s = star.small_areas(spark, d)
    parents = s.select("unit_id", "parent_id").distinct()
    groups = star.nations(spark, d).select(F.col("unit_id").alias("parent_id"), "group_id")
    edges = _rook(spark, d).select(F.col("unit_a").alias("parent_a"), F.col("unit_b").alias("parent_b"))
    out = score.misfits(s.drop("parent_id"), parents, groups, edges)
    return out.withColumns({"own_score": F.round("own_score", 6), "best_score": F.round("best_score", 6)})
