"""A planted country with a known answer: sixteen grid points in two regimes, an island, an offshore point."""

from __future__ import annotations

import math
from datetime import date
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.operators.geometry import SHAPE
from zonewright.operators.projection import to_degrees
from zonewright.sources import sinks

# What the planted inputs are made of.
START, END = date(2023, 9, 1), date(2025, 8, 31)
BUILD_END, HELD_START = "2024-08-31", "2024-09-01"
EASTINGS, NORTHINGS = (400_000, 425_000, 450_000, 475_000), (300_000, 325_000, 350_000, 375_000)
OFFSHORE, ISLAND_POINT = ("P17", 560_000, 240_000), ("P18", 560_000, 340_000)
LAND, ISLAND = (387_500, 287_500, 487_500, 387_500), (555_000, 335_000, 565_000, 345_000)


class Wave(NamedTuple):
    base: float
    seasonal: float
    national: float
    regime: float
    point: float
    floor: float | None = None


VARIABLES = {
    "tmin": Wave(5, 6, 1.6, 2.4, 0.35),
    "tmax": Wave(13, 8, 2.0, 3.0, 0.45),
    "rain": Wave(3, -1, 0.8, 1.1, 0.18, 0.0),
    "wind": Wave(9, -2.5, 1.8, 2.2, 0.30),
}
DRY = ("2024-07-01", "2024-07-14")
MISSING = ("P07", "tmax", "2024-03-15")
PGAS = ("PGA-NW", "PGA-NE", "PGA-SW", "PGA-SE")


def turn(d: Column, period: float) -> Column:
    return F.sin(2 * math.pi * d / period)


def weather_value(w: Wave, d: Column, i: Column, east: Column) -> Column:
    """Unrounded value of day d (from 0) at the i-th point (from 0)."""
    regime = F.when(east, F.lit(w.regime)).otherwise(F.lit(-w.regime))
    v = w.base + w.seasonal * turn(d + 138, 365.25) + w.national * turn(d, 97) + regime * turn(d, 53) + w.point * turn(d + 7 * i, 29)
    return v if w.floor is None else F.greatest(v, F.lit(w.floor))


def points(spark: SparkSession) -> DataFrame:
    """(point_id, x, y, i)."""
    grid = [(x, y) for y in NORTHINGS for x in EASTINGS]
    rows = [(f"P{i + 1:02d}", float(x), float(y), i) for i, (x, y) in enumerate(grid)]
    rows += [(name, float(x), float(y), 16 + k) for k, (name, x, y) in enumerate((OFFSHORE, ISLAND_POINT))]
    return spark.createDataFrame(rows, "point_id string, x double, y double, i int")


def days(spark: SparkSession) -> DataFrame:
    n = (END - START).days + 1
    return spark.range(n).select(F.col("id").cast("int").alias("d"), F.date_add(F.lit(START), F.col("id").cast("int")).alias("date"))


def weather(spark: SparkSession) -> DataFrame:
    """Long (point_id, date, variable, value), one decimal, with a dry spell and one missing reading."""
    at = days(spark).crossJoin(F.broadcast(points(spark)))  # 731 days by 18 points
    east = F.col("x") >= EASTINGS[2]
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.round(weather_value(w, F.col("d"), F.col("i"), east), 1).alias("value")) for v, w in VARIABLES.items()])
    long = at.select("point_id", "date", F.inline(each))
    dry = (F.col("variable") == "rain") & F.col("date").between(*[F.lit(x).cast("date") for x in DRY])
    gone = (F.col("point_id") == MISSING[0]) & (F.col("variable") == MISSING[1]) & (F.col("date") == F.lit(MISSING[2]).cast("date"))
    return long.withColumn("value", F.when(gone, None).when(dry, 0.0).otherwise(F.col("value")))


def demand(spark: SparkSession) -> DataFrame:
    """Long (date, pga_id, demand)."""
    value = lambda j, pga: F.round((4 if pga.endswith("E") else -4) * turn(F.col("d"), 53) + 0.6 * turn(F.col("d") + 11 * j, 37), 1)
    each = F.array(*[F.struct(F.lit(p).alias("pga_id"), value(j, p).alias("demand")) for j, p in enumerate(PGAS)])
    return days(spark).select("date", F.inline(each))


def _box(x0: float, y0: float, x1: float, y1: float) -> list:
    corners = ((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    return [[{"x": float(x), "y": float(y)} for x, y in corners]]


def layers(spark: SparkSession) -> dict[str, DataFrame]:
    """ra (id, parent_id, shape), pga (id, parent_id, shape) and nca (id, shape): half the land a band, a quarter, a half."""
    x0, y0, x1, y1 = LAND
    xm, step = (x0 + x1) / 2, (y1 - y0) / 4
    ra, pga, nca = [], {}, {}
    for half, first in (("S", 0), ("N", 2)):
        for side, (a, b) in (("W", (x0, xm)), ("E", (xm, x1))):
            name = f"PGA-{half}{side}"
            own = [_box(a, y0 + first * step, b, y0 + (first + 2) * step)]
            for band in (1, 2):
                shape = [_box(a, y0 + (first + band - 1) * step, b, y0 + (first + band) * step)]
                island = [_box(*ISLAND)] if f"{half}{side}{band}" == "NE1" else []
                ra.append((f"RA-{half}{side}-{band}", name, shape + island))
                own += island
            pga[name] = (name, f"NCA-{half}", own)
    for half, first in (("S", 0), ("N", 2)):
        nca[half] = (f"NCA-{half}", [_box(x0, y0 + first * step, x1, y0 + (first + 2) * step)] + ([_box(*ISLAND)] if half == "N" else []))
    return {
        "ra": spark.createDataFrame(ra, f"id string, parent_id string, shape {SHAPE}"),
        "pga": spark.createDataFrame(list(pga.values()), f"id string, parent_id string, shape {SHAPE}"),
        "nca": spark.createDataFrame(list(nca.values()), f"id string, shape {SHAPE}"),
    }


def expected_labels(spark: SparkSession) -> DataFrame:
    """(point_id, cluster) at two clusters: the answer that is planted. The offshore point has no land, so no label."""
    known = points(spark).filter(F.col("point_id") != OFFSHORE[0])
    return known.select("point_id", F.when(F.col("x") < EASTINGS[2], "P01").otherwise("P03").alias("cluster"))


def degree_layer(layer: DataFrame) -> DataFrame:
    """A layer in longitudes and latitudes; its shapes go apart into corners, through columns, and together again."""
    at = F.posexplode
    flat = layer.select("id", at("shape").alias("p", "polygon")).select("id", "p", at("polygon").alias("r", "ring")).select("id", "p", "r", at("ring").alias("i", "corner"))
    back = to_degrees(flat.select("id", "p", "r", "i", "corner.x", "corner.y")).select("id", "p", "r", "i", F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y")).alias("v"))
    for keys, number in ((["id", "p", "r"], "i"), (["id", "p"], "r"), (["id"], "p")):
        back = back.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(number, "v"))), lambda s: s["v"]).alias("v"))
    return layer.drop("shape").join(back.withColumnRenamed("v", "shape"), "id", "left")


SETTINGS = """[inputs]
points = "points.csv"
weather = "weather"
demand = "demand.csv"

[layers.ra]
path = "ra.geojson"
id_column = "RA_ID"
parent_id_column = "PGA_ID"

[layers.pga]
path = "pga.geojson"
id_column = "PGA_ID"
parent_id_column = "NCA_ID"

[layers.nca]
path = "nca.geojson"
id_column = "NCA_ID"

[settings]
build_start = "2023-09-01"
manual_links = [["P18", "P12"]]
missing_data = "drop_day"
cuts_to_save = [2, 3]
"""


def write(spark: SparkSession, folder: str, settings: str = SETTINGS) -> list[str]:
    """The planted inputs as a run reads them: text files of a known answer, the same bytes each time. Gives their names."""
    base = Path(folder)
    (base / "weather").mkdir(parents=True, exist_ok=True)
    degrees = to_degrees(points(spark)).select("point_id", F.format_string("%.8f", "latitude").alias("latitude"), F.format_string("%.8f", "longitude").alias("longitude"))
    sinks.write_csv(degrees, str(base / "points.csv"), ["point_id"])
    names = {"ra": ("RA_ID", "PGA_ID"), "pga": ("PGA_ID", "NCA_ID"), "nca": ("NCA_ID", None)}
    for level, layer in layers(spark).items():
        own, parent = names[level]
        out = degree_layer(layer).withColumnRenamed("id", own)
        out = out.withColumnRenamed("parent_id", parent) if parent else out.drop("parent_id")
        sinks.write_geojson(out, str(base / f"{level}.geojson"), [own], places=13)
    for v in VARIABLES:
        wide = weather(spark).filter(F.col("variable") == v).groupBy("date").pivot("point_id").agg(F.first("value"))
        sinks.write_csv(wide, str(base / "weather" / f"weather-{v}.csv"), ["date"])
    sinks.write_csv(demand(spark).groupBy("date").pivot("pga_id").agg(F.first("demand")), str(base / "demand.csv"), ["date"])
    sinks.write_csv(expected_labels(spark), str(base / "cluster-labels-k2.expected.csv"), ["point_id"])
    (base / "settings.toml").write_text(settings, newline="\n")
    return sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_file())
