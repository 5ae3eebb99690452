"""The planted country as a data source of its own: spark.read.format("zonewright-country")."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from zonewright.sources import planted

#: Days of one variable that one task makes.
DAYS_A_PART = 180


class RealSourceError(ValueError):
    """The real inputs are not connected; nothing is guessed in their place."""


@dataclass
class Stretch(InputPartition):
    """A variable over some days, both ends included."""

    variable: str
    first: date
    last: date


def planted_values(variable: str, days: np.ndarray) -> np.ndarray:
    """(days, points) of the planted weather, rounded to a decimal: planted.weather_value on arrays. days count from the first."""
    w = planted.VARIABLES[variable]
    places = [(x, y) for y in planted.NORTHINGS for x in planted.EASTINGS] + [planted.OFFSHORE[1:], planted.ISLAND_POINT[1:]]
    wave = lambda d, period: np.sin(2 * np.pi * d / period)
    d, i = days[:, None].astype(np.float64), np.arange(len(places))[None, :]
    east = np.array([x >= planted.EASTINGS[2] for x, _ in places])[None, :]
    v = w.base + w.seasonal * wave(d + 138, 365.25) + w.national * wave(d, 97) + np.where(east, w.regime, -w.regime) * wave(d, 53) + w.point * wave(d + 7 * i, 29)
    v = v if w.floor is None else np.maximum(v, w.floor)
    return np.floor(np.abs(v) * 10 + 0.5) / 10 * np.sign(v)


class WeatherReader(DataSourceReader):
    """One partition for each variable and stretch of days; days outside the window are never made."""

    def __init__(self, variables: list[str], first: date, last: date):
        self.variables, self.first, self.last = variables, first, last

    def partitions(self) -> list[Stretch]:
        out = []
        for v in self.variables:
            at = self.first
            while at <= self.last:
                end = min(self.last, at + timedelta(DAYS_A_PART - 1))
                out.append(Stretch(v, at, end))
                at = end + timedelta(1)
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        n = (partition.last - partition.first).days + 1
        days = np.arange(n) + (partition.first - planted.START).days
        values = planted_values(partition.variable, days)
        dates = [partition.first + timedelta(k) for k in range(n)]
        if partition.variable == "rain":
            dry = [date.fromisoformat(x) for x in planted.DRY]
            values[[dry[0] <= d <= dry[1] for d in dates]] = 0.0
        names = [f"P{k + 1:02d}" for k in range(values.shape[1])]
        hole = [(partition.variable, n, d.isoformat()) == (planted.MISSING[1], planted.MISSING[0], planted.MISSING[2]) for d in dates for n in names]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names * n),
                pa.array([d for d in dates for _ in names], pa.date32()),
                pa.array([partition.variable] * (n * len(names))),
                pa.array(values.ravel(), mask=np.array(hole)),
            ],
            names=["point_id", "date", "variable", "value"],
        )


class CountrySource(DataSource):
    """Weather of the planted country, long. Options: variables (comma-separated), start, end, source (planted, real).

    The real source refuses to be read: its files' columns have not been confirmed, so there is nothing to read them by.
    """

    @classmethod
    def name(cls) -> str:
        return "zonewright-country"

    def schema(self) -> str:
        return "point_id string, date date, variable string, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.options.get("source", "planted") == "real":
            refuse_real("weather", self.options.get("path", "no path"))
        variables = [v.strip() for v in self.options.get("variables", ",".join(planted.VARIABLES)).split(",")]
        if unknown := [v for v in variables if v not in planted.VARIABLES]:
            raise ValueError(f"unknown variables: {', '.join(unknown)}")
        day = lambda key, default: date.fromisoformat(self.options[key]) if key in self.options else default
        return WeatherReader(variables, max(planted.START, day("start", planted.START)), min(planted.END, day("end", planted.END)))


def refuse_real(kind: str, path: str) -> None:
    raise RealSourceError(f"the real {kind} input at {path} is not connected yet: confirm its columns before wiring it up rather than guessing them")


def country(spark: SparkSession, **options: str):
    """Weather through the data source."""
    spark.dataSource.register(CountrySource)
    return spark.read.format(CountrySource.name()).options(**options).load()
