"""Guarded readers of points, layers, weather and demand."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from zonewright.operators.anomaly import in_window
from zonewright.operators.geometry import SHAPE
from zonewright.sources.country import refuse_real


class InputError(ValueError):
    """An input lacks a column, repeats a key, or cannot be used."""


class SealedWindowError(PermissionError):
    """Days at or after the sealed start were asked for, or lie in the file."""


class FirewallError(PermissionError):
    """Demand was asked for outside the evaluate stage."""


def require_columns(df: DataFrame, needed: list[str], what: str) -> None:
    if missing := [c for c in needed if c not in df.columns]:
        raise InputError(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")


@dataclass
class StageReader:
    """Reads the inputs for one stage, and keeps a record of each read that was allowed."""

    spark: SparkSession
    stage: str
    sealed_start: str
    sealed_override: bool = False
    reads: list[dict] = field(default_factory=list)
    real: bool = False
    observed: list[tuple[dict, Observation]] = field(default_factory=list)

    def _recorded(self, df: DataFrame, entry: dict) -> DataFrame:
        """df, counted by whatever job reads it first; settle() takes the figures over into the record."""
        seen = Observation()
        days = [F.min("date").alias("first"), F.max("date").alias("last")] if "date" in df.columns else []
        self.observed.append((entry, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *days)

    def settle(self) -> None:
        """Rows and days of every read into its entry. For a stage that has ended: each read has been through a job then."""
        for entry, seen in self.observed:
            entry |= {k: v if k == "rows" or v is None else str(v) for k, v in seen.get.items()}
        self.observed.clear()

    def _connected(self, kind: str, path: str) -> None:
        if self.real:
            refuse_real(kind, path)

    def _asked(self, kind: str, path: str, start: str | None, end: str | None) -> dict:
        """The entry of a read that is allowed; refuses a window that reaches the sealed days."""
        self._connected(kind, path)
        reaches = end is None or end >= self.sealed_start
        if reaches and not self.sealed_override:
            raise SealedWindowError(f"{kind} up to {end or 'the end'}: days from {self.sealed_start} are sealed")
        self.reads.append({"stage": self.stage, "kind": kind, "path": path, "start": start, "end": end, "override": reaches})
        return self.reads[-1]

    def _unsealed(self, df: DataFrame, kind: str) -> None:
        """Looks through the whole file, before any window is cut: sealed rows in it are refused wherever they are."""
        if self.sealed_override:
            return
        first = df.filter(F.col("date") >= F.lit(self.sealed_start).cast("date")).agg(F.min("date")).first()[0]
        if first is not None:
            raise SealedWindowError(f"the {kind} file has days from {first}; {self.sealed_start} on is sealed")

    def _wide(self, path: str, key: str, value: str) -> DataFrame:
        """One column a unit, as long rows; ids stay text and dates are strict."""
        wide = self.spark.read.option("header", True).csv(path)
        require_columns(wide, ["date"], path)
        units = [c for c in wide.columns if c != "date"]
        long = wide.unpivot(["date"], units, key, value)
        return long.select(F.to_date("date", "yyyy-MM-dd").alias("date"), key, F.col(value).cast("double").alias(value))

    def points(self, path: str) -> DataFrame:
        """(point_id, latitude, longitude)."""
        self._connected("points", path)
        df = self.spark.read.option("header", True).csv(path)
        require_columns(df, ["point_id", "latitude", "longitude"], path)
        self.reads.append({"stage": self.stage, "kind": "points", "path": path})
        return self._recorded(df.select("point_id", F.col("latitude").cast("double"), F.col("longitude").cast("double")), self.reads[-1])

    def layer(self, path: str, id_column: str, parent_column: str | None = None) -> DataFrame:
        """(id, parent_id, shape) of a GeoJSON feature collection of polygons and multipolygons; any other feature is refused."""
        self._connected("layer", path)
        ring = "array<array<double>>"
        names = [id_column] + ([parent_column] if parent_column else [])
        properties = ", ".join(f"`{n}`: string" for n in names)
        read = lambda depth: self.spark.read.option("multiLine", True).schema(f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: {depth}>>>").json(path).selectExpr("inline(features)")
        other = read("string").filter("geometry.type IS NULL OR geometry.type NOT IN ('Polygon', 'MultiPolygon')")
        kinds = other.groupBy(F.coalesce("geometry.type", F.lit("no geometry")).alias("kind")).count().orderBy("kind").limit(10).collect()
        if kinds:
            raise InputError(f"{path} has features that are no areas: " + ", ".join(f"{r['count']} of {r.kind}" for r in kinds))
        many = read(f"array<array<{ring}>>").filter("geometry.type = 'MultiPolygon'").select("properties", F.col("geometry.coordinates").alias("c"))
        one = read(f"array<{ring}>").filter("geometry.type = 'Polygon'").select("properties", F.array("geometry.coordinates").alias("c"))
        point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
        shape = F.transform("c", lambda polygon: F.transform(polygon, lambda r: F.transform(r, point))).cast(SHAPE)
        self.reads.append({"stage": self.stage, "kind": "layer", "path": path})
        parent = F.col(f"properties.`{parent_column}`") if parent_column else F.lit(None).cast("string")
        return self._recorded(many.unionByName(one).select(F.col(f"properties.`{id_column}`").alias("id"), parent.alias("parent_id"), shape.alias("shape")), self.reads[-1])

    def weather(self, paths: dict[str, str], start: str | None, end: str | None) -> DataFrame:
        """Long (point_id, date, variable, value) of one wide file a variable; both ends of the window included."""
        out = None
        for variable, path in paths.items():
            entry = self._asked(f"weather {variable}", path, start, end)
            df = self._wide(path, "point_id", "value").withColumn("variable", F.lit(variable))
            self._unsealed(df, f"weather {variable}")
            if twice := df.groupBy("date", "point_id").count().filter("count > 1").limit(1).collect():
                raise InputError(f"{path} has {twice[0].point_id} on {twice[0].date} twice")
            df = self._recorded(in_window(df, start, end), entry)
            out = df if out is None else out.unionByName(df)
        if out is None:
            raise InputError("no weather variable was asked for")
        return out.select("point_id", "date", "variable", "value")

    def demand(self, path: str, start: str | None, end: str | None) -> DataFrame:
        """Long (date, pga_id, demand), in the evaluate stage alone; a refused read leaves no record."""
        if self.stage != "evaluate":
            raise FirewallError(f"the {self.stage} stage may not read demand")
        entry = self._asked("demand", path, start, end)
        df = self._wide(path, "pga_id", "demand")
        self._unsealed(df, "demand")
        return self._recorded(in_window(df, start, end), entry)
