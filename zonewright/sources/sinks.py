"""Deterministic text sinks. Tables are best kept as Parquet; these are for results of a size to be read by people."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Single text files pass through the driver, so their rows are counted first.
MOST_ROWS = 1_000_000


def _small(df: DataFrame, order: list[str]) -> list:
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows: write Parquet instead")
    return rows


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def put(spark: SparkSession, path: str, text: str) -> None:
    """One text file, replaced if it is there, in whatever store Spark's paths name; line feeds as they are."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    store.setWriteChecksum(False)
    out = store.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One file, rows in order, line feeds only; arrays are joined by blanks, nulls are empty."""
    text = lambda v: "" if v is None else " ".join(map(str, v)) if isinstance(v, list) else str(v)
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s
    lines = [",".join(df.columns)] + [",".join(quote(text(v)) for v in r) for r in _small(df, order)]
    put(df.sparkSession, path, "\n".join(lines) + "\n")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """Keys sorted, two blanks a level."""
    put(spark, path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def write_geojson(df: DataFrame, path: str, order: list[str], places: int = 2) -> None:
    """A feature collection of a table with `shape`; its other columns are the properties."""
    properties = [c for c in df.columns if c != "shape"]
    features = []
    for r in _small(df, order):
        rings = [[[[round(p["x"], places), round(p["y"], places)] for p in ring] for ring in polygon] for polygon in r["shape"] or []]
        closed = [[ring if ring[0] == ring[-1] else ring + ring[:1] for ring in polygon] for polygon in rings]
        features.append({"type": "Feature", "properties": {c: r[c] for c in properties}, "geometry": {"type": "MultiPolygon", "coordinates": closed}})
    write_json(df.sparkSession, {"type": "FeatureCollection", "features": features}, path)


def write_table(df: DataFrame, path: str) -> None:
    """A small table as text: GeoJSON if it has shapes, else CSV; rows ordered by all columns that have an order."""
    order = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    if "shape" in df.columns:
        write_geojson(df, f"{path}.geojson", order)
    else:
        write_csv(df, f"{path}.csv", order)


def wide_matrix(df: DataFrame, most_columns: int = 10_000) -> DataFrame:
    """One row a point, one column `variable_date` a reading; for few columns only, arrays serve beyond."""
    named = df.withColumn("name", F.concat_ws("_", "variable", F.date_format("date", "yyyy-MM-dd")))
    names = [r.name for r in named.select("name").distinct().orderBy("name").limit(most_columns + 1).collect()]
    if len(names) > most_columns:
        raise ValueError(f"over {most_columns} columns: use point_arrays")
    return named.groupBy("point_id").pivot("name", names).agg(F.first("value"))


def point_arrays(df: DataFrame) -> DataFrame:
    """(point_id, values): a point's readings in order of variable and date."""
    each = F.array_sort(F.collect_list(F.struct("variable", "date", "value")))
    return df.groupBy("point_id").agg(F.transform(each, lambda s: s["value"]).alias("values"))
