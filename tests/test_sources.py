import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from zonewright.operators import geometry
from zonewright.sources import planted, sinks
from zonewright.sources.readers import FirewallError, InputError, SealedWindowError, StageReader

SEALED = "2025-09-01"


def write_wide(path, header, rows):
    Path(path).write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_wide_weather(spark, tmp_path):
    path = write_wide(tmp_path / "w.csv", "date,001,P2", ["2024-01-01,1.5,", "2024-01-02,2,3", "2024-01-03,4,5"])
    reader = StageReader(spark, "features", SEALED)
    rows = sorted(map(tuple, reader.weather({"tmin": path}, "2024-01-01", "2024-01-02").collect()))
    assert [(r[0], str(r[1]), r[2], r[3]) for r in rows] == [("001", "2024-01-01", "tmin", 1.5), ("001", "2024-01-02", "tmin", 2.0), ("P2", "2024-01-01", "tmin", None), ("P2", "2024-01-02", "tmin", 3.0)]
    assert [r["kind"] for r in reader.reads] == ["weather tmin"]


def test_sealed_days_are_refused_anywhere_in_the_file(spark, tmp_path):
    path = write_wide(tmp_path / "w.csv", "date,P1", ["2024-01-01,1", "2025-09-01,2"])
    with pytest.raises(SealedWindowError):
        StageReader(spark, "features", SEALED).weather({"t": path}, None, "2025-09-01")
    with pytest.raises(SealedWindowError):
        StageReader(spark, "features", SEALED).weather({"t": path}, None, "2024-12-31")
    reader = StageReader(spark, "features", SEALED, sealed_override=True)
    assert reader.weather({"t": path}, None, "2025-12-31").count() == 2 and reader.reads[0]["override"]


def test_demand_is_for_evaluate_alone(spark, tmp_path):
    path = write_wide(tmp_path / "d.csv", "date,A,B", ["2024-01-01,1,2"])
    early = StageReader(spark, "cluster", SEALED)
    with pytest.raises(FirewallError):
        early.demand(path, None, "2024-12-31")
    assert early.reads == []
    assert StageReader(spark, "evaluate", SEALED).demand(path, None, "2024-12-31").count() == 2


def test_bad_inputs(spark, tmp_path):
    reader = StageReader(spark, "features", SEALED)
    with pytest.raises(InputError, match="latitude"):
        reader.points(write_wide(tmp_path / "p.csv", "point_id,x", ["a,1"]))
    with pytest.raises(InputError, match="twice"):
        reader.weather({"t": write_wide(tmp_path / "w.csv", "date,P1", ["2024-01-01,1", "2024-01-01,2"])}, None, "2024-12-31")


def test_layers_round_trip(spark, tmp_path):
    ra = planted.layers(spark)["ra"].select(F.col("id").alias("RA_ID"), F.col("parent_id").alias("PGA_ID"), "shape")
    path = str(tmp_path / "ra.geojson")
    sinks.write_geojson(ra, path, ["RA_ID"])
    first = Path(path).read_bytes()
    sinks.write_geojson(ra.repartition(3), path, ["RA_ID"])
    assert Path(path).read_bytes() == first
    document = json.loads(first)
    document["features"].append({"type": "Feature", "properties": {"RA_ID": "single", "PGA_ID": None}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]}})
    Path(path).write_text(json.dumps(document))
    back = StageReader(spark, "geometry", SEALED).layer(path, "RA_ID", "PGA_ID").withColumn("a", geometry.area(F.col("shape")))
    rows = {r.id: (r.parent_id, r.a, len(r["shape"])) for r in back.collect()}
    assert rows["RA-NE-1"] == ("PGA-NE", 50_000 * 25_000 + 1e8, 2) and rows["single"] == (None, 2.0, 1) and len(rows) == 9


def test_csv_and_matrix(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5, ["x", "y"]), ("a", None, [])], "k string, v double, l array<string>")
    sinks.write_csv(df, str(tmp_path / "t.csv"), ["k"])
    assert (tmp_path / "t.csv").read_text() == "k,v,l\na,,\nb,1.5,x y\n"
    w = planted.weather(spark).filter("date < '2023-09-03' AND variable = 'tmin'")
    assert sinks.wide_matrix(w).columns == ["point_id", "tmin_2023-09-01", "tmin_2023-09-02"]
    assert {len(r["values"]) for r in sinks.point_arrays(w).collect()} == {2}


def test_planted_demand_matches_the_published_rows(spark):
    rows = {(str(r.date), r.pga_id): r.demand for r in planted.demand(spark).filter("date < '2023-09-03'").collect()}
    assert [rows["2023-09-01", p] for p in planted.PGAS] == [0.0, 0.6, -0.3, -0.4]
    assert [rows["2023-09-02", p] for p in planted.PGAS] == [-0.4, 1.0, -0.9, 0.2]
