"""Text inputs of the planted country, through the command line, to the last figure."""

import json

import pytest
from zonewright.operators import geometry, tree
from zonewright.plans import app, regionalise
from zonewright.sources import planted


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("planted")
    assert app.main(["fixture", "--folder", str(base)]) == 0
    with open(base / "settings.toml", "a") as f:
        f.write('random_partitions = 20\n[settings.sensitivity_sets]\ntemperature = ["tmin", "tmax"]\n')
    return base


def test_planted_inputs_are_the_same_bytes_each_time(spark, folder, tmp_path):
    names = planted.write(spark, str(tmp_path))
    assert names == sorted(["points.csv", "demand.csv", "settings.toml", "cluster-labels-k2.expected.csv", *(f"{n}.geojson" for n in ("ra", "pga", "nca")), *(f"weather/weather-{v}.csv" for v in planted.VARIABLES)])
    assert all((tmp_path / n).read_bytes() == (folder / n).read_bytes() for n in names if n != "settings.toml")
    lines = (tmp_path / "points.csv").read_text().splitlines()
    assert lines[0] == "point_id,latitude,longitude" and len(lines) == 19
    labels = (tmp_path / "cluster-labels-k2.expected.csv").read_text().splitlines()
    assert len(labels) == 18 and labels[1] == "P01,P01" and labels[-1] == "P18,P03"


@pytest.fixture(scope="module")
def finished(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("run")
    text = (folder / "settings.toml").read_text().replace("[inputs]", "[inputs]\ntext = true")
    (folder / "text.toml").write_text(text)
    assert app.main(["run", "all", "--settings", str(folder / "text.toml"), "--folder", str(out)]) == 0
    return out


def test_full_run(spark, folder, finished):
    out = finished
    record = json.loads((out / "run-record.json").read_text())
    assert list(record["stages"]) == sorted(app.STAGES) and [r["stage"] for r in record["reads"] if r["kind"] == "demand"] == ["evaluate"]
    eta = {(r.map, r.variable): r.eta_squared for r in spark.read.parquet(str(out / "evaluate/eta")).collect()}
    assert abs(eta["new", "tmin"] - 0.974623) < 1e-4 and abs(eta["current", "demand"] - 0.039083) < 1e-4
    checks = {r.layer: r for r in spark.read.parquet(str(out / "geometry/checks")).collect()}
    assert (checks["ra"].multi_part, checks["pga"].multi_part, checks["pga"].slivers, checks["nca"].slivers) == (1, 1, 0, 0)
    figures = {p.name for p in (out / "report").iterdir()}
    assert len([f for f in figures if f.endswith(".svg")]) == 8 and "summary.md" in figures
    page, areas = ((out / f"report/{n}.md").read_text() for n in ("summary", "areas"))
    assert len(page.splitlines()) < 80 and "| 3 | 3 | yes |" in page and "| new | weather_mean | 100.0 |" in page and "| eta_new | 0.9725 |" in page
    assert all(f"| PGA-{c} |" in areas for c in ("NW", "NE", "SW", "SE"))
    expected = [tuple(x.split(",")) for x in (folder / "cluster-labels-k2.expected.csv").read_text().splitlines()[1:]]
    labels = spark.read.parquet(str(out / "cluster/labels")).filter("k = 2").select("point_id", "cluster")
    assert sorted(map(tuple, labels.collect())) == sorted(expected)


def test_record_of_a_run(finished):
    record = json.loads((finished / "run-record.json").read_text())
    rows = {r["kind"]: r["rows"] for r in record["reads"]}
    assert rows["points"] == 18 and rows["weather tmax"] == 731 * 18 and rows["demand"] == 365 * 4
    weather = next(r for r in record["reads"] if r["kind"] == "weather rain")
    assert (weather["start"], weather["end"], weather["first"], weather["last"]) == ("2023-09-01", "2025-08-31", "2023-09-01", "2025-08-31")
    assert sorted(r["rows"] for r in record["reads"] if r["kind"] == "layer") == [2, 4, 8]
    said = "\n".join(record["notices"])
    assert "graph: dropped 1 point(s) whose cells have no land: P17" in said
    assert "features: dropped 1 date(s) at every point and variable because a reading was missing: 2024-03-15" in said
    assert record["versions"]["libraries"]["numpy"] and record["versions"]["conf"]["spark.sql.session.timeZone"] == "UTC"
    assert record["sealed_override"] == {"setting": False, "used": False} and record["timing"]["seconds"] > 0 and record["seed"] == 20260921


def test_maps_of_all_cuts(spark, finished):
    read = lambda name: spark.read.parquet(str(finished / name)).collect()
    cuts = {r.k: r for r in read("mapping/cuts")}
    assert (cuts[2].regions, cuts[2].contiguous, round(cuts[2].highest_straddle, 6), cuts[2].moves, cuts[2].clusters_without_area) == (2, True, 0.0, 0, [])
    assert cuts[3].highest_straddle > 0.4 and {r.k for r in read("mapping/cut_assignments")} == {2, 3}
    regions = {r.group_id: r for r in read("mapping/regions")}
    assert regions["NCA-P01"].members == "PGA-NW,PGA-SW" and regions["NCA-P03"].connected
    outlines = {r.group_id: (r.parts, round(r.area)) for r in read("mapping/outlines")}
    assert outlines["NCA-P01"][0] == 1 and outlines["NCA-P03"][0] == 2  # the island is a part
    assert abs(outlines["NCA-P01"][1] - 50_000 * 100_000) < 1000
    assert {r.point_id for r in read("graph/cells") if not r.inside_outline} == set()
    diagnostics = {r.run: r for r in read("cluster/diagnostics")}
    assert set(diagnostics) == {"temperature", "unconstrained"} and diagnostics["unconstrained"].adjusted_rand == 1.0
    assert {(r.k, r.cluster): r.size for r in read("cluster/sizes")}[2, "P01"] == 8


def test_summaries_outline_and_matrix(spark, finished):
    said = lambda stage: json.loads((finished / stage / "summary.json").read_text())
    graph = said("graph")
    assert (graph["points_read"], graph["points_kept"], graph["edges"], graph["parts"]) == (18, 17, {"computed": 24, "manual": 1}, 1)
    assert (graph["least_degree"], graph["most_degree"], graph["points_without_edges"], graph["points_outside_outline"]) == (1, 4, 0, 0)
    assert abs(graph["area_square_metres"] - (1e10 + 1e8)) < 1e4
    features = said("features")
    assert features["build_matrix_shape"] == [17, 1460] and features["days"] == {"build": 365, "held_out": 365} and features["variables"] == sorted(planted.VARIABLES)
    assert said("cluster")["cuts"]["2"] == {"P01": 8, "P03": 9} and said("cluster")["inversions"] == 0
    assert said("mapping")["2"]["members"] == {"NCA-P01": ["PGA-NW", "PGA-SW"], "NCA-P03": ["PGA-NE", "PGA-SE"]} and said("mapping")["3"]["contiguous"] is True
    outline = spark.read.parquet(str(finished / "geometry/outline")).first()
    assert outline.parts == 2 and abs(outline.area - (1e10 + 1e8)) < 1e4
    matrix = spark.read.parquet(str(finished / "features/matrix")).collect()
    assert len(matrix) == 17 and {len(r["values"]) for r in matrix} == {1460}


def test_metrics_and_texts(finished):
    m = json.loads((finished / "evaluate/metrics.json").read_text())
    assert abs(m["weather_means"]["eta_new"] - 0.972451) < 1e-4 and abs(m["weather_means"]["eta_current"] - 0.002589) < 1e-4
    assert abs(m["weather_means"]["ceiling"] - 0.988111) < 1e-4 and abs(m["weather_means"]["variance_explained"] - 0.869625) < 1e-4
    assert m["placings"]["new/weather_mean"]["percentile"] == 100.0 and m["placings"]["new/demand"]["percentile"] == 100.0
    assert m["random_maps"]["weather_mean"]["minimum"] <= m["random_maps"]["weather_mean"]["median"] <= m["random_maps"]["weather_mean"]["maximum"]
    assert sum(v["misfit"] for k, v in m["misfits"].items() if k.startswith("current")) == 8
    labels = (finished / "text/cluster/labels.csv").read_text().splitlines()
    assert labels[0] == "k,point_id,cluster" and labels[1] == "2,P01,P01" and len(labels) == 1 + 2 * 17
    assert len(json.loads((finished / "text/graph/cells.geojson").read_text())["features"]) == 17
    assert (finished / "text/cluster/tree.csv").exists() and not (finished / "text/features/anomalies.csv").exists()


def test_layers_without_parents_and_crossing_rings(spark, folder, tmp_path):
    """No layer names a parent, and one area's ring crosses itself: the run takes it apart, finds the parents and says so."""
    settings = "\n".join(x for x in (folder / "settings.toml").read_text().splitlines() if not x.startswith("parent_id_column"))
    for name in ("points.csv", "weather", "demand.csv", "ra.geojson", "pga.geojson", "nca.geojson"):
        settings = settings.replace(f'"{name}"', f'"{folder / name}"')
    layer = json.loads((folder / "ra.geojson").read_text())
    twisted = next(f for f in layer["features"] if f["properties"]["RA_ID"] == "RA-SW-1")
    ring = twisted["geometry"]["coordinates"][0][0]
    (x, y), (u, v) = ring[0], ring[1]
    # a small loop beyond the lower edge: out between two of its points, and back across itself
    at = lambda t, up: [x + (u - x) * t, y + (v - y) * t + up]
    twisted["geometry"]["coordinates"][0][0] = [ring[0], at(0.5, 0), at(0.5001, 1e-6), at(0.49995, 1e-6), at(0.50005, -1e-6), *ring[1:]]
    (tmp_path / "twisted.geojson").write_text(json.dumps(layer))
    (tmp_path / "s.toml").write_text(settings.replace(str(folder / "ra.geojson"), str(tmp_path / "twisted.geojson")))
    out = tmp_path / "run"
    assert app.main(["run", "geometry", "--settings", str(tmp_path / "s.toml"), "--folder", str(out)]) == 0
    parents = {r.id: r.parent_id for r in spark.read.parquet(str(out / "geometry/ra")).collect()}
    assert parents["RA-NE-1"] == "PGA-NE" and parents["RA-SW-2"] == "PGA-SW" and len(parents) == 8
    said = "\n".join(json.loads((out / "run-record.json").read_text())["notices"])
    assert "8 unit(s) of ra name no parent" in said and "4 unit(s) of pga name no parent" in said and "crossing rings of 1 unit(s) of ra: RA-SW-1" in said


def test_links_that_are_not_made(spark):
    layers, points = planted.layers(spark), planted.points(spark).select("point_id", "x", "y")
    said = []
    links = (("P18", "P12"), ("P12", "P18"), ("P01", "P02"), ("P01", "P99"), ("P17", "P01"))
    _, edges = regionalise.build_graph(points, layers["ra"], regionalise.Settings(manual_links=links), said.append)
    assert edges.filter("source = 'manual'").count() == 1
    assert [x for x in said if "skipped" in x] == [
        "skipped the link of P01 and P02: they are neighbours already",
        "skipped the link of P01 and P17: not both are in the graph",
        "skipped the link of P01 and P99: not both are in the graph",
    ]


def test_the_real_source_refuses(spark, folder, tmp_path):
    real = (folder / "settings.toml").read_text().replace("[inputs]", '[inputs]\nsource = "real"')
    for name in ("points.csv", "weather", "demand.csv", "ra.geojson", "pga.geojson", "nca.geojson"):
        real = real.replace(f'"{name}"', f'"{folder / name}"')
    (tmp_path / "real.toml").write_text(real)
    assert app.main(["run", "all", "--settings", str(tmp_path / "real.toml"), "--folder", str(tmp_path / "out")]) == 1
    record = json.loads((tmp_path / "out/run-record.json").read_text())
    assert record["stopped"].startswith("RealSourceError") and "not connected" in record["stopped"] and record["reads"] == []


def test_stages_need_those_before(folder, tmp_path):
    assert app.main(["run", "cluster", "--settings", str(folder / "settings.toml"), "--folder", str(tmp_path / "none")]) == 1
    assert "graph" in json.loads((tmp_path / "none/run-record.json").read_text())["stopped"] or "features" in (tmp_path / "none/run-record.json").read_text()


def test_bad_settings_stop_before_anything(tmp_path, capsys):
    (tmp_path / "s.toml").write_text('[inputs]\npoints = "p.csv"\nsource = "guess"\n[settings]\nsmoothing_days = 2\nseed = "one"\ncontiguity_repair = 1\ncolour = "red"\n[extra]\n')
    assert app.main(["run", "all", "--settings", str(tmp_path / "s.toml"), "--folder", str(tmp_path / "out")]) == 2
    said = capsys.readouterr().err
    assert all(x in said for x in ("extra", "colour", "smoothing_days", "seed must be a int", "contiguity_repair must be a bool", "inputs.source", "weather", "demand", "layers.ra.path")) and not (tmp_path / "out").exists()
    assert app.main(["stages"]) == 0


def test_subsets_and_the_free_tree(spark):
    layers, points = planted.layers(spark), planted.points(spark).select("point_id", "x", "y")
    settings = regionalise.Settings(build_start="2023-09-01", missing_data="drop_day", disconnected_parts="fixed_regions", number_of_regions=3)
    cells, edges = regionalise.build_graph(points, layers["ra"], settings)
    scores = regionalise.build_scores(planted.weather(spark), cells, edges, settings)["anomalies"]
    labels = regionalise.cluster(scores, edges, settings)["labels"].filter("k = 3")
    clusters = {r.cluster for r in labels.collect()}
    assert "P18" in clusters and len(clusters) == 3  # the island has a tree of its own
    rows = {r.run: r for r in regionalise.sensitivity(scores, edges, labels.select("point_id", "cluster"), {"temperature": ("tmin", "tmax")}, 3).collect()}
    assert rows["temperature"].adjusted_rand > 0.9 and rows["unconstrained"].adjusted_rand < 1


def test_comparing_labellings(spark):
    a = spark.createDataFrame([(f"p{i}", "x" if i < 5 else "y") for i in range(10)], "point_id string, cluster string")
    b = spark.createDataFrame([(f"p{i}", "1" if i < 4 else "2") for i in range(10)], "point_id string, cluster string")
    row = tree.compare(spark, a, b).first()
    assert row.differing == ["p4"] and 0 < row.adjusted_rand < 1
    assert tree.compare(spark, a, a).first().adjusted_rand == 1.0


def test_small_geometry():
    box = lambda x0, y0, x1, y1: [[[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]]
    spike = [[[{"x": x, "y": y} for x, y in ((0, 0), (4, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4), (0, 0))]]]
    assert [(p["x"], p["y"]) for p in geometry.mended(spike)[0][0]] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    bow = [[[{"x": x, "y": y} for x, y in ((0, 0), (2, 2), (2, 0), (0, 2))]]]
    assert geometry.crossing(bow) and not geometry.crossing(box(0, 0, 1, 1))
    assert geometry.inside(box(0, 0, 4, 4), 1, 1) and not geometry.inside(box(0, 0, 4, 4), 4, 1) and not geometry.inside(box(0, 0, 4, 4), 5, 1)
    ell = [[[{"x": x, "y": y} for x, y in ((0, 0), (9, 0), (9, 1), (1, 1), (1, 9), (0, 9))]]]
    assert geometry.inside(ell, *geometry.inner_point(ell))
    rings = geometry.outline([box(0, 0, 10, 10), box(10, 0, 20, 5), box(10, 5, 20, 10), box(40, 0, 41, 1)])
    assert sorted(abs(geometry.signed_area(r)) for r in rings) == [1.0, 200.0]
