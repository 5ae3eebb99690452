"""A run from settings in TOML to tables in a folder: stages, their outputs, the record, the command line."""

from __future__ import annotations

import argparse
import importlib.metadata
import json
import platform
import subprocess
import sys
import time
import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.functions.storage import discard, materialize
from zonewright.operators import geometry, network, overlay
from zonewright.plans import regionalise, report
from zonewright.plans.regionalise import Settings
from zonewright.sources import planted, sinks
from zonewright.sources.readers import StageReader

VARIABLES = ("tmin", "tmax", "rain", "wind")
#: What a run also gives as text, if it is asked to: all but the long tables.
LONG = {"anomalies", "parameters", "fragments", "matrix"}
#: Stage -> its tables, written as Parquet; later stages read them by these names.
OUTPUTS = {
    "geometry": ("ra", "pga", "nca", "checks", "outline"),
    "graph": ("cells", "edges"),
    "features": ("anomalies", "parameters", "matrix"),
    "cluster": ("tree", "labels", "inversions", "sizes", "diagnostics"),
    "mapping": ("fragments", "assignments", "moves", "borders", "regions", "outlines", "cuts", "cut_assignments", "cut_moves"),
    "evaluate": ("eta", "ceiling", "variance_explained", "correlations", "benchmark", "misfits", "beats", "weather_means", "spread", "placings"),
    "report": (),
}


class SettingsError(ValueError):
    """All that is wrong with the settings, at once."""


class EarlierStageError(FileNotFoundError):
    """A table that an earlier stage makes is not there yet."""


@dataclass(frozen=True)
class Inputs:
    """Where the inputs lie; paths in the file are relative to it."""

    points: str
    weather: str
    demand: str
    layers: dict[str, dict]
    sealed_start: str = "2025-09-01"
    sealed_override: bool = False
    variables: tuple[str, ...] = VARIABLES
    source: str = "files"
    text: bool = False


@dataclass
class Run:
    """One run's folder, settings and record."""

    spark: SparkSession
    settings: Settings
    inputs: Inputs
    folder: str
    record: dict = field(default_factory=lambda: {"reads": [], "stages": {}, "notices": []})
    readers: list[StageReader] = field(default_factory=list)

    def reader(self, stage: str) -> StageReader:
        self.readers.append(StageReader(self.spark, stage, self.inputs.sealed_start, self.inputs.sealed_override, self.record["reads"], self.inputs.source == "real"))
        return self.readers[-1]

    def summary(self, stage: str, facts: dict) -> None:
        """What a stage comes to, as a document beside its tables."""
        sinks.write_json(self.spark, facts, f"{self.folder}/{stage}/summary.json")

    def notice(self, stage: str) -> Callable[[str], None]:
        """Takes down what the run does without having been asked."""
        return lambda text: self.record["notices"].append(f"{stage}: {text}")

    def ended(self, stage: str, seconds: float) -> None:
        """The stage's reads have been through a job: their figures are there."""
        for r in self.readers:
            r.settle()
        self.record["stages"][stage] = {"seconds": round(seconds, 3)}

    def write(self, stage: str, tables: dict[str, DataFrame]) -> None:
        for name in OUTPUTS[stage]:
            if name in tables:
                sinks.write_parquet(tables[name], f"{self.folder}/{stage}/{name}")
                if self.inputs.text and name not in LONG:
                    sinks.write_table(self.read(stage, name), f"{self.folder}/text/{stage}/{name}")

    def read(self, stage: str, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.folder}/{stage}/{name}")
        except pyspark.errors.AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise EarlierStageError(f"{name} is not there: run the {stage} stage first") from e

    def tables(self) -> dict[str, DataFrame]:
        """Every table of the run so far; those that its settings leave out are not looked for."""
        left_out = set() if self.settings.random_partitions else {("evaluate", n) for n in ("benchmark", "spread", "placings")}
        if not (self.settings.sensitivity_sets or self.settings.unconstrained_diagnostic):
            left_out.add(("cluster", "diagnostics"))
        return {name: self.read(stage, name) for stage, names in OUTPUTS.items() for name in names if (stage, name) not in left_out}


def _fits(value: object, default: object) -> bool:
    """Whether a setting is of its default's type; None stands for a date or nothing, whole numbers pass for others."""
    if default is None or isinstance(default, str):
        return isinstance(value, str)
    if isinstance(default, float):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, type(default)) and isinstance(value, bool) == isinstance(default, bool)


def _plain(value: object) -> object:
    """Lists and tables of a settings file as tuples."""
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    return tuple(map(_plain, value)) if isinstance(value, list) else value


def load_settings(path: str) -> tuple[Settings, Inputs]:
    """Sections [inputs], [layers.*] and [settings]; every unknown, missing or wrong setting is named."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    problems = [f"unknown section {s}" for s in sorted(set(data) - {"inputs", "layers", "settings"})]
    defaults = {f.name: f.default for f in fields(Settings)}
    asked = {k: _plain(v) for k, v in data.get("settings", {}).items()}
    problems += [f"unknown setting {k}" for k in sorted(set(asked) - set(defaults))]
    wrong = [k for k, v in asked.items() if k in defaults and not _fits(v, defaults[k])]
    problems += [f"{k} must be a {'date' if defaults[k] is None else type(defaults[k]).__name__.replace('tuple', 'list')}" for k in wrong]
    settings = Settings(**{k: v for k, v in asked.items() if k in defaults and k not in wrong})
    problems += settings.problems()
    given = data.get("inputs", {})
    problems += [f"inputs.{k} is required" for k in ("points", "weather", "demand") if k not in given]
    problems += [f"unknown input {k}" for k in sorted(set(given) - {f.name for f in fields(Inputs)})]
    if given.get("source", "files") not in ("files", "real"):
        problems.append("inputs.source must be one of files, real")
    for level in ("ra", "pga", "nca"):
        layer = data.get("layers", {}).get(level, {})
        problems += [f"layers.{level}.{k} is required" for k in ("path", "id_column") if k not in layer]
    if problems:
        raise SettingsError("; ".join(problems))
    base = Path(path).resolve().parent
    place = lambda p: p if "://" in p else str(base / p)
    layers = {level: v | {"path": place(v["path"])} for level, v in data["layers"].items()}
    given = {k: place(v) if k in ("points", "weather", "demand") else _plain(v) for k, v in given.items()}
    return settings, Inputs(**given, layers=layers)


def geometry_stage(run: Run) -> dict[str, DataFrame]:
    """Layers in metres, rings that cross themselves taken apart, parents worked out where none are named; then the checks."""
    reader, layers, notice = run.reader("geometry"), {}, run.notice("geometry")
    for level, v in run.inputs.layers.items():
        layer = reader.layer(v["path"], v["id_column"], v.get("parent_id_column"))
        shape = geometry.mend("shape")
        projected = materialize(projected_layer(materialize(layer, f"read-{level}")).withColumn("shape", shape), f"layer-{level}")
        whole = projected.withColumn("crossed", geometry.crosses_itself("shape")).withColumn("shape", overlay.repair("shape"))
        whole = materialize(whole, f"layer-{level}")
        if crossed := regionalise.few(whole.filter("crossed").select("id").orderBy("id"), "units"):
            notice(f"took apart the crossing rings of {len(crossed)} unit(s) of {level}: {regionalise.named(crossed)}")
        layers[level] = whole.drop("crossed")
    step = run.settings.grid_step
    layers = regionalise.covered(layers, step, notice)
    whole = overlay.dissolved(layers["ra"].select(F.lit("outline").alias("group_id"), "shape"), step)
    whole = whole.select(F.col("group_id").alias("id"), "shape", geometry.area(F.col("shape")).alias("area"), geometry.part_count(F.col("shape")).alias("parts"))
    run.write("geometry", layers | {"checks": regionalise.geometry_checks(layers, step), "outline": whole})  # the checks stand even if the run stops
    wrong = regionalise.check_nesting(layers["ra"], layers["pga"], step) + regionalise.check_nesting(layers["pga"], layers["nca"], step)
    if wrong:
        raise regionalise.NestingError("; ".join(wrong))
    return {}


def projected_layer(layer: DataFrame) -> DataFrame:
    """A layer of longitudes and latitudes in metres of the national grid."""
    at = F.posexplode
    flat = layer.select("id", at("shape").alias("p", "polygon")).select("id", "p", at("polygon").alias("r", "ring")).select("id", "p", "r", at("ring").alias("i", "point"))
    moved = geometry.to_national_grid(flat.select("id", "p", "r", "i", F.col("point.x").alias("longitude"), F.col("point.y").alias("latitude")))
    shape = moved
    for keys, item in ((["id", "p", "r"], F.struct("i", F.struct("x", "y").alias("v"))), (["id", "p"], F.struct(F.col("r").alias("i"), "v")), (["id"], F.struct(F.col("p").alias("i"), "v"))):
        shape = shape.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["v"]).alias("v"))
    return layer.drop("shape").join(shape.withColumnRenamed("v", "shape"), "id", "left")


def graph_stage(run: Run) -> dict[str, DataFrame]:
    points = materialize(geometry.to_national_grid(run.reader("graph").points(run.inputs.points)).select("point_id", "x", "y"), "points")
    cells, edges = regionalise.build_graph(points, run.read("geometry", "ra"), run.settings, run.notice("graph"))
    run.summary("graph", graph_facts(points, cells, edges, run.settings))
    return {"cells": cells, "edges": edges}


def graph_facts(points: DataFrame, cells: DataFrame, edges: DataFrame, settings: Settings) -> dict:
    kept = cells.select(F.col("point_id").alias("unit_id"))
    n = cells.agg(F.count("*").alias("kept"), F.count_if(~F.col("inside_outline")).alias("outside"), F.count_if(geometry.part_count(F.col("shape")) > 1).alias("multi_part"), F.sum(geometry.area(F.col("shape"))).alias("area")).first()
    d = network.degrees(kept, edges).agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.count_if(F.col("degree") == 0).alias("alone")).first()
    return {
        "points_read": points.count(),
        "points_kept": n.kept,
        "points_outside_outline": n.outside,
        "cells_of_several_parts": n.multi_part,
        "area_square_metres": round(n.area or 0.0, 2),
        "edges": {r.source: r["count"] for r in edges.groupBy("source").count().collect()},
        "least_degree": d.least,
        "most_degree": d.most,
        "points_without_edges": d.alone,
        "parts": network.connected_parts(kept, edges).select("root").distinct().count(),
        "neighbour_rule": settings.neighbour_rule,
        "least_edge_metres": settings.least_edge_metres,
        "disconnected_parts": settings.disconnected_parts,
    }


def features_stage(run: Run) -> dict[str, DataFrame]:
    paths = {v: f"{run.inputs.weather}/weather-{v}.csv" for v in run.inputs.variables}
    weather = run.reader("features").weather(paths, run.settings.build_start, run.settings.held_out_end)
    out = regionalise.build_scores(weather, run.read("graph", "cells"), run.read("graph", "edges"), run.settings, run.notice("features"))
    build = out["anomalies"].filter("window = 'build'").select("point_id", "variable", "date", F.col("z_score").alias("value"))
    run.summary("features", feature_facts(out["anomalies"], run.settings))
    return out | {"matrix": sinks.point_arrays(build)}


def feature_facts(scores: DataFrame, settings: Settings) -> dict:
    each = {r.window: r for r in scores.groupBy("window").agg(F.countDistinct("date").alias("days"), F.countDistinct("point_id").alias("points"), F.countDistinct("variable", "date").alias("columns"), F.sort_array(F.collect_set("variable")).alias("variables")).collect()}
    build = each.get("build")
    return {
        "points": build.points if build else 0,
        "variables": build.variables if build else [],
        "days": {w: r.days for w, r in each.items()},
        "build_matrix_shape": [build.points, build.columns] if build else [0, 0],
        "build": [settings.build_start, settings.build_end],
        "held_out": [settings.held_out_start, settings.held_out_end],
        "log1p": settings.log1p,
        "smoothing_days": settings.smoothing_days,
        "weighted_national_mean": settings.weighted_national_mean,
        "missing_data": settings.missing_data,
    }


def cluster_stage(run: Run) -> dict[str, DataFrame]:
    """The tree and its cuts, and beside them what subsets of the variables and the free tree would give."""
    scores, edges, settings = run.read("features", "anomalies"), run.read("graph", "edges"), run.settings
    out = regionalise.cluster(scores, edges, settings)
    out["sizes"] = out["labels"].groupBy("k", "cluster").agg(F.count("*").alias("size"))
    if settings.sensitivity_sets or settings.unconstrained_diagnostic:
        main = out["labels"].filter(F.col("k") == settings.number_of_regions).select("point_id", "cluster")
        out["diagnostics"] = regionalise.sensitivity(scores, edges, main, dict(settings.sensitivity_sets), settings.number_of_regions, settings.unconstrained_diagnostic)
    cuts: dict[str, dict[str, int]] = {}
    for r in regionalise.few(out["sizes"], "clusters"):
        cuts.setdefault(str(r.k), {})[r.cluster] = r["size"]
    run.summary("cluster", {"headline_k": settings.number_of_regions, "cuts": cuts, "inversions": out["inversions"].count()})
    return out


def mapping_stage(run: Run) -> dict[str, DataFrame]:
    out = regionalise.map_areas(run.read("geometry", "pga"), run.read("graph", "cells"), run.read("cluster", "labels"), run.settings, run.notice("mapping"))
    members: dict[int, dict[str, list[str]]] = {}
    for r in regionalise.few(out["cut_assignments"].orderBy("k", "unit_id"), "areas"):
        members.setdefault(r.k, {}).setdefault(r.group_id, []).append(r.unit_id)
    run.summary("mapping", {str(r.k): r.asDict() | {"members": members[r.k]} for r in regionalise.few(out["cuts"], "cuts")})
    return out


def evaluate_stage(run: Run) -> dict[str, DataFrame]:
    layers = {level: run.read("geometry", level) for level in ("ra", "pga", "nca")}
    mapped = {name: run.read("mapping", name) for name in OUTPUTS["mapping"]}
    demand = run.reader("evaluate").demand(run.inputs.demand, run.settings.held_out_start, run.settings.held_out_end)
    out = regionalise.evaluate(run.read("features", "anomalies"), run.read("graph", "cells"), layers, mapped, run.read("cluster", "labels"), demand, run.settings)
    out = {name: materialize(t, name) for name, t in out.items()}
    out |= {"beats": regionalise.beats(out["eta"], out["ceiling"])} | regionalise.measures(out)
    sinks.write_json(run.spark, metrics(out), f"{run.folder}/evaluate/metrics.json")
    return out


def metrics(tables: dict[str, DataFrame]) -> dict:
    """The small tables of an evaluation as one document: rows by their names, numbers to six places."""
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda name: [{k: tidy(v) for k, v in r.asDict().items()} for r in regionalise.few(tables[name], name)]
    by = lambda name, *keys: {"/".join(str(r.pop(k)) for k in keys): next(iter(r.values())) if len(r) == 1 else r for r in rows(name)}
    out = {"eta_squared": by("eta", "map", "variable"), "ceiling": by("ceiling", "variable"), "variance_explained": by("variance_explained", "variable")}
    out |= {"weather_means": by("weather_means", "measure"), "correlations": by("correlations", "map"), "beats": by("beats", "variable"), "misfits": by("misfits", "map", "unit_id")}
    if "spread" in tables:
        out |= {"random_maps": by("spread", "variable"), "placings": by("placings", "map", "variable")}
    return out


def report_stage(run: Run) -> dict[str, DataFrame]:
    for name, text in report.pages(run.tables(), run.settings.number_of_regions).items():
        sinks.put(run.spark, f"{run.folder}/report/{name}", text)
    return {}


STAGES: dict[str, Callable[[Run], dict[str, DataFrame]]] = {
    "geometry": geometry_stage,
    "graph": graph_stage,
    "features": features_stage,
    "cluster": cluster_stage,
    "mapping": mapping_stage,
    "evaluate": evaluate_stage,
    "report": report_stage,
}


def code_version() -> str:
    git = lambda *a: subprocess.run(["git", "-C", str(Path(__file__).parent), *a], capture_output=True, text=True).stdout.strip()
    return (git("rev-parse", "HEAD") or "unknown") + ("+changes" if git("status", "--porcelain") else "")


def versions(spark: SparkSession) -> dict:
    """Of Python and what it imports, of Spark, and the settings of Spark that results or plans hang on."""
    kept = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.checkpoint.dir", "spark.master")
    return {
        "python": platform.python_version(),
        "libraries": {name: importlib.metadata.version(name) for name in ("numpy", "pandas", "pyarrow", "pyspark")},
        "spark": spark.version,
        "conf": {k: spark.conf.get(k, None) for k in kept},
    }


def run_stages(run: Run, names: list[str]) -> None:
    """Runs the stages in order and writes the record, also of a run that stops."""
    run.record |= {"settings": asdict(run.settings), "inputs": asdict(run.inputs), "code": code_version(), "versions": versions(run.spark), "seed": run.settings.seed}
    began, started = time.perf_counter(), datetime.now(UTC)
    try:
        for name in names:
            at = time.perf_counter()
            run.write(name, STAGES[name](run))
            run.ended(name, time.perf_counter() - at)
    except Exception as e:
        run.record["stopped"] = f"{type(e).__name__}: {e}"
        raise
    finally:
        run.record["timing"] = {"started_at": started.isoformat(), "finished_at": datetime.now(UTC).isoformat(), "seconds": round(time.perf_counter() - began, 3)}
        run.record["sealed_override"] = {"setting": run.inputs.sealed_override, "used": any(r.get("override") for r in run.record["reads"])}
        sinks.write_json(run.spark, run.record, f"{run.folder}/run-record.json")


def main(argv: list[str] | None = None) -> int:
    """run (a stage or all), stages, or fixture (the planted inputs, as text); 2 for bad settings, 1 for a run that stopped, 0 otherwise."""
    parser = argparse.ArgumentParser(prog="zonewright")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run")
    one.add_argument("stage", choices=[*STAGES, "all"])
    one.add_argument("--settings", required=True)
    one.add_argument("--folder", required=True)
    commands.add_parser("stages")
    planted_inputs = commands.add_parser("fixture")
    planted_inputs.add_argument("--folder", required=True)
    args = parser.parse_args(argv)
    if args.command == "stages":
        print("\n".join(STAGES))
        return 0
    session = SparkSession.builder.appName("zonewright").config("spark.sql.session.timeZone", "UTC")
    if args.command == "fixture":
        print("\n".join(planted.write(session.getOrCreate(), args.folder)))
        return 0
    try:
        settings, inputs = load_settings(args.settings)
    except (SettingsError, OSError, tomllib.TOMLDecodeError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = session.getOrCreate()
    if spark.conf.get("spark.checkpoint.dir", None) is None:  # the run's own folder is shared, or its tables could not be
        spark.conf.set("spark.checkpoint.dir", f"{args.folder}/scratch")
    run = Run(spark, settings, inputs, args.folder)
    try:
        run_stages(run, list(STAGES) if args.stage == "all" else [args.stage])
    except (ValueError, PermissionError, FileNotFoundError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    finally:
        discard(spark)
    print(json.dumps(run.record["stages"], sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
