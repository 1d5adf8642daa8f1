"""Build pipelines over tables, resumable by unit, and their command line.

    python -m pedshade.pipelines graph --nodes N --edges E --out O
    python -m pedshade.pipelines environment --nodes N --edges E --polygons P --stations S --out O
    python -m pedshade.pipelines shade --nodes N --edges E --buildings B --out O
    python -m pedshade.pipelines evaluate --nodes N --edges E --out O

Inputs and outputs are Parquet folders in any file system that Spark knows.
"""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pedshade.config import DEFAULT, SHADE_COLUMNS, Config
from pedshade.functions import geo, solar
from pedshade.operators import cover, evaluation, repair, routes, rules, spatial
from pedshade.runtime import Scratch
from pedshade.sources.publish import publish_tables, write_shards
from pedshade.streaming.state import pending_units


class Runner:
    """Runs a pipeline's units, skips what is done, and records what failed.

    ``base/progress`` has a row for each attempt at a unit, the last of which
    counts; ``base/shards`` the results, a partition for each unit.  A unit is
    done once it has a completed row and a shard, so a run that was lost between
    the two does it again, and a success clears an earlier failure.
    """

    _PROGRESS = "pipeline string, run string, unit_id string, status string, detail string, at timestamp"

    def __init__(self, spark: SparkSession, pipeline: str, base: str):
        self.spark, self.pipeline = spark, pipeline
        self.shards_path, self.progress_path = f"{base}/shards", f"{base}/progress"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def progress(self) -> DataFrame:
        """The last record of each unit; records of another pipeline in the folder are an error."""
        if not self._exists(self.progress_path):
            return self.spark.createDataFrame([], self._PROGRESS)
        rows = self.spark.read.schema(self._PROGRESS).parquet(self.progress_path)
        other = rows.filter(F.col("pipeline") != self.pipeline).select("pipeline").first()
        if other is not None:
            raise ValueError(f"the folder holds the progress of {other[0]!r} and not of {self.pipeline!r}")
        last = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.desc("at"), F.desc("status")))
        return rows.withColumn("_k", last).filter("_k = 1").drop("_k")

    def shards(self) -> DataFrame | None:
        if not self._exists(self.shards_path):
            return None
        # Units are text, whatever their names look like as partitions, so their type is given and not inferred.
        first = self.spark.read.parquet(self.shards_path).drop("unit_id")
        schema = first.schema.add("unit_id", "string")
        return self.spark.read.schema(schema).parquet(self.shards_path)

    def pending(self, units: DataFrame) -> DataFrame:
        shards = self.shards()
        have = self.spark.createDataFrame([], "unit_id string") if shards is None else shards.select("unit_id")
        return pending_units(units.select(F.col("unit_id").cast("string").alias("unit_id")), self.progress(), have)

    def run(self, units: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]) -> int:
        """Builds what is pending and returns how many units failed.

        ``build`` takes the pending units and gives their results, with a
        column unit_id, and the failed units as (unit_id, detail) or None.
        Shards are written before their units are recorded as completed.
        """
        scratch = Scratch(self.spark, "run")
        todo = scratch.write(self.pending(units))
        if todo.isEmpty():
            return 0
        results, failures = build(todo)
        bad = scratch.write(failures.select(F.col("unit_id").cast("string").alias("unit_id"), "detail").dropDuplicates(["unit_id"])) if failures is not None else self.spark.createDataFrame([], "unit_id string, detail string")
        good = scratch.write(results.withColumn("unit_id", F.col("unit_id").cast("string")).join(bad.select("unit_id"), "unit_id", "left_anti"))
        write_shards(good, self.shards_path, "unit_id")
        done = good.select("unit_id").distinct().select("unit_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("detail"))
        records = done.unionByName(bad.select("unit_id", F.lit("failed").alias("status"), "detail"))
        head = [F.lit(self.pipeline).alias("pipeline"), F.lit(uuid.uuid4().hex).alias("run")]
        records.select(*head, "unit_id", "status", "detail", F.current_timestamp().alias("at")).write.mode("append").parquet(self.progress_path)
        return bad.count()

    def complete(self, units: DataFrame) -> DataFrame:
        """All units' results; an error while any is pending."""
        missing = [r["unit_id"] for r in self.pending(units).select("unit_id").take(5)]
        if missing:
            raise ValueError(f"units are not complete: {', '.join(missing)}")
        shards = self.shards()
        wanted = units.select(F.col("unit_id").cast("string").alias("unit_id")).distinct()
        return shards.join(wanted, "unit_id", "left_semi")


def build_graph(nodes: DataFrame, edges: DataFrame, out: str, config: Config = DEFAULT) -> None:
    """Keeps components of some size, repairs the connection of the large ones, checks the graph's rules, and publishes nodes and edges together."""
    scratch = Scratch(nodes.sparkSession, "build-graph")
    kept = scratch.write(repair.keep_components(repair.weak_components(nodes, edges)).select(F.col("node").alias("node_id")))
    n = scratch.write(nodes.join(kept, "node_id", "left_semi"))
    e = scratch.write(repair.repair(n, edges.join(kept.withColumnRenamed("node_id", "source"), "source", "left_semi")))
    rules.require(rules.graph(n, e), "the graph")
    publish_tables({f"{out}/nodes": n, f"{out}/edges": e})


def build_environment(nodes: DataFrame, edges: DataFrame, polygons: DataFrame, stations: DataFrame, out: str) -> None:
    """Scores every edge for greenery and water and publishes the edges; scores that are all equal are an error.

    ``polygons`` has poly_id and rings in degrees, ``stations`` station_id, lon and lat.
    """
    scratch = Scratch(nodes.sparkSession, "build-environment")
    lines = scratch.write(metric_lines(nodes, edges))
    flat = polygons.select("poly_id", F.transform("rings", lambda r: F.transform(r, _projected)).alias("rings"))
    green = scratch.write(cover.green_scores(lines, flat))
    sites = spatial.with_projection(stations).withColumnRenamed("station_id", "site_id")
    far = spatial.nearest_to_lines(lines, sites, ties=False)
    water = scratch.write(far.select("edge_id", geo.water_penalty(F.col("distance_m")).alias("water_penalty")))
    made = scratch.write(edges.drop("green_score", "water_penalty").join(green, "edge_id").join(water, "edge_id"))
    rules.require(rules.union([rules.score_gates(made, "green_score"), rules.score_gates(made, "water_penalty"), rules.edge_values(made)]), "the environment")
    if made.count() != edges.count():
        raise ValueError("edges were lost or repeated")
    publish_tables({f"{out}/edges": made})


def build_shade(nodes: DataFrame, edges: DataFrame, buildings: DataFrame, out: str) -> int:
    """Shade of every edge and scenario by mesh, resumable; returns how many units failed.

    ``buildings`` has the rows of the CityGML source, in degrees.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "build-shade")
    lines = scratch.write(metric_lines(nodes, edges).join(edges.select("edge_id", "source"), "edge_id").join(
        nodes.select(F.col("node_id").alias("source"), geo.mesh_id(F.col("lon"), F.col("lat")).alias("unit_id")), "source").drop("source"))
    az, el = solar.solar_position(F.unix_timestamp("instant").cast("double"), F.lit((DEFAULT.bbox[1] + DEFAULT.bbox[3]) / 2), F.lit((DEFAULT.bbox[0] + DEFAULT.bbox[2]) / 2))
    sun = scratch.write(solar.scenarios(spark).select("scenario", az.alias("azimuth"), el.alias("elevation")))
    selected = scratch.write(cover.select_solids(buildings))
    runner, units = Runner(spark, "shade", out), lines.select("unit_id").distinct()

    def build(pending: DataFrame):
        mine = scratch.write(lines.join(pending.select("unit_id"), "unit_id", "left_semi"))
        return cover.shade_scores(mine, selected, sun).join(mine.select("edge_id", "unit_id"), "edge_id"), None

    failed = runner.run(units, build)
    if not failed:
        rules.require(rules.shade(runner.complete(units), edges), "the shade table")
    return failed


def evaluate_routes(nodes: DataFrame, edges: DataFrame, out: str, config: Config = DEFAULT) -> None:
    """Samples, routes, compares and summarises; the tables are checked and published together."""
    tables = evaluation.evaluate(nodes, edges, config=config)
    rules.require(evaluation.validate(tables, edges, config), "the evaluation")
    publish_tables({f"{out}/{name}": table for name, table in tables.items()})


def _projected(p):
    x, y = geo.project(p["x"], p["y"])
    return F.struct(x.alias("x"), y.alias("y"))


def metric_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(edge_id, line)`` in projected metres, from the edges' own geometry if they have one."""
    drawn = edges if "geometry" in edges.columns else routes.edge_geometry(edges, nodes)

    def flat(p):
        x, y = geo.project(p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))

    return drawn.select("edge_id", F.transform("geometry", flat).alias("line"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pedshade.pipelines", description=__doc__.split("\n")[0])
    parser.add_argument("pipeline", choices=["graph", "environment", "shade", "evaluate"])
    for name in ("nodes", "edges", "polygons", "stations", "buildings", "out"):
        parser.add_argument(f"--{name}", required=name in ("nodes", "edges", "out"))
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"pedshade-{args.pipeline}").getOrCreate()
    table = lambda name: spark.read.parquet(getattr(args, name) or parser.error(f"--{name} is needed"))
    nodes, edges = table("nodes"), table("edges")
    if args.pipeline == "graph":
        build_graph(nodes, edges, args.out)
    elif args.pipeline == "environment":
        build_environment(nodes, edges, table("polygons"), table("stations"), args.out)
    elif args.pipeline == "shade":
        if build_shade(nodes, edges, table("buildings"), args.out):
            raise SystemExit("some units failed; run again to resume")
    else:
        evaluate_routes(nodes, edges, args.out)


if __name__ == "__main__":
    main()
