"""The questions that users of a mobility service ask, each a function to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import destinations, flows, growth, places, zones
from ..sources import visits


def cluster_cbgs(records: DataFrame, population: DataFrame, seed: str, min_pop: int, algorithm: str = "czi_balanced", centers: DataFrame | None = None, **parameters) -> DataFrame:
    """A zone round the seed by one of the methods; names and ranges are checked."""
    name = growth.algorithm(algorithm)
    given = growth.parameters(parameters)
    run = records.sparkSession.createDataFrame([("run", name, seed, int(min_pop), {k: str(v) for k, v in given.items()})], "run_id string, algorithm string, seed string, min_pop int, parameters map<string,string>")
    return growth.build(run, flows.directed(records), population, centers)


def cz_metrics(records: DataFrame, population: DataFrame, cluster: DataFrame) -> DataFrame:
    """Zone metrics; ``ValueError`` names members that the graph lacks."""
    node = flows.nodes(records)
    if lack := [r.cbg for r in zones.missing(node, cluster).limit(20).collect()]:
        raise ValueError(f"not in the graph: {', '.join(sorted(lack))}")
    return zones.metrics(flows.edges(records), node, cluster, population)


def frontier_candidates(records: DataFrame, population: DataFrame, cluster: DataFrame, seed: str, algorithm: str = "czi_balanced", centers: DataFrame | None = None, limit: int = 50) -> DataFrame:
    rule = {"czi_balanced": "czi", "czi_optimal_cap": "czi", "greedy_fast": "fast", "greedy_ratio": "ratio", "greedy_weight_seed_guard": "seed_guard"}.get(growth.algorithm(algorithm), "weight")
    return zones.frontier(flows.edges(records), flows.nodes(records), population, cluster, rule, seed, centers, limit)


def second_order_destinations(records: DataFrame, seeds: DataFrame, zips: DataFrame, cities: DataFrame, population: DataFrame, centers: DataFrame | None = None, limit: int = 10) -> DataFrame:
    flow = flows.directed(records)
    unit = destinations.by_unit(destinations.flows_by_area(flow, seeds), destinations.units(zips, cities), seeds, population, centers)
    people = population.join(seeds.select("cbg").distinct(), "cbg", "left_semi").agg(F.coalesce(F.sum("population"), F.lit(0))).first()[0]
    return destinations.recommend(destinations.gateways(destinations.ranked(unit, limit)), int(people)).drop("areas")


def candidate_pois(table: DataFrame, area: str, cluster: DataFrame, limit: int = 8) -> DataFrame:
    return places.candidates(visits.normalise(table), area, cluster, limit)


def seed_region(zips: DataFrame, cities: DataFrame, zip_: str) -> DataFrame:
    return destinations.seed_region(zips, cities, zip_)


def cbg_geojson(polygons: DataFrame, cluster: DataFrame, neighbours: bool = False) -> DataFrame:
    """GeoJSON of the members, and of those that touch them."""
    own = cluster.select(F.col("cbg").alias("id")).distinct()
    wanted = own
    if neighbours:
        wanted = own.unionByName(geometry.touching(polygons).join(own.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id"))).distinct()
    marked = polygons.join(wanted, "id", "left_semi").join(own.withColumn("member", F.lit(True)), "id", "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return geometry.feature_collection(marked, ["id", "member"])


def cbg_at_point(polygons: DataFrame, points: DataFrame, tile: float = 0.1) -> DataFrame:
    return geometry.locate(points, polygons, tile)


def pattern_availability(files: DataFrame, required: DataFrame) -> DataFrame:
    """``state, month, available`` of the required months."""
    there = files.select("state", "month").distinct().withColumn("available", F.lit(True))
    return required.join(there, ["state", "month"], "left").withColumn("available", F.coalesce("available", F.lit(False)))
