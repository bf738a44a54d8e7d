"""Flow graphs: visitor maps to directed and undirected weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, parsers


def records(visits: DataFrame, place: str = "poi_cbg", visitors: str = "visitor_daytime_cbgs") -> DataFrame:
    """``src, dst, weight``: one row per entry of each place's visitor map; rows whose place
    or map cannot be read give none."""
    rows = visits.select(ids.area_id(F.col(place)).alias("dst"), F.explode(parsers.flow_entries(F.col(visitors))).alias("e"))
    return rows.where("dst IS NOT NULL").select(F.col("e.area").alias("src"), "dst", F.col("e.weight").alias("weight"))


def edges(flows: DataFrame) -> DataFrame:
    """Undirected ``u < v, weight``, both directions summed; loops are nodes' own weight."""
    return flows.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("weight").alias("weight"))


def directed(flows: DataFrame) -> DataFrame:
    """``src, dst, weight`` summed; loops stay rows."""
    return flows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def nodes(flows: DataFrame) -> DataFrame:
    """``cbg, self_weight`` of all areas that occur."""
    ends = flows.select(F.explode(F.array(F.struct(F.col("src").alias("cbg"), F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0).alias("w")), F.struct(F.col("dst").alias("cbg"), F.lit(0.0).alias("w")))).alias("e"))
    return ends.groupBy("e.cbg").agg(F.sum("e.w").alias("self_weight"))


def adjacency(edge: DataFrame) -> DataFrame:
    """``a, b, weight``: each undirected edge from both ends."""
    return edge.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b"), "weight"), F.struct(F.col("v").alias("a"), F.col("u").alias("b"), "weight"))).alias("e")).select("e.*")


def adjacency_matrix(edge: DataFrame, areas: list[str]) -> DataFrame:
    """One row per area, a column of weights for each of ``areas``; 0 where no edge is."""
    return adjacency(edge).groupBy(F.col("a").alias("cbg")).pivot("b", areas).agg(F.sum("weight")).na.fill(0.0)


def dwell_records(visits: DataFrame, place: str = "placekey", visitors: str = "visitor_home_cbgs", dwell: str = "median_dwell") -> DataFrame:
    """``place, cbg, weight``: whole visitors times median dwell, without zeros."""
    rows = visits.select(F.col(place).alias("place"), F.col(dwell).alias("dwell"), F.explode(parsers.flow_entries(F.col(visitors))).alias("e"))
    return rows.select("place", F.col("e.area").alias("cbg"), F.floor(F.col("e.weight") * F.col("dwell")).cast("double").alias("weight")).where("weight > 0")


def distance_weighted(records_: DataFrame, km: DataFrame) -> DataFrame:
    """Weights over the whole kilometres to ``km(place, km)``, rounded down; undivided where
    that is 0 or unknown."""
    joined = records_.join(km, "place", "left")
    whole = F.floor("km").cast("double")
    return joined.select("place", "cbg", F.when(whole > 0, F.floor(F.col("weight") / whole).cast("double")).otherwise(F.col("weight")).alias("weight"))


def bipartite_nodes(records_: DataFrame) -> DataFrame:
    """``id, kind`` of both node sets."""
    return records_.select(F.explode(F.array(F.struct(F.col("place").alias("id"), F.lit("place").alias("kind")), F.struct(F.col("cbg").alias("id"), F.lit("area").alias("kind")))).alias("n")).select("n.*").distinct()
