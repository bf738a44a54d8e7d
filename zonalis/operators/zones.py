"""Zone metrics, frontier ranking, connectivity, conductance: one relational step each.

``cluster`` is a table with a column ``cbg``: a zone, small against the graph, but never
assumed to be: joins on it are plain equi-joins that Spark may broadcast by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures
from .flows import adjacency


def _marked(edge: DataFrame, cluster: DataFrame) -> DataFrame:
    """Edges that touch the cluster, with flags for either end."""
    c = cluster.select("cbg").distinct()
    left, right = c.select(F.col("cbg").alias("u"), F.lit(1).alias("in_u")), c.select(F.col("cbg").alias("v"), F.lit(1).alias("in_v"))
    return edge.join(left, "u", "left").join(right, "v", "left").where("in_u = 1 OR in_v = 1").select("u", "v", "weight", (F.coalesce("in_u", F.lit(0)) == 1).alias("in_u"), (F.coalesce("in_v", F.lit(0)) == 1).alias("in_v"))


def missing(node: DataFrame, cluster: DataFrame) -> DataFrame:
    """Members that the graph lacks."""
    return cluster.select("cbg").distinct().join(node, "cbg", "left_anti")


def metrics(edge: DataFrame, node: DataFrame, cluster: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """One row: ``movement_inside`` (both ends in the zone, and loops), ``movement_boundary``,
    ``czi`` (null without movement), ``cbg_count``, ``population``."""
    both = F.col("in_u") & F.col("in_v")
    moved = _marked(edge, cluster).agg(F.coalesce(F.sum(F.when(both, F.col("weight"))), F.lit(0.0)).alias("i"), F.coalesce(F.sum(F.when(~both, F.col("weight"))), F.lit(0.0)).alias("b"))
    members = cluster.select("cbg").distinct().join(node, "cbg", "left")
    if population is not None:
        members = members.join(population, "cbg", "left")
    else:
        members = members.withColumn("population", F.lit(0).cast("bigint"))
    own = members.agg(F.coalesce(F.sum("self_weight"), F.lit(0.0)).alias("s"), F.count("*").alias("cbg_count"), F.coalesce(F.sum("population"), F.lit(0)).cast("bigint").alias("population"))
    one = moved.withColumn("k", F.lit(1)).join(own.withColumn("k", F.lit(1)), "k")
    inside = F.col("i") + F.col("s")
    return one.select(inside.alias("movement_inside"), F.col("b").alias("movement_boundary"), F.try_divide(inside, inside + F.col("b")).alias("czi"), "cbg_count", "population")


def node_ratios(edge: DataFrame, cluster: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Per member: ``movement_in`` (half of its inner edges; loops left out), ``movement_out``,
    ``ratio``, its colour and, given ``population``, the estimate."""
    c = cluster.select("cbg").distinct()
    moved = adjacency(edge).join(c.select(F.col("cbg").alias("a")), "a", "left_semi").join(c.select(F.col("cbg").alias("b"), F.lit(1).alias("inner")), "b", "left")
    sums = moved.groupBy(F.col("a").alias("cbg")).agg((F.coalesce(F.sum(F.when(F.col("inner") == 1, F.col("weight"))), F.lit(0.0)) / 2).alias("movement_in"), F.coalesce(F.sum(F.when(F.col("inner").isNull(), F.col("weight"))), F.lit(0.0)).alias("movement_out"))
    out = c.join(sums, "cbg", "left").na.fill(0.0, ["movement_in", "movement_out"])
    out = out.withColumn("ratio", F.coalesce(F.try_divide(F.col("movement_in"), F.col("movement_in") + F.col("movement_out")), F.lit(0.0)))
    if population is not None:
        out = out.join(population, "cbg", "left").withColumn("population", F.coalesce("population", F.lit(0).cast("bigint")))
    return out.withColumn("color", measures.ratio_color(F.col("ratio")))


def candidates(edge: DataFrame, cluster: DataFrame) -> DataFrame:
    """Areas outside that share an edge with the zone: ``cbg, inside, outside`` weights."""
    c = cluster.select("cbg").distinct()
    adj = adjacency(edge).join(c.select(F.col("cbg").alias("a")), "a", "left_anti")
    adj = adj.join(c.select(F.col("cbg").alias("b"), F.lit(1).alias("m")), "b", "left")
    sums = adj.groupBy(F.col("a").alias("cbg")).agg(F.coalesce(F.sum(F.when(F.col("m") == 1, F.col("weight"))), F.lit(0.0)).alias("inside"), F.coalesce(F.sum(F.when(F.col("m").isNull(), F.col("weight"))), F.lit(0.0)).alias("outside"), F.count("m").alias("links"))
    return sums.where("links > 0").drop("links")


def frontier(edge: DataFrame, node: DataFrame, population: DataFrame, cluster: DataFrame, rule: str = "weight", seed: str | None = None, centers: DataFrame | None = None, limit: int | None = None, distance_weight: float = 0.02, distance_scale: float = 20.0, guard_km: float = 20.0) -> DataFrame:
    """Ranked candidates ``cbg, score, movement_inside, movement_outside, population, rank``,
    the best first and equal scores by the larger id.

    Rules: ``weight`` and ``fast`` (movement shared with the zone), ``ratio`` (its share of
    the candidate's), ``seed_guard`` (movement shared with members within ``guard_km`` of
    the seed), ``czi`` (the zone's index with the candidate, less a distance penalty; only
    areas with people).
    """
    found = candidates(edge, cluster).join(population, "cbg", "left").withColumn("population", F.coalesce("population", F.lit(0).cast("bigint")))
    if rule == "fast":
        found = found.where("population > 0")
    score: Column = F.col("inside")
    if rule == "ratio":
        score = F.coalesce(F.try_divide(F.col("inside"), F.col("inside") + F.col("outside")), F.lit(0.0))
    elif rule == "seed_guard":
        near = cluster.select("cbg").distinct()
        if guard_km > 0 and centers is not None:
            near = near.join(_km_from(centers, seed), "cbg", "left").where(F.col("km").isNull() | (F.col("km") <= guard_km)).select("cbg")
        shared = candidates_from(edge, near)
        found = found.join(shared, "cbg", "left")
        score = F.coalesce("guarded", F.lit(0.0))
    elif rule == "czi":
        zone = metrics(edge, node, cluster).select("movement_inside", "movement_boundary").withColumn("k", F.lit(1))
        found = found.where("population > 0").join(node, "cbg", "left").withColumn("k", F.lit(1)).join(F.broadcast(zone), "k")  # one row
        inner = F.col("movement_inside") + F.coalesce("self_weight", F.lit(0.0)) + F.col("inside")
        outer = F.col("movement_boundary") - F.col("inside") + F.col("outside")
        score = F.coalesce(F.try_divide(inner, inner + outer), F.lit(0.0))
        if centers is not None:
            found = found.join(_km_from(centers, seed), "cbg", "left")
            score = score - F.coalesce(measures.penalty(F.col("km"), distance_scale), F.lit(0.0)) * distance_weight
    elif rule not in ("weight", "fast"):
        raise ValueError(f"unknown rule {rule}")
    ranked = found.select("cbg", score.alias("score"), F.col("inside").alias("movement_inside"), F.col("outside").alias("movement_outside"), "population")
    top = [F.desc("score"), F.desc("cbg")]
    if limit is not None:  # the top rows first, so that the ranks are given to few
        ranked = ranked.orderBy(*top).limit(limit)
    # candidates border one zone; they are ranked together
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*top)))


def candidates_from(edge: DataFrame, members: DataFrame) -> DataFrame:
    """``cbg, guarded``: movement of each area with the given members."""
    return adjacency(edge).join(members.select(F.col("cbg").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("cbg")).agg(F.sum("weight").alias("guarded"))


def _km_from(centers: DataFrame, seed: str | None) -> DataFrame:
    """``cbg, km`` from the seed's centre; null if that is unknown."""
    at = centers.where(F.col("cbg") == seed).select(F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.lit(1).alias("k"))
    return centers.withColumn("k", F.lit(1)).join(F.broadcast(at), "k", "left").select("cbg", measures.haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")).alias("km"))


def containment(flow: DataFrame, cluster: DataFrame) -> DataFrame:
    """One row: ``internal, out_origin, out_dest`` and the origin, destination and zone ratios."""
    c = cluster.select("cbg").distinct()
    rows = flow.join(c.select(F.col("cbg").alias("src"), F.lit(1).alias("s")), "src", "left").join(c.select(F.col("cbg").alias("dst"), F.lit(1).alias("d")), "dst", "left")
    when = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0.0))
    s, d = F.col("s").isNotNull(), F.col("d").isNotNull()
    sums = rows.where(s | d).agg(when(s & d).alias("internal"), when(s & ~d).alias("out_origin"), when(~s & d).alias("out_dest"))
    origin = F.coalesce(F.try_divide(F.col("internal"), F.col("internal") + F.col("out_origin")), F.lit(0.0))
    dest = F.coalesce(F.try_divide(F.col("internal"), F.col("internal") + F.col("out_dest")), F.lit(0.0))
    return sums.select("*", origin.alias("origin_containment"), dest.alias("destination_containment"), F.least(origin, dest).alias("zone_containment"))


def total_flow(flow: DataFrame) -> DataFrame:
    """``cbg, total``: loops once, other flows at both ends."""
    ends = flow.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("cbg"), "weight"))).otherwise(F.array(F.struct(F.col("src").alias("cbg"), "weight"), F.struct(F.col("dst").alias("cbg"), "weight")))).alias("e"))
    return ends.groupBy("e.cbg").agg(F.sum("e.weight").alias("total"))


def reachable(edge: DataFrame, cluster: DataFrame, seeds: DataFrame, rounds: int = 200) -> DataFrame:
    """Members that a seed reaches within the zone; one round per hop, of the new members only."""
    c = cluster.select("cbg").distinct()
    inner = adjacency(edge).join(c.select(F.col("cbg").alias("a")), "a", "left_semi").join(c.select(F.col("cbg").alias("b")), "b", "left_semi").select("a", "b").distinct().cache()
    seen = seeds.select("cbg").distinct().join(c, "cbg", "left_semi")
    new = seen
    for _ in range(rounds):
        new = inner.join(new.select(F.col("cbg").alias("a")), "a", "left_semi").select(F.col("b").alias("cbg")).distinct().join(seen, "cbg", "left_anti").checkpoint()
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new).checkpoint()
    raise RuntimeError("the zone is deeper than the rounds allow")


def trace_rank(candidate: DataFrame, higher: bool = True, keep: int | None = None) -> DataFrame:
    """``rank`` of each iteration's candidates by score and id, and ``keep``: that many of
    them and the selected one."""
    order = [F.desc("score"), F.desc("cbg")] if higher else [F.asc("score"), F.asc("cbg")]
    out = candidate.withColumn("rank", F.row_number().over(Window.partitionBy("iteration").orderBy(*order)))
    return out if keep is None else out.where((F.col("rank") <= keep) | F.col("selected"))


def inertia(edge: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label: weight of edges within it and of edges that leave it."""
    a, b = labels.select(F.col("cbg").alias("u"), F.col("label").alias("lu")), labels.select(F.col("cbg").alias("v"), F.col("label").alias("lv"))
    rows = edge.join(a, "u").join(b, "v")
    ends = rows.select(F.explode(F.when(F.col("lu") == F.col("lv"), F.array("lu")).otherwise(F.array("lu", "lv"))).alias("label"), "weight", (F.col("lu") == F.col("lv")).alias("same"))
    return ends.groupBy("label").agg(F.coalesce(F.sum(F.when(F.col("same"), F.col("weight"))), F.lit(0.0)).alias("intra"), F.coalesce(F.sum(F.when(~F.col("same"), F.col("weight"))), F.lit(0.0)).alias("inter"))


def page_rank(edge: DataFrame, seed: str, alpha: float = 0.85, rounds: int = 20) -> DataFrame:
    """Personalised PageRank ``cbg, rank`` on the undirected graph, restarted at the seed."""
    adj = adjacency(edge)
    degree = adj.groupBy("a").agg(F.sum("weight").alias("d"))
    walk = adj.join(degree, "a").select("a", "b", (F.col("weight") / F.col("d")).alias("p")).cache()
    start = degree.select(F.col("a").alias("cbg"), F.when(F.col("a") == seed, 1.0).otherwise(0.0).alias("s")).cache()
    rank = start.select("cbg", F.col("s").alias("r"))
    for i in range(rounds):
        moved = walk.join(rank.withColumnRenamed("cbg", "a"), "a").groupBy(F.col("b").alias("cbg")).agg(F.sum(F.col("r") * F.col("p")).alias("m"))
        rank = start.join(moved, "cbg", "left").select("cbg", (F.coalesce("m", F.lit(0.0)) * alpha + F.col("s") * (1 - alpha)).alias("r"))
        if i % 5 == 4:
            rank = rank.checkpoint()
    return rank.select("cbg", F.col("r").alias("rank"))


def sweep(edge: DataFrame, rank: DataFrame, least: float = 1e-4) -> DataFrame:
    """Prefixes of areas by descending rank, down to ``least``: ``cbg, pos, cut, volume,
    conductance``. Each edge counts where its later end enters, so cut and volume are
    running sums over the swept areas only."""
    top = Window.orderBy(F.desc("rank"), F.asc("cbg"))
    order = rank.where(F.col("rank") >= least).select("cbg", F.row_number().over(top).alias("pos"))
    adj = adjacency(edge)
    total = adj.agg(F.sum("weight").alias("all")).withColumn("k", F.lit(1))
    own = adj.join(order.select(F.col("cbg").alias("a"), F.col("pos").alias("pa")), "a").join(order.select(F.col("cbg").alias("b"), F.col("pos").alias("pb")), "b", "left")
    step = own.groupBy(F.col("a").alias("cbg"), F.col("pa").alias("pos")).agg(F.sum("weight").alias("vol"), F.sum(F.when(F.col("pb") < F.col("pa"), -F.col("weight")).otherwise(F.col("weight"))).alias("cut"))
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = step.select("cbg", "pos", F.sum("cut").over(run).alias("cut"), F.sum("vol").over(run).alias("volume")).withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
    small = F.least(F.col("volume"), F.col("all") - F.col("volume"))
    return sums.select("cbg", "pos", "cut", "volume", F.try_divide(F.col("cut"), small).alias("conductance"))


def holes(border: DataFrame, cluster: DataFrame, touches: int = 2) -> DataFrame:
    """Areas outside that border at least ``touches`` members (``border(a, b)`` both ways)."""
    c = cluster.select("cbg").distinct()
    return border.join(c.select(F.col("cbg").alias("b")), "b", "left_semi").join(c.select(F.col("cbg").alias("a")), "a", "left_anti").groupBy(F.col("a").alias("cbg")).agg(F.count_distinct("b").alias("n")).where(F.col("n") >= touches).select("cbg", "n")
