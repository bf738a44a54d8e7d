"""Connected components by alternating large-star and small-star rounds.

Each round is two group-minimum aggregates and two joins on the node, so a hub with a
third of all edges is pre-aggregated before the shuffle and its join can be split by
adaptive execution; edges never leave the executors. Rounds needed: about log n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import drop_staged, stage


def components(edges: DataFrame, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """``edges(u, v)``, of which ``rows`` are known to exist, to ``(node, component)``: the smallest node reachable, for every
    node that has an edge to another node. Repeats, loops and nulls are ignored."""
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges", rows)
    state = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # a's own edge to m is among the rows above, where b is m
        new = stage(small.where("a <> b").distinct(), "edges", rows)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(e)
        e, rows = new, now[0]
        if state is not None and tuple(now) == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = tuple(now)
    raise RuntimeError("components did not settle")
