"""Operators of earlier generations that are still asked for: the minute-queue simulator,
quota households, snapshot merging, and dwell and next-place draws."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, measures

#: Least and largest minutes of each dwell bucket.
DWELL = ((1, 4), (5, 10), (11, 20), (21, 60), (61, 120), (121, 240), (241, 500))
FAMILY_TYPES = ("married", "opposite_sex", "same_sex", "female_single", "male_single", "other")


def dwell_minutes(u1: Column, u2: Column, counts: Column) -> Column:
    """A stay drawn from seven bucket counts, evenly within its bucket."""
    at = measures.pick(u1, counts)
    out = F.lit(None).cast("bigint")
    for i, (a, b) in enumerate(DWELL):
        out = F.when(at == i + 1, F.lit(a) + F.floor(u2 * (b - a + 1))).otherwise(out)
    return out


def next_places(places: DataFrame) -> DataFrame:
    """``place, target, weight``: brands in town by their weight, ``out of state`` as the mean
    of those elsewhere (1 without any), ``home`` as half the mean of all entries.
    ``places(place, brands map<string,double>)``."""
    known = places.select(F.col("place").alias("target"), F.lit(True).alias("here"))
    rows = places.select("place", F.explode_outer("brands").alias("target", "weight")).join(known, "target", "left")
    sums = rows.groupBy("place").agg(F.avg(F.when(F.col("here").isNull(), F.col("weight"))).alias("away"), F.coalesce(F.sum(F.when(F.col("here"), F.col("weight"))), F.lit(0.0)).alias("s"), F.count_if(F.col("here")).alias("n"))
    away = F.coalesce("away", F.lit(1.0))
    extra = sums.select("place", F.explode(F.array(F.struct(F.lit("out of state").alias("target"), away.alias("weight")), F.struct(F.lit("home").alias("target"), ((F.col("s") + away) / (F.col("n") + 1) / 2).alias("weight")))).alias("e")).select("place", "e.target", "e.weight")
    return rows.where("here").select("place", "target", "weight").unionByName(extra)


def quota_households(quotas: DataFrame, seed: int = 42) -> DataFrame:
    """``household_id, cbg, kind``: a zone's households dealt to the family types by percent;
    ``quotas(cbg, households, percents array<double>)``."""
    rows = quotas.select("cbg", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("households"))).alias("n"), "percents").withColumn("household_id", F.concat_ws("-", "cbg", "n"))
    at = measures.pick(ids.uniform(str(seed), F.col("household_id"), "kind"), F.col("percents"))
    return rows.select("household_id", "cbg", F.element_at(F.array(*map(F.lit, FAMILY_TYPES)), F.coalesce(at, F.lit(len(FAMILY_TYPES)))).alias("kind"))


def social_tendency(households: DataFrame, ratios: DataFrame) -> DataFrame:
    """Households with ``low``, ``medium`` or ``high`` tendency by their area's ratio."""
    r = F.col("ratio")
    return households.join(ratios.select("cbg", "ratio"), "cbg", "left").withColumn("social_tendency", F.when(r > 0.6, "low").when(r < 0.4, "high").otherwise("medium"))


def merge_snapshots(homes: DataFrame, places: DataFrame) -> DataFrame:
    """One schedule of ``minute, location_id, people array`` snapshots; empty ones are dropped."""
    both = homes.withColumn("is_home", F.lit(True)).unionByName(places.withColumn("is_home", F.lit(False)))
    return both.where(F.size("people") > 0).select("minute", "is_home", "location_id", F.sort_array("people").alias("people"))


def queue_simulation(people: DataFrame, places: DataFrame, minutes: int, every: int = 60, chance: float = 0.1, seed: int = 42) -> DataFrame:
    """``zone, minute, person_id, is_home, location_id`` at each ``every`` minutes: who is at
    home leaves with ``chance`` a minute for a place drawn by weight, and stays as long as
    its dwell draw says. ``people(zone, person_id, home)``, ``places(zone, place, weight,
    dwell array<double>)``; a group for each zone."""
    p = people.select("zone", F.lit(0).alias("kind"), F.col("person_id").alias("id"), F.col("home").alias("home"), F.lit(0.0).alias("weight"), F.array().cast("array<double>").alias("dwell"))
    q = places.select("zone", F.lit(1).alias("kind"), F.col("place").alias("id"), F.lit("").alias("home"), "weight", "dwell")

    def u(*parts) -> float:
        return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 2**32

    def draw(x: float, weights: list[float]) -> int:
        total, run = sum(weights), 0.0
        for i, w in enumerate(weights):
            run += w
            if x * total < run:
                return i
        return len(weights) - 1

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        folk, shop = pdf[pdf.kind == 0].sort_values("id"), pdf[pdf.kind == 1].sort_values("id")
        names, weights, dwells = shop.id.tolist(), shop.weight.tolist(), shop.dwell.tolist()
        away: dict[str, tuple[str, int]] = {}
        out = []
        for t in range(1, minutes + 1):
            away = {x: v for x, v in away.items() if v[1] > t}
            for x in folk.id:
                if names and x not in away and u("go", t, x) < chance:
                    i = draw(u("where", t, x), weights)
                    a, b = DWELL[draw(u("stay", t, x), list(dwells[i]))]
                    away[x] = (names[i], t + a + int(u("len", t, x) * (b - a + 1)))
            if t % every == 0:
                out += [(key[0], t, x, x not in away, away[x][0] if x in away else h) for x, h in zip(folk.id, folk.home, strict=True)]
        return pd.DataFrame(out, columns=["zone", "minute", "person_id", "is_home", "location_id"])

    return p.unionByName(q).groupBy("zone").applyInPandas(run, "zone string, minute int, person_id string, is_home boolean, location_id string")


def spatial_growth(border: DataFrame, population: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, position, cbg``: areas in breadth-first order over shared borders, ties by
    id, until ``runs(run_id, seed, min_pop)`` have their people; a group for each run."""
    rows = border.join(population.withColumnRenamed("cbg", "b"), "b", "left").withColumn("k", F.lit(1)).join(runs.withColumn("k", F.lit(1)), "k").select("run_id", "seed", "min_pop", "a", "b", "population")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        near, people = {}, {}
        for a, b, p in pdf[["a", "b", "population"]].sort_values(["a", "b"]).itertuples(index=False):
            near.setdefault(a, []).append(b)
            people[b] = 0 if pd.isna(p) else int(p)
        queue = [pdf["seed"].iloc[0]]
        seen, out, total = set(queue), [], 0
        while queue and total < pdf["min_pop"].iloc[0]:
            x = queue.pop(0)
            out.append(x)
            total += people.get(x, 0)
            new = [y for y in near.get(x, []) if y not in seen]
            seen.update(new)
            queue += new
        return pd.DataFrame({"run_id": key[0], "position": range(1, len(out) + 1), "cbg": out})

    return rows.groupBy("run_id").applyInPandas(run, "run_id string, position int, cbg string")
