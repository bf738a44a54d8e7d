"""Hourly movement: people at home fill places to their wanted occupancy."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids

SCHEDULE = "zone string, minute int, person_id string, is_home boolean, location_id string"


def scaled_need(target: DataFrame, occupancy: DataFrame, at_home: DataFrame) -> DataFrame:
    """One hour's ``zone, placekey, need``: what places lack, scaled down if it is more than
    the people at home (``at_home(zone, people)``)."""
    rows = target.join(occupancy, ["zone", "placekey"], "left").withColumn("need", F.greatest(F.lit(0).cast("bigint"), F.col("target") - F.coalesce("occupancy", F.lit(0).cast("bigint"))))
    total = rows.groupBy("zone").agg(F.sum("need").alias("all"))
    rows = rows.join(total, "zone").join(at_home, "zone")
    scaled = F.when(F.col("all") > F.col("people"), F.floor(F.col("need") * F.col("people") / F.col("all")).cast("bigint")).otherwise(F.col("need"))
    return rows.select("zone", "placekey", scaled.alias("need"))


def chosen(need: DataFrame, home: DataFrame, hour: int, seed: int = 42) -> DataFrame:
    """``zone, person_id, placekey``: of each zone's people at home, in hashed order, as many
    as are needed, dealt to places in order."""
    order = Window.partitionBy("zone").orderBy(ids.uniform(str(seed), str(hour), F.col("person_id")), "person_id")
    line = home.withColumn("pos", F.row_number().over(order))
    run = Window.partitionBy("zone").orderBy("placekey").rowsBetween(Window.unboundedPreceding, 0)
    spans = need.withColumn("upto", F.sum("need").over(run)).withColumn("after", F.col("upto") - F.col("need"))
    return line.join(spans, "zone").where((F.col("pos") > F.col("after")) & (F.col("pos") <= F.col("upto"))).select("zone", "person_id", "placekey")


def stay_hours(dwell: int, person: str, hour: int, seed: int) -> int:
    low = max(1, dwell - 1)
    return low + int(_uniform(seed, "stay", hour, person) * (dwell + 1 - low + 1))


def _uniform(*parts) -> float:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def simulate(people: DataFrame, targets: DataFrame, hours: int, seed: int = 42) -> DataFrame:
    """The schedule of ``hours`` hours: a row per person and hour, at minute ``(h + 1) * 60``.

    ``people(zone, person_id, home)``; ``targets(zone, hour, placekey, dwell, target)`` for
    each simulated hour. An hour depends on the last for all of a zone's people, so zones
    run side by side, a group each. Nobody leaves a place before their stay ends.
    """
    p = people.select("zone", F.lit(0).alias("kind"), F.col("person_id").alias("id"), F.col("home").alias("other"), F.lit(0).alias("hour"), F.lit(0).alias("dwell"), F.lit(0).cast("bigint").alias("target"))
    t = targets.select("zone", F.lit(1).alias("kind"), F.col("placekey").alias("id"), F.lit("").alias("other"), F.col("hour").cast("int"), F.col("dwell").cast("int"), F.col("target").cast("bigint"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        folk = pdf[pdf.kind == 0].sort_values("id")
        wanted = pdf[pdf.kind == 1].sort_values(["hour", "id"])
        if folk.empty or wanted.empty:
            raise ValueError(f"zone {key[0]} has no people or no places")
        home = dict(zip(folk.id, folk.other, strict=True))
        where: dict[str, tuple[str, int]] = {}
        by_hour = {h: g for h, g in wanted.groupby("hour")}
        out = []
        for h in range(hours):
            where = {x: (place, leave) for x, (place, leave) in where.items() if leave != h}
            count: dict[str, int] = {}
            for place, _ in where.values():
                count[place] = count.get(place, 0) + 1
            rows = by_hour.get(h)
            need = [] if rows is None else [(place, int(d), max(0, int(w) - count.get(place, 0))) for place, d, w in zip(rows.id, rows.dwell, rows.target, strict=True)]
            free = [x for x in home if x not in where]
            total = sum(n for _, _, n in need)
            if total > len(free):
                need = [(place, d, n * len(free) // total) for place, d, n in need]
            free.sort(key=lambda x: (_uniform(seed, h, x), x))
            at = 0
            for place, d, n in need:
                for x in free[at : at + n]:
                    where[x] = (place, min(hours, h + stay_hours(d, x, h, seed)))
                at += n
            out.append(pd.DataFrame({"zone": key[0], "minute": (h + 1) * 60, "person_id": list(home), "is_home": [x not in where for x in home], "location_id": [where[x][0] if x in where else home[x] for x in home]}))
        return pd.concat(out, ignore_index=True)

    return p.unionByName(t).groupBy("zone").applyInPandas(run, SCHEDULE)


def occupancy(schedule: DataFrame) -> DataFrame:
    """``zone, minute, location_id, is_home, people``."""
    return schedule.groupBy("zone", "minute", "location_id", "is_home").agg(F.count("*").alias("people"))


def at_home_counts(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("minute").agg(F.count_if("is_home").alias("home"), F.count_if(~F.col("is_home")).alias("away"))


def document(schedule: DataFrame) -> DataFrame:
    """Nested form: ``minute, is_home, location_id, people`` with sorted ids."""
    return schedule.groupBy("minute", "is_home", "location_id").agg(F.sort_array(F.collect_list("person_id")).alias("people"))


def gaps(visits: DataFrame) -> DataFrame:
    """Hours between each visit ``person_id, hour`` and the next, not counting either."""
    nxt = F.lead("hour").over(Window.partitionBy("person_id").orderBy("hour"))
    return visits.select("person_id", "hour", (nxt - F.col("hour") - 1).alias("gap")).where("gap IS NOT NULL")


def mixing(people: DataFrame, hour: int, chance: float, same_area: float = 0.5, seed: int = 42) -> DataFrame:
    """Visits between households ``guest, host_household``: guests are those whose hash falls
    under ``chance``; each goes to a household drawn by hash within its area, or within all."""
    home = people.select("person_id", "household_id", "cbg")
    guest = home.where(ids.uniform(str(seed), str(hour), "visit", F.col("person_id")) < chance)
    house = home.select(F.col("household_id").alias("host_household"), F.col("cbg").alias("host_cbg")).distinct()
    w = Window.partitionBy("host_cbg").orderBy(F.xxhash64("host_household", F.lit(hour)), "host_household")
    host = house.withColumn("pos", F.row_number().over(w))
    sizes = house.groupBy("host_cbg").agg(F.count("*").alias("n"))
    aim = guest.join(sizes, guest["cbg"] == sizes["host_cbg"]).withColumn("pos", (1 + F.floor(ids.uniform(str(seed), str(hour), "host", F.col("person_id")) * F.col("n"))).cast("int"))
    out = aim.join(host, ["host_cbg", "pos"]).where(F.col("household_id") != F.col("host_household"))
    return out.select(F.col("person_id").alias("guest"), "host_household")
