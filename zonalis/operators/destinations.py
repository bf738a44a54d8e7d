"""Second-order destinations: where a seed region's movement goes beyond itself.

Flows are summed to areas, areas to units (cities, or zips without a city). Ordered
running rules with state (which gateways, which recommendations) are folds over a
unit's, or the few units', sorted arrays, in plain higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, measures

GATEWAYS, GATEWAY_PEOPLE, GATEWAY_SHARE = 4, 12_000, 0.85
RECOMMENDED, RECOMMENDED_PEOPLE = 4, 25_000


def units(zips: DataFrame, cities: DataFrame) -> DataFrame:
    """``cbg, zip, unit`` of ``zips(cbg, zip)`` and ``cities(zip, city, state)``."""
    joined = zips.join(cities, "zip", "left")
    return joined.select("cbg", "zip", ids.city_unit(F.col("city"), F.col("state"), F.col("zip")).alias("unit"))


def flows_by_area(flow: DataFrame, seeds: DataFrame) -> DataFrame:
    """Areas outside: ``cbg, outbound`` from the seeds and ``inbound`` to them."""
    s = seeds.select("cbg").distinct()
    rows = flow.join(s.select(F.col("cbg").alias("src"), F.lit(1).alias("a")), "src", "left").join(s.select(F.col("cbg").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    rows = rows.where("a IS NULL AND b = 1 OR a = 1 AND b IS NULL")
    other = F.when(F.col("a") == 1, F.col("dst")).otherwise(F.col("src"))
    out = F.coalesce(F.sum(F.when(F.col("a") == 1, F.col("weight"))), F.lit(0.0))
    into = F.coalesce(F.sum(F.when(F.col("b") == 1, F.col("weight"))), F.lit(0.0))
    return rows.groupBy(other.alias("cbg")).agg(out.alias("outbound"), into.alias("inbound"))


def seed_movement(flow: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: the seeds' own flows and all that leaves each of them; what leaves and
    enters the set."""
    s = seeds.select("cbg").distinct()
    rows = flow.join(s.select(F.col("cbg").alias("src"), F.lit(1).alias("a")), "src", "left").join(s.select(F.col("cbg").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0))
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return rows.agg(when(a).alias("movement"), when(a & ~b).alias("external_outbound"), when(~a & b).alias("external_inbound"))


def by_unit(areas: DataFrame, unit: DataFrame, seeds: DataFrame, population: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """Per unit that is none of the seeds' own: flows, zips, areas, people, distance, coupling."""
    own = unit.join(seeds.select("cbg").distinct(), "cbg", "left_semi").select("unit").distinct()
    rows = areas.join(unit, "cbg").join(own, "unit", "left_anti").join(population, "cbg", "left")
    rows = rows.withColumn("population", F.coalesce("population", F.lit(0).cast("bigint")))
    if centers is not None:
        mean = centers.join(seeds.select("cbg").distinct(), "cbg", "left_semi").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0")).withColumn("k", F.lit(1))
        rows = rows.join(centers, "cbg", "left").withColumn("k", F.lit(1)).join(F.broadcast(mean), "k")  # one row
        rows = rows.withColumn("km", measures.haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))
    else:
        rows = rows.withColumn("km", F.lit(None).cast("double"))
    flow = F.col("outbound") + F.col("inbound")
    entry = F.struct("cbg", "outbound", "inbound", flow.alias("flow"), measures.coupling(F.col("outbound"), F.col("km")).alias("gateway_score"), "km", "population")
    out = rows.groupBy("unit").agg(F.sum("outbound").alias("outbound"), F.sum("inbound").alias("inbound"), F.sum(flow).alias("bidirectional"), F.sort_array(F.collect_set("zip")).alias("zips"), F.sum("population").alias("population"), F.min("km").alias("km"), F.collect_list(entry).alias("areas"))
    return out.withColumn("coupling", measures.coupling(F.col("outbound"), F.col("km")))


def _before(a: Column, b: Column, keys: list[tuple[str, bool]]) -> Column:
    """-1, 0 or 1: the order of two structs; ``True`` descends; nulls are last."""
    out = F.lit(0)
    for name, down in reversed(keys):
        x, y = a[name], b[name]
        if down:
            x, y = y, x
        own = F.when(a[name].isNull() & b[name].isNull(), 0).when(a[name].isNull(), 1).when(b[name].isNull(), -1).when(x < y, -1).when(x > y, 1).otherwise(0)
        out = F.when(own != 0, own).otherwise(out)
    return out


GATEWAY_ORDER = [("gateway_score", True), ("flow", True), ("outbound", True), ("km", False), ("population", False), ("cbg", False)]


def gateways(unit: DataFrame) -> DataFrame:
    """Adds ``gateways``: the first area, then further ones in order while there are fewer
    than 4 and under 85 % of the flow is captured; those without flow, or beyond 12 000
    people in all, are skipped."""
    order = F.array_sort("areas", lambda a, b: _before(a, b, GATEWAY_ORDER))
    total = F.greatest(F.col("outbound"), F.lit(1e-12))
    state = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("bigint").alias("people"), F.lit(0.0).alias("got"))

    def step(s: Column, x: Column) -> Column:
        first = F.size(s["ids"]) == 0
        full = (F.size(s["ids"]) >= GATEWAYS) | (s["got"] / total >= GATEWAY_SHARE)
        take = first | (~full & (x["flow"] > 0) & (s["people"] + x["population"] <= GATEWAY_PEOPLE))
        return F.struct(F.when(take, F.concat(s["ids"], F.array(x["cbg"]))).otherwise(s["ids"]).alias("ids"), F.when(take, s["people"] + x["population"]).otherwise(s["people"]).alias("people"), F.when(take, s["got"] + x["outbound"]).otherwise(s["got"]).alias("got"))

    return unit.withColumn("gateways", F.aggregate(order, state, step, lambda s: s["ids"]))


def ranked(unit: DataFrame, limit: int | None = None) -> DataFrame:
    """Destinations in order, with their share of all flow and running shares, at most 1."""
    order = [F.desc("coupling"), F.desc("bidirectional"), F.desc("outbound"), F.asc_nulls_last("km"), F.asc("population"), F.asc("unit")]
    total = unit.agg(F.sum("outbound").alias("all_outbound"), F.sum("bidirectional").alias("all_flow")).withColumn("k", F.lit(1))
    rows = unit.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").drop("k")  # one row
    rows = rows.withColumns({"share": F.coalesce(F.try_divide("outbound", "all_outbound"), F.lit(0.0)), "flow_share": F.coalesce(F.try_divide("bidirectional", "all_flow"), F.lit(0.0))})
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    w = Window.orderBy(*order)  # units of one seed region: a ranked list for a reader
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"rank": F.row_number().over(w), "captured_share": F.least(F.lit(1.0), F.sum("share").over(run)), "captured_flow_share": F.least(F.lit(1.0), F.sum("flow_share").over(run))}).drop("all_outbound", "all_flow")


def recommend(rank: DataFrame, seed_people: int, external_share: float | None = None) -> DataFrame:
    """Adds ``recommended``: in rank order, fewer than 4 so far, at most 25 000 people with the
    seeds, and a share of 10 %, or of 3 % while under 80 % is recommended, or the first one
    with 1 %."""
    one = rank.agg(F.array_sort(F.collect_list(F.struct("rank", "unit", "population", "share", "flow_share"))).alias("rows"))
    state = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(seed_people).cast("bigint").alias("people"), F.lit(0.0).alias("got"))

    def step(s: Column, x: Column) -> Column:
        some = (x["share"] >= 0.10) | ((s["got"] < 0.80) & (x["share"] >= 0.03)) | ((F.size(s["ids"]) == 0) & ((x["share"] >= 0.01) | (x["flow_share"] >= 0.01)))
        take = (F.size(s["ids"]) < RECOMMENDED) & (s["people"] + x["population"] <= RECOMMENDED_PEOPLE) & some
        return F.struct(F.when(take, F.concat(s["ids"], F.array(x["unit"]))).otherwise(s["ids"]).alias("ids"), F.when(take, s["people"] + x["population"]).otherwise(s["people"]).alias("people"), F.when(take, s["got"] + x["share"]).otherwise(s["got"]).alias("got"))

    chosen = one.select(F.explode(F.aggregate("rows", state, step, lambda s: s["ids"])).alias("unit"), F.lit(True).alias("recommended"))
    return rank.join(chosen, "unit", "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))


def seed_region(zips: DataFrame, cities: DataFrame, zip_: str) -> DataFrame:
    """One row ``label, cbgs``: the areas of a zip's city, or of the zip alone."""
    u = units(zips, cities)
    own = u.where(F.col("zip") == zip_).select("unit").distinct()
    return u.join(own, "unit", "left_semi").groupBy(F.col("unit").alias("label")).agg(F.sort_array(F.collect_set("cbg")).alias("cbgs"))
