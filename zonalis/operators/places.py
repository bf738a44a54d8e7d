"""Places: candidate places of an area, shares, catchments, areas of buildings, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures, parsers

PANEL_DEFAULT, LEAST_SHARE, AREA_DEFAULT = 19.7, 0.02, 650.0


def candidates(visits: DataFrame, area: str, cluster: DataFrame, limit: int = 8) -> DataFrame:
    """The places of an area by visitors from the cluster: sums per place, the first
    description met, the top rows (1 to 20) and their shares of what is returned."""
    limit = max(1, min(20, limit))
    key = F.coalesce(F.nullif(F.trim("placekey"), F.lit("")), F.concat_ws(":", "poi_cbg", "location_name"))
    rows = visits.where(F.col("poi_cbg") == area).select(key.alias("place"), "location_name", F.coalesce("raw_visit_counts", F.lit(0.0)).alias("v"), F.coalesce("raw_visitor_counts", F.lit(0.0)).alias("w"), parsers.flow_entries(F.col("visitor_daytime_cbgs"), 3, True).alias("e"))
    flows = rows.select("place", F.explode("e").alias("e")).select("place", F.col("e.area").alias("cbg"), F.col("e.weight").alias("weight")).join(cluster.select("cbg").distinct(), "cbg", "left_semi").groupBy("place").agg(F.sum("weight").alias("flow"))
    sums = rows.groupBy("place").agg(F.min("location_name").alias("location_name"), F.sum("v").alias("visits"), F.sum("w").alias("visitors"), F.count("*").alias("n_rows"))
    top = sums.join(flows, "place").orderBy(F.desc("flow"), F.desc("visits"), F.desc("location_name")).limit(limit)
    total = F.sum("flow").over(Window.partitionBy(F.lit(1)))  # of the few rows returned
    return top.select("place", "location_name", F.round("flow", 2).alias("cluster_flow"), F.round("visits", 2).alias("raw_visit_counts"), F.round("visitors", 2).alias("raw_visitor_counts"), "n_rows", F.round(F.col("flow") / total, 4).alias("flow_share"))


def panel_factor(visits: DataFrame, days: int = 30, fixed: float | None = None) -> DataFrame:
    """One row ``factor``: the median of scaled over raw visits, per day; ``fixed`` overrides."""
    ratio = F.try_divide(F.col("normalized_visits_by_state_scaling").cast("double"), F.col("raw_visit_counts").cast("double"))
    found = F.median(F.when(~F.isnan(ratio) & (F.abs(ratio) < float("inf")), ratio)) / days
    return visits.agg((F.lit(float(fixed)) if fixed is not None else F.coalesce(found, F.lit(PANEL_DEFAULT))).alias("factor"))


def catchment(homes: DataFrame, cluster: DataFrame, key: str = "placekey") -> DataFrame:
    """Per place the share of its visitors whose home is in the cluster, of rows
    ``key, cbg, weight``; null without visitors."""
    inside = homes.join(cluster.select("cbg", F.lit(1).alias("m")).distinct(), "cbg", "left")
    total = F.sum("weight")
    return inside.groupBy(key).agg(F.when(total > 0, F.coalesce(F.sum(F.when(F.col("m") == 1, F.col("weight"))), F.lit(0.0)) / total).alias("inside_share"))


def filled_share(shares: DataFrame) -> DataFrame:
    """Missing shares become the median of the known ones (1 without any), small ones 0.02."""
    one = shares.agg(F.coalesce(F.median("inside_share"), F.lit(1.0)).alias("middle")).withColumn("k", F.lit(1))
    out = shares.withColumn("k", F.lit(1)).join(F.broadcast(one), "k")  # one row
    return out.withColumn("inside_share", F.greatest(F.coalesce("inside_share", "middle"), F.lit(LEAST_SHARE))).drop("k", "middle")


def filled_area(places: DataFrame, area: str = "wkt_area_sq_meters", category: str = "top_category") -> DataFrame:
    """Areas that are missing or not positive become their category's median, else the
    median of all, else 650."""
    good = F.when(F.col(area) > 0, F.col(area))
    by = places.groupBy(category).agg(F.median(good).alias("own"))
    one = places.agg(F.median(good).alias("all")).withColumn("k", F.lit(1))
    out = places.alias("p").join(by.alias("b"), F.col(f"p.{category}").eqNullSafe(F.col(f"b.{category}"))).select("p.*", "own").withColumn("k", F.lit(1)).join(F.broadcast(one), "k")
    return out.withColumn(area, F.coalesce(good, F.col("own"), F.col("all"), F.lit(AREA_DEFAULT))).drop("own", "all", "k")


def stats(visits: DataFrame) -> DataFrame:
    """Per place: dwell hours, 24 hourly counts, seven day factors, seven gates of 24."""
    gates = F.array(*(parsers.open_gate(F.col("open_hours"), F.col("naics_code"), d) for d in parsers.WEEKDAYS))
    return visits.select("placekey", measures.dwell_hours(F.col("median_dwell")).alias("dwell"), parsers.hours(F.col("popularity_by_hour")).alias("hours"), measures.day_factor(parsers.weekdays(F.col("popularity_by_day"))).alias("days"), gates.alias("gates"))


def targets(stat: DataFrame, shares: DataFrame, scale: float, weekday: int) -> DataFrame:
    """``placekey, hour, target``: wanted occupancy of each hour of a weekday (0 is Monday)."""
    rows = stat.join(shares, "placekey").select("placekey", "inside_share", F.col("days")[weekday].alias("day"), F.col("gates")[weekday].alias("gate"), F.posexplode("hours").alias("hour", "count"))
    return rows.select("placekey", "hour", measures.half_up(F.col("count") * F.col("day") * F.col("gate")[F.col("hour")] * F.col("inside_share") * scale).cast("bigint").alias("target"))


def best_rows(rows: DataFrame, key: str = "placekey") -> DataFrame:
    """Of each place the row with a polygon, else with a position, else the first by ``row``."""
    score = F.struct(F.col("polygon_wkt").isNotNull().alias("p"), (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("l"), (-F.col("row")).alias("r"))
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), score).alias("r")).select(key, "r.*")


def common_names(members: DataFrame, group: str = "group_id", name: str = "location_name") -> DataFrame:
    """Of each group the most frequent normalised name, ties by alphabet, shown by its
    shortest spelling."""
    rows = members.withColumn("norm", F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", " "))
    counts = rows.groupBy(group, "norm").agg(F.count("*").alias("n"), F.min(F.struct(F.length(name).alias("l"), F.col(name).alias("name"))).alias("s"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("o"), "norm", "s")).alias("m")).select(group, F.col("m.norm").alias("norm"), F.col("m.s.name").alias("display"), (-F.col("m.o")).alias("n"))


def filter_groups(members: DataFrame, least: int = 1, ids: list[str] | None = None, contains: str | None = None, regions: list[str] | None = None) -> DataFrame:
    """Groups with enough members, of the given ids, with a member of that name and region."""
    if ids is not None:
        members = members.where(F.col("group_id").isin(ids))
    one = members.groupBy("group_id").agg(F.count("*").alias("members"), F.max(F.contains(F.lower("location_name"), F.lit((contains or "").lower()))).alias("named"), F.max(F.col("region").isin(regions or [])).alias("there"))
    return one.where((F.col("members") >= least) & (F.lit(contains is None) | F.col("named")) & (F.lit(regions is None) | F.col("there"))).select("group_id", "members")


def select_places(visits: DataFrame, areas: list[str] | None = None, keys: list[str] | None = None, contains: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Places by area, key and any of some parts of their name, whatever its case."""
    if areas is not None:
        visits = visits.where(F.col("poi_cbg").isin(areas))
    if keys is not None:
        visits = visits.where(F.col("placekey").isin(keys))
    if contains:
        name = F.lower("location_name")
        any_of = F.lit(False)
        for part in contains:
            any_of = any_of | F.contains(name, F.lit(part.lower()))
        visits = visits.where(any_of)
    return visits if limit is None else visits.orderBy("placekey").limit(limit)


def top_by_area(visits: DataFrame, keep: int) -> DataFrame:
    """Each area's places by visits, visitors and name, ranked, the first ``keep``."""
    w = Window.partitionBy("poi_cbg").orderBy(F.desc_nulls_last("raw_visit_counts"), F.desc_nulls_last("raw_visitor_counts"), F.desc("location_name"))
    return visits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
