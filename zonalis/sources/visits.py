"""Monthly visit tables: discovery, exact-month resolution, normalised scans.

Paths are listed and read by Spark's own file systems, so any store will do. Area ids are
normalised once, at the scan; afterwards a filter on them is a plain string predicate.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..functions.calendar import month_key

#: In the order in which files of one month are preferred.
EXTENSIONS = (".parquet", ".csv.gz", ".converted.csv", ".csv")
#: Columns that later steps expect; a file that lacks one gives nulls.
COLUMNS = {
    "placekey": T.StringType(), "poi_cbg": T.StringType(), "postal_code": T.StringType(), "location_name": T.StringType(), "top_category": T.StringType(),
    "sub_category": T.StringType(), "naics_code": T.StringType(), "latitude": T.DoubleType(), "longitude": T.DoubleType(), "street_address": T.StringType(),
    "city": T.StringType(), "region": T.StringType(), "polygon_wkt": T.StringType(), "wkt_area_sq_meters": T.DoubleType(), "open_hours": T.StringType(),
    "raw_visit_counts": T.DoubleType(), "raw_visitor_counts": T.DoubleType(), "normalized_visits_by_state_scaling": T.DoubleType(), "median_dwell": T.DoubleType(),
    "popularity_by_hour": T.StringType(), "popularity_by_day": T.StringType(), "visitor_home_cbgs": T.StringType(), "visitor_daytime_cbgs": T.StringType(),
}
PLACE_COLUMNS = ("placekey", "location_name", "top_category", "latitude", "longitude", "street_address", "postal_code", "polygon_wkt", "wkt_area_sq_meters", "visitor_home_cbgs")
CLUSTER_COLUMNS = ("poi_cbg", "visitor_daytime_cbgs", "postal_code")
STATS_COLUMNS = ("placekey", "median_dwell", "popularity_by_hour", "popularity_by_day", "open_hours", "naics_code", "visitor_home_cbgs", "raw_visit_counts", "raw_visitor_counts", "normalized_visits_by_state_scaling")


def select_existing(df: DataFrame, columns: Sequence[str] | dict[str, T.DataType]) -> DataFrame:
    """The named columns, of any case; one that is missing is null."""
    have = {c.lower(): c for c in df.columns}
    kinds = columns if isinstance(columns, dict) else dict.fromkeys(columns, T.StringType())
    return df.select(*((F.col(f"`{have[c]}`") if c in have else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that are absent in any case."""
    have = {c.lower() for c in df.columns}
    return [c for c in required if c.lower() not in have]


def normalise(df: DataFrame, areas: Sequence[str] | DataFrame | None = None, zips: Sequence[str] | None = None) -> DataFrame:
    """Lower-case names and normalised area ids; rows of ``areas`` or, without them, ``zips``."""
    low = df.toDF(*(c.lower() for c in df.columns))
    out = low.withColumn("poi_cbg", ids.area_id(F.col("poi_cbg")))
    if isinstance(areas, DataFrame):
        return out.join(areas.select(F.col(areas.columns[0]).alias("poi_cbg")).distinct(), "poi_cbg", "left_semi")
    if areas is not None:
        return out.where(F.col("poi_cbg").isin(list(areas)))
    if zips is not None:
        return out.where(ids.zip_code(F.lpad(F.col("postal_code").cast("string"), 5, "0")).isin(list(zips)))
    return out


def read(spark: SparkSession, paths: Sequence[str], areas=None, zips=None) -> DataFrame:
    """Union of visit files, Parquet or CSV; CSV rows without an area id are dropped."""
    out = None
    for path in paths:
        if path.lower().endswith(".parquet"):
            part = normalise(spark.read.parquet(path), areas, zips)
        else:
            part = normalise(spark.read.csv(path, header=True, escape='"', multiLine=True), areas, zips).where("poi_cbg IS NOT NULL")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no visit files")
    return out


def discover(spark: SparkSession, folder: str, state: str | None = None) -> DataFrame:
    """``state, month, path`` of the monthly files below a folder, in any of the layouts
    ``STATE/YYYY-MM-STATE.ext``, ``STATE/YYYY-MM.ext`` and ``YYYY-MM-STATE.ext``; of one
    month the preferred extension. Listing is Spark's; contents are not read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[tuple[str, str], tuple[int, str]] = {}
    if fs.exists(root):
        for status in [*fs.listStatus(root)]:
            inner = [*fs.listStatus(status.getPath())] if status.isDirectory() and not str(status.getPath()).endswith(".parquet") else [status]
            for f in inner:
                path = f.getPath().toString()
                m = re.search(r"(?:/([A-Z]{2}))?/(\d{4}-\d{2})(?:-([A-Z]{2}))?(\.parquet|\.csv\.gz|\.converted\.csv|\.csv)$", path)
                own = m and (m[3] or m[1])
                if own and (state is None or own == state):
                    found[own, m[2]] = min(found.get((own, m[2]), (9, "")), (EXTENSIONS.index(m[4]), path))
    return spark.createDataFrame([(s, m, p) for (s, m), (_, p) in sorted(found.items())], "state string, month string, path string")


def available_months(files: DataFrame, state: str | None = None) -> DataFrame:
    return (files if state is None else files.where(F.col("state") == state)).select("state", "month").distinct()


def resolve(files: DataFrame, states: Sequence[str], start: str | None) -> list[str]:
    """The path of each state's file for the month of ``start``, or for each state's latest
    month without it; ``FileNotFoundError`` tells what there is."""
    own = files.where(F.col("state").isin(list(states)))
    if start is None:
        rows = own.groupBy("state").agg(F.max_by("path", "month").alias("path")).collect()
    else:
        month = files.sparkSession.range(1).select(month_key(F.lit(start)).alias("m")).first().m
        rows = own.where(F.col("month") == month).collect()
    got = {r.state: r.path for r in rows}
    if lack := [s for s in states if s not in got]:
        there = sorted(r.month for r in own.select("month").distinct().collect())
        raise FileNotFoundError(f"no file of {start or 'any month'} for {', '.join(lack)}; there are {', '.join(there) or 'none'}")
    return [got[s] for s in states]


def missing_months(required: DataFrame, files: DataFrame) -> DataFrame:
    """``state, month`` that are required and not there."""
    return required.select("state", "month").exceptAll(files.select("state", "month").distinct())


def month_slice(files: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Files of an inclusive range of months, in order."""
    out = files
    if first:
        out = out.where(F.col("month") >= first)
    if last:
        out = out.where(F.col("month") <= last)
    return out.orderBy("state", "month")


def first_row(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row per key: the first by ``order``, or the last. Two-phase aggregate, no window."""
    pick = F.max if last else F.min
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(pick(F.struct(order, *rest)).alias("r")) if not rest else df.groupBy(key).agg((F.max_by if last else F.min_by)(F.struct(*rest), order).alias("r"), pick(order).alias(order))
    return best.select(key, order, "r.*") if rest else best.select(key, f"r.{order}")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, percent``: rows whose value says something, to one decimal; 0 for a column
    that is absent and for an empty table."""
    have = {c.lower(): c for c in df.columns}
    shares = [(F.round(100 * F.avg(F.when(ids.is_blank(F.col(f"`{have[c]}`")), 0.0).otherwise(1.0)), 1) if c in have else F.lit(0.0)).alias(c) for c in columns]
    one = df.agg(F.count("*").alias("_n"), *shares)
    return one.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit(0.0))) for c in columns)))).alias("field", "percent"))


def where(df: DataFrame, **conditions: tuple[str, object]) -> DataFrame:
    """Rows that meet all ``column=(operator, value)``; operators ``== != < <= > >= in``."""
    ops = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "in": lambda c, v: c.isin(list(v))}
    for name, (op, value) in conditions.items():
        if name not in df.columns:
            raise KeyError(name)
        if op not in ops:
            raise ValueError(f"unknown operator {op}")
        df = df.where(ops[op](F.col(name), value))
    return df


def zip_areas(spark: SparkSession, text: DataFrame) -> DataFrame:
    """``zip, pos, cbg`` of rows ``zip, cbgs array<string>``: normalised, without repeats."""
    flat = text.select(ids.zip_code(F.col("zip")).alias("zip"), F.posexplode(ids.ordered_distinct(F.transform("cbgs", ids.area_id))).alias("pos", "cbg"))
    return flat.where("zip IS NOT NULL")


def area_zip(zips: DataFrame) -> DataFrame:
    """``cbg, zip``: of several, the first zip by name and place in it."""
    return zips.groupBy("cbg").agg(F.min_by("zip", F.struct("zip", "pos")).alias("zip"))


def neighbours(states: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Distinct neighbouring states of ``states(code, neighbours array<string>)``."""
    return states.where(F.col("code").isin(list(codes))).select(F.explode("neighbours").alias("state")).distinct()
