"""The mobility concepts as views over the driver's tables, and the same in SQL.

A nation is an area, its customers its people, a supplier a place, the line items that its
customers order from a supplier are visits, a region a zip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A month whose flow graph is sparse.
MONTH = "1995-06"

SQL = """
area AS (SELECT n_nationkey AS k, n_regionkey AS r, printf('24%03d%07d', n_regionkey, n_nationkey) AS cbg,
                30 + (n_nationkey * 7 % 25) * 0.8::DOUBLE AS lat, -100 + (n_nationkey * 11 % 25) * 1.1::DOUBLE AS lon FROM nation),
population AS (SELECT a.cbg, count(c.c_custkey)::BIGINT AS population FROM area a LEFT JOIN customer c ON c.c_nationkey = a.k GROUP BY 1),
visit AS (SELECT s.s_suppkey, c.c_custkey, strftime(l.l_shipdate, '%Y-%m') AS month, ca.cbg AS src, sa.cbg AS dst, l.l_quantity AS weight
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
          JOIN area ca ON c.c_nationkey = ca.k JOIN area sa ON s.s_nationkey = sa.k),
rec AS (SELECT src, dst, weight FROM visit WHERE month = '1995-06'),
flow AS (SELECT src, dst, sum(weight) AS weight FROM rec GROUP BY 1, 2),
edge AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, sum(weight) AS weight FROM rec WHERE src <> dst GROUP BY 1, 2),
adj AS (SELECT u AS a, v AS b, weight FROM edge UNION ALL SELECT v, u, weight FROM edge),
node AS (SELECT cbg, sum(w) AS self_weight FROM (SELECT src AS cbg, CASE WHEN src = dst THEN weight ELSE 0 END AS w FROM rec UNION ALL SELECT dst, 0 FROM rec) GROUP BY 1),
cluster AS (SELECT cbg FROM area WHERE r = 0)"""


class Views:
    """Tables of one folder, by concept."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def area(self) -> DataFrame:
        k = F.col("n_nationkey")
        cbg = F.concat(F.lit("24"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0"), F.lpad(k.cast("string"), 7, "0"))
        return self.table("nation").select(k.alias("k"), F.col("n_regionkey").alias("r"), cbg.alias("cbg"), (F.lit(30) + (k * 7 % 25) * F.lit(0.8)).alias("lat"), (F.lit(-100) + (k * 11 % 25) * F.lit(1.1)).alias("lon"))

    @property
    def population(self) -> DataFrame:
        c = self.table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("population"))
        return self.area.join(c, "k", "left").select("cbg", F.coalesce("population", F.lit(0)).cast("bigint").alias("population"))

    @property
    def visits(self) -> DataFrame:
        """``s_suppkey, c_custkey, month, src, dst, weight``: one row per line item."""
        a = self.area
        c = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("k")).join(a.select("k", F.col("cbg").alias("src")), "k").drop("k")
        s = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("k")).join(a.select("k", F.col("cbg").alias("dst")), "k").drop("k")
        line = self.table("lineitem").select("l_orderkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_quantity").alias("weight"))
        rows = line.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.select("s_suppkey", "c_custkey", "month", "src", "dst", "weight")

    @property
    def rec(self) -> DataFrame:
        return self.visits.where(F.col("month") == MONTH).select("src", "dst", "weight")

    @property
    def cluster(self) -> DataFrame:
        return self.area.where("r = 0").select("cbg")

    @property
    def centers(self) -> DataFrame:
        return self.area.select("cbg", "lat", "lon")

    @property
    def patterns(self) -> DataFrame:
        """A visit table as it is read: a row per place, maps as JSON text. Some ids lose a
        digit or gain a decimal point, some maps are encoded twice, some texts are garbage."""
        by = self.visits.where(F.col("month") == MONTH).groupBy("s_suppkey", "src").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
        maps = by.groupBy("s_suppkey").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("src", "w"))))).alias("m"), F.sum("n").cast("double").alias("raw_visit_counts"), F.count("*").cast("double").alias("raw_visitor_counts"))
        s = self.table("supplier").join(self.area.select(F.col("k").alias("s_nationkey"), "r", "cbg"), "s_nationkey").join(maps, "s_suppkey", "left")
        k = F.col("s_suppkey")
        twice = F.to_json(F.struct(F.col("m").alias("x")))
        return s.select(
            F.concat(F.lit("poi-"), k).alias("PLACEKEY"), F.when(k % 3 == 0, F.concat("cbg", F.lit(".0"))).otherwise(F.col("cbg")).alias("POI_CBG"), (F.lit(10000) + F.col("r")).alias("postal_code"), F.col("s_name").alias("location_name"),
            F.when(k % 7 == 0, F.lit("not json")).when(k % 5 == 0, F.substring(twice, F.lit(6), F.length(twice) - 6)).otherwise(F.col("m")).alias("visitor_daytime_cbgs"), F.col("m").alias("visitor_home_cbgs"),
            F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("cat"), k % 4)).alias("top_category"), F.when(k % 6 == 0, -1.0).when(k % 11 == 0, None).otherwise(k.cast("double")).alias("wkt_area_sq_meters"),
            "raw_visit_counts", "raw_visitor_counts", (F.col("raw_visit_counts") * (k % 9 + 1)).alias("normalized_visits_by_state_scaling"), (k % 200).cast("double").alias("median_dwell"),
            F.when(k % 2 == 0, F.lit('{"Mon":[["8:00","17:00"]],"Sat":[["22:00","2:30"]],"Sun":[["0:00","0:00"]]}')).alias("open_hours"), F.element_at(F.array(*map(F.lit, ("445110", "722511", "999999", "610000"))), (k % 4 + 1).cast("int")).alias("naics_code"),
            F.to_json(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: (h * 7 + k) % 50)).alias("popularity_by_hour"), F.to_json(F.create_map(F.lit("Monday"), k % 10, F.lit("Friday"), k % 13, F.lit("Nosuchday"), F.lit(5).cast("bigint"))).alias("popularity_by_day"),
        )

    @property
    def zips(self) -> DataFrame:
        a = self.area.select("cbg", "k", F.array(F.col("r"), (F.col("r") + 1) % 5).alias("rs"))
        rows = a.select("cbg", "k", F.posexplode("rs").alias("i", "r")).where("i = 0 OR k % 3 = 0")
        lists = rows.groupBy((F.lit(10000) + F.col("r")).cast("string").alias("zip")).agg(F.sort_array(F.collect_list("cbg")).alias("cbgs"))
        return lists

    @property
    def squares(self) -> DataFrame:
        """A unit square for each nation in a grid of five columns, as polygon text."""
        k = F.col("n_nationkey")
        x, y = (k % 5).cast("string"), F.floor(k / 5).cast("string")
        x1, y1 = (k % 5 + 1).cast("string"), (F.floor(k / 5) + 1).cast("string")
        p = lambda a, b: F.concat(a, F.lit(" "), b)
        return self.table("nation").select(k.cast("bigint").alias("id"), F.concat(F.lit("POLYGON (("), F.concat_ws(", ", p(x, y), p(x1, y), p(x1, y1), p(x, y1), p(x, y)), F.lit("))")).alias("wkt"))

    @property
    def counties(self) -> DataFrame:
        """Marginals of each region as a county, by rule."""
        c = F.col
        pop = self.area.select(F.substring("cbg", 3, 3).alias("county"), "cbg").join(self.population, "cbg").groupBy("county").agg(F.sum("population").alias("total_population"))
        h = F.floor(c("total_population") / 2).cast("bigint")
        share = lambda n, d: F.floor(h * n / d).cast("bigint")
        return pop.select("county", "total_population", h.alias("total_households"), h.alias("householders"), share(2, 3).alias("total_family_households"), share(2, 3).alias("family_households"), share(1, 2).alias("male_householders"), F.lit(2.5).alias("avg_household_size"), *(share(7 - i, 30).alias(s) for i, s in enumerate(("size_1", "size_2", "size_3", "size_4", "size_5", "size_6", "size_7_plus"))), share(1, 3).alias("opposite_sex_spouse"), share(1, 50).alias("same_sex_spouse"), share(1, 20).alias("opposite_sex_unmarried_partner"), share(1, 90).alias("same_sex_unmarried_partner"), share(1, 3).alias("with_children_under_18"), share(1, 40).alias("parent"), share(1, 80).alias("parent_in_law"), share(1, 30).alias("brother_or_sister"), share(1, 25).alias("grandchild"), share(1, 35).alias("other_relative"))
