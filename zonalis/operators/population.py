"""Synthetic populations from county marginals.

Every draw is a hash of the seed, the household or person and the draw's purpose, so
people do not depend on partitions, order or retries, and other engines can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, measures

#: Mean, deviation, least and largest age by role.
AGES = {
    "householder": (50, 15, 18, 95), "spouse_partner": (48, 15, 18, 95), "child": (15, 10, 0, 40), "grandchild": (10, 7, 0, 25), "parent": (75, 8, 55, 100),
    "sibling": (45, 15, 18, 95), "other_relative": (40, 20, 0, 95), "non_relative": (35, 15, 18, 95), "foster_child": (12, 5, 0, 21),
}
SIZES = ("size_2", "size_3", "size_4", "size_5", "size_6", "size_7_plus")


def impute(counties: DataFrame, state: DataFrame, columns: list[str], people: str = "pop_in_households") -> DataFrame:
    """Missing counts become the state's, scaled by people and rounded half to even."""
    total = state.select(*(F.col(c).alias(f"_{c}") for c in {*columns, people})).withColumn("k", F.lit(1))
    rows = counties.withColumn("k", F.lit(1)).join(F.broadcast(total), "k")  # one row
    ratio = F.try_divide(F.col(people).cast("double"), F.col(f"_{people}").cast("double"))
    return rows.select(*(F.coalesce(F.col(c), F.bround(F.col(f"_{c}") * ratio).cast("bigint")).alias(c) if c in columns else F.col(c) for c in counties.columns))


def household_counts(areas: DataFrame, counties: DataFrame) -> DataFrame:
    """``cbg, county, households``: the county's households for its sampled people, dealt by
    the areas' people, both rounded down; the state row ``000`` is left out."""
    own = areas.withColumn("county", ids.county_fips(F.col("cbg"))).where("county <> '000'")
    zone = own.groupBy("county").agg(F.sum("population").alias("zone"))
    rows = own.join(zone, "county").join(counties.select("county", "total_population", "total_households"), "county")
    target = F.floor(F.col("total_households") * F.try_divide("zone", "total_population"))
    return rows.select("cbg", "county", F.coalesce(F.floor(target * F.try_divide("population", "zone")), F.lit(0)).cast("bigint").alias("households"))


def households(counts: DataFrame, counties: DataFrame, seed: int = 42, include_singletons: bool = False) -> DataFrame:
    """One row per household: ``household_id, cbg, county, head_gender, partner, children,
    relatives, nonrelatives``."""
    rows = counts.where("households > 0").select("cbg", "county", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("households"))).alias("n"))
    rows = rows.withColumn("household_id", F.concat_ws("-", "cbg", "n")).join(counties, "county")
    u = lambda purpose: ids.uniform(str(seed), F.col("household_id"), purpose)
    chance = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    rows = rows.withColumn("family", u("family") < chance(c("total_family_households"), c("total_households")))
    sizes = F.array(*(F.coalesce(c(s).cast("double"), F.lit(0.0)) for s in SIZES))
    plain = F.greatest(F.lit(1), F.floor(measures.normal(u("size"), u("size2"), c("avg_household_size"), 1.0)))
    drawn = F.coalesce(measures.pick(u("size"), sizes) + 1, plain)
    if include_singletons:
        drawn = F.when(u("single") < chance(c("size_1"), c("total_households")), F.lit(1)).otherwise(drawn)
    rows = rows.withColumn("size", drawn.cast("bigint")).withColumn("head_gender", F.when(u("gender") < chance(c("male_householders"), c("householders")), "M").otherwise("F"))
    married = chance(c("opposite_sex_spouse") + c("same_sex_spouse"), c("family_households"))
    paired = chance(c("opposite_sex_unmarried_partner") + c("same_sex_unmarried_partner"), c("total_households") - c("total_family_households"))
    rows = rows.withColumn("partner", u("partner") < F.when(c("family"), married).otherwise(paired))
    rows = rows.withColumn("left", c("size") - c("partner").cast("bigint"))
    geometric = 1 + F.floor(F.ln(F.greatest(1 - u("children2"), F.lit(1e-12))) / F.ln(F.lit(0.5)))
    parents = u("children") < chance(c("with_children_under_18"), F.greatest(F.lit(1), c("total_family_households")))
    rows = rows.withColumn("children", F.when(c("family") & parents, F.greatest(F.lit(0), F.least(c("left") - 1, geometric))).otherwise(0).cast("bigint")).withColumn("left", c("left") - c("children"))
    x, p = u("relatives"), 0.36787944117144233
    poisson, total, term = F.lit(8), 0.0, p
    steps = []
    for k in range(8):
        total += term
        steps.append((total, k))
        term /= k + 1
    for edge, k in reversed(steps):
        poisson = F.when(x < edge, k).otherwise(poisson)
    rows = rows.withColumn("relatives", F.when(c("family") & (c("left") > 1), F.least(c("left") - 1, poisson)).otherwise(0).cast("bigint")).withColumn("left", c("left") - c("relatives"))
    return rows.select("household_id", "cbg", "county", "head_gender", "partner", "children", "relatives", F.greatest(F.lit(0), c("left") - 1).cast("bigint").alias("nonrelatives"))


def persons(house: DataFrame, counties: DataFrame, seed: int = 42) -> DataFrame:
    """``person_id, household_id, county, cbg, gender, age, relate_head, role``."""
    c = F.col
    members = F.concat(
        F.array(F.struct(F.lit("householder").alias("role"), F.lit(1).alias("relate"))),
        F.when(c("partner"), F.array(F.struct(F.lit("spouse_partner").alias("role"), F.lit(2).alias("relate")))).otherwise(F.array().cast("array<struct<role:string,relate:int>>")),
        F.array_repeat(F.struct(F.lit("child").alias("role"), F.lit(3).alias("relate")), c("children").cast("int")),
        F.array_repeat(F.struct(F.lit("relative").alias("role"), F.lit(4).alias("relate")), c("relatives").cast("int")),
        F.array_repeat(F.struct(F.lit("nonrelative").alias("role"), F.lit(5).alias("relate")), c("nonrelatives").cast("int")),
    )
    same = F.coalesce(F.try_divide((c("same_sex_spouse") + c("same_sex_unmarried_partner")).cast("double"), (c("same_sex_spouse") + c("same_sex_unmarried_partner") + c("opposite_sex_spouse") + c("opposite_sex_unmarried_partner")).cast("double")), F.lit(0.0))
    weights = measures.relative_weights(*(c(x).cast("double") for x in ("parent", "parent_in_law", "brother_or_sister", "grandchild", "other_relative")))
    rows = house.join(counties.select("county", same.alias("same"), weights.alias("weights")), "county")
    rows = rows.select("household_id", "county", "cbg", "head_gender", "same", "weights", F.posexplode(members).alias("at", "m"))
    rows = rows.withColumn("person_id", F.concat_ws("-", "household_id", c("at") + 1))
    u = lambda purpose: ids.uniform(str(seed), F.col("person_id"), purpose)
    kinds = F.array(*(F.lit(x) for x in ("parent", "sibling", "grandchild", "other_relative")))
    role = F.when(c("m.role") == "relative", F.coalesce(F.try_element_at(kinds, measures.pick(u("kind"), c("weights"))), F.lit("other_relative"))).when(c("m.role") == "nonrelative", F.when(u("foster") < 0.1, "foster_child").otherwise("non_relative")).otherwise(c("m.role"))
    rows = rows.withColumn("role", role)
    other = F.when(c("head_gender") == "M", "F").otherwise("M")
    gender = F.when(c("m.relate") == 1, c("head_gender")).when(c("m.relate") == 2, F.when(u("same") < c("same"), c("head_gender")).otherwise(other)).otherwise(F.when(u("gender") < 0.5, "M").otherwise("F"))
    age: Column = F.lit(None).cast("bigint")
    for name, (mean, std, low, high) in AGES.items():
        z = measures.normal(u("age"), u("age2"), mean, std)
        age = F.when(c("role") == name, F.greatest(F.lit(low), F.least(F.lit(high), F.when(z >= 0, F.floor(z)).otherwise(F.ceil(z))))).otherwise(age)
    return rows.select("person_id", "household_id", "county", "cbg", gender.alias("gender"), age.cast("int").alias("age"), c("m.relate").alias("relate_head"), "role")


def homes(house: DataFrame, centers: DataFrame, buildings: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``household_id, lat, lon``: a building of the area drawn by weight, from
    ``buildings(cbg, lat, lon, weight)``; else the area's centre."""
    rows = house.select("household_id", "cbg")
    if buildings is not None:
        # each building owns a span of its area's running weight: a lookup, not a pair of all
        w = buildings.groupBy("cbg").agg(F.array_sort(F.collect_list(F.struct("lat", "lon", "weight"))).alias("b"))
        rows = rows.join(w, "cbg", "left")
        at = measures.pick(ids.uniform(str(seed), F.col("household_id"), "home"), F.transform("b", lambda x: x["weight"]))
        rows = rows.withColumn("home", F.try_element_at("b", at)).drop("b")
    else:
        rows = rows.withColumn("home", F.lit(None).cast("struct<lat:double,lon:double,weight:double>"))
    rows = rows.join(centers, "cbg", "left")
    return rows.select("household_id", F.coalesce("home.lat", "lat").alias("lat"), F.coalesce("home.lon", "lon").alias("lon"))


def validation(people: DataFrame) -> DataFrame:
    """``measure, key, value``: shares of household sizes, genders and relations, and the
    ages' mean, median and range."""
    size = people.groupBy("household_id").agg(F.count("*").alias("n"))

    def shares(df: DataFrame, name: str, key: Column) -> DataFrame:
        total = df.agg(F.count("*").alias("all")).withColumn("k", F.lit(1))
        return df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select(F.lit(name).alias("measure"), "key", (F.col("n") / F.col("all")).alias("value"))

    ages = people.agg(F.avg("age").alias("mean"), F.median("age").alias("median"), F.min("age").cast("double").alias("min"), F.max("age").cast("double").alias("max"))
    ages = ages.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("mean", "median", "min", "max"))), F.array("mean", "median", "min", "max"))).alias("key", "value")).select(F.lit("age").alias("measure"), "key", "value")
    return shares(size, "size", F.col("n")).unionByName(shares(people, "gender", F.col("gender"))).unionByName(shares(people, "relation", F.col("relate_head"))).unionByName(ages)


def papdata(people: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People ``id, sex, age, home``, homes ``id, cbg, members`` and places ``id, placekey,
    label, ...``: sex 0 is male, a missing category is the text ``None``."""
    folk = people.select(F.col("person_id").alias("id"), F.when(F.col("gender") == "M", 0).when(F.col("gender") == "F", 1).alias("sex"), "age", F.col("household_id").alias("home"))
    house = people.groupBy(F.col("household_id").alias("id")).agg(F.min("cbg").alias("cbg"), F.count("*").alias("members"))
    return folk, house, places.withColumn("top_category", F.coalesce("top_category", F.lit("None")))
