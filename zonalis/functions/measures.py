"""Distances, shares and the movement model's column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_KM)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(atan2(sqrt({a}), sqrt(1 - {a})) * {2 * EARTH_KM})"


def penalty(km: Column, scale: float) -> Column:
    return km / (km + scale)


def coupling(flow: Column, km: Column, scale: float = 20.0) -> Column:
    """A flow damped by distance; undamped if the distance is unknown."""
    return F.when(km.isNull(), flow).otherwise(flow / (1 + km / scale))


def ratio_color(ratio: Column) -> Column:
    steps = ((0.8, "blue"), (0.6, "green"), (0.4, "yellow"), (0.2, "orange"))
    out = F.lit("red")
    for least, name in reversed(steps):
        out = F.when(ratio >= least, name).otherwise(out)
    return out


def share(values: Column) -> Column:
    """An array scaled to sum 1; zeros if the sum is not positive."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def dwell_hours(minutes: Column) -> Column:
    m = minutes.try_cast("double")
    return F.coalesce(F.greatest(F.lit(1), F.ceil(F.when(F.isnan(m), F.lit(60.0)).otherwise(m) / 60).cast("int")), F.lit(1))


def day_factor(days: Column) -> Column:
    """Each weekday's count over the mean; all 1 if the mean is 0."""
    total = F.aggregate(days, F.lit(0.0), lambda a, x: a + x)
    return F.transform(days, lambda x: F.when(total > 0, x * 7 / total).otherwise(F.lit(1.0)))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def external_ratio(inside: Column, least: float = 0.02) -> Column:
    f = F.greatest(inside, F.lit(least))
    return (1 - f) / f


def relative_weights(parent: Column, in_law: Column, sibling: Column, grandchild: Column, other: Column) -> Column:
    return F.array(parent + in_law, sibling, grandchild, other)


def pick(u: Column, weights: Column) -> Column:
    """The 1-based entry that a uniform number falls on, entries being as wide as their
    weights; null if no weight is positive."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    state = F.aggregate(weights, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("at")), lambda s, w: F.struct((s["sum"] + w).alias("sum"), (s["n"] + 1).alias("n"), F.when((s["at"] == 0) & (w > 0) & (u * total < s["sum"] + w), s["n"] + 1).otherwise(s["at"]).alias("at")))
    return F.when(total > 0, F.nullif(state["at"], F.lit(0)))


def normal(u1: Column, u2: Column, mean: float | Column, std: float) -> Column:
    """A normal number from two uniform ones."""
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(2.0**-33)))) * F.cos(u2 * 6.283185307179586) * std + mean
