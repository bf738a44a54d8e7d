"""Which mapped buildings and land are homes, and how many homes they stand for.

Tags come as ``map<string,string>``; a tag that is blank counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Building tags by kind, and the tags that speak against a home.
HOMES = ("apartments", "bungalow", "cabin", "detached", "dormitory", "ger", "house", "houseboat", "residential", "semidetached_house", "static_caravan", "terrace", "trullo")
MANY_HOMES = ("apartments", "dormitory", "residential")
SOME_HOMES = ("terrace", "semidetached_house")
UNCLEAR = ("building", "yes")
OTHER = (
    "barn", "carport", "cathedral", "chapel", "church", "civic", "commercial", "construction", "factory", "farm_auxiliary", "fire_station", "garage", "garages", "government", "grandstand",
    "greenhouse", "hangar", "hospital", "hotel", "industrial", "kiosk", "kindergarten", "mosque", "office", "parking", "pavilion", "public", "retail", "roof", "school", "service", "shed",
    "sports_centre", "stadium", "supermarket", "synagogue", "temple", "train_station", "transportation", "warehouse",
)
AGAINST = ("aeroway", "amenity", "healthcare", "industrial", "landuse", "leisure", "man_made", "military", "office", "power", "public_transport", "railway", "shop", "tourism")


def _tag(tags: Column, name: str) -> Column:
    return F.nullif(F.lower(F.trim(F.try_element_at(tags, F.lit(name)))), F.lit(""))


def is_home(tags: Column) -> Column:
    """Whether a building is residential; an unclear one is, unless another tag speaks against it."""
    kind = _tag(tags, "building")
    odd = F.lit(False)
    for name in AGAINST:
        value = _tag(tags, name)
        odd = odd | (F.coalesce(value != "residential", F.lit(False)) if name == "landuse" else value.isNotNull())
    sure = kind.isin(*HOMES) | F.coalesce(_tag(tags, "building:use").isin(*HOMES), F.lit(False)) | _tag(tags, "residential").isNotNull()
    return F.when(kind.isNull() | kind.isin(*OTHER), F.lit(False)).when(sure, F.lit(True)).when(kind.isin(*UNCLEAR), ~odd).otherwise(F.lit(False))


def is_home_land(tags: Column) -> Column:
    return F.coalesce(_tag(tags, "landuse") == "residential", F.lit(False)) | _tag(tags, "residential").isNotNull()


def building_weight(tags: Column, area: Column) -> Column:
    """The floor area, from 25 to 2500, times the homes that the kind of building holds."""
    kind = _tag(tags, "building")
    times = F.when(kind.isin(*MANY_HOMES), 6.0).when(kind.isin(*SOME_HOMES), 1.6).when(kind.isin(*HOMES), 1.0).when(kind.isin(*UNCLEAR), 0.35).otherwise(0.2)
    times = F.when(_tag(tags, "residential").isNotNull(), F.greatest(times, F.lit(1.5))).otherwise(times)
    return F.least(F.greatest(area, F.lit(25.0)), F.lit(2500.0)) * times


def land_weight(area: Column) -> Column:
    return F.least(F.greatest(area, F.lit(100.0)), F.lit(25000.0))
