"""Parsers of the visit tables' JSON columns. None raises: what cannot be read is null,
empty or dropped, entry by entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import area_id

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

#: Opening and closing hour by industry sector.
SECTOR_HOURS = {
    "23": (7, 17), "31": (6, 18), "32": (6, 18), "33": (6, 18), "44": (8, 21), "45": (8, 21), "51": (8, 18), "52": (8, 18), "53": (8, 18), "54": (8, 18),
    "55": (8, 18), "56": (8, 18), "61": (7, 18), "62": (7, 18), "71": (9, 22), "72": (6, 23), "81": (8, 18), "92": (8, 17),
}
#: Fixed value: weight of an hour outside its sector's usual hours.
CLOSED = 1e-3


def unwrap(text: Column, levels: int = 2) -> Column:
    """JSON that may have been encoded as a JSON string ``levels - 1`` times more."""
    for _ in range(levels - 1):
        inner = F.try_element_at(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(1))
        text = F.when(F.trim(text).startswith('"'), inner).otherwise(text)
    return text


def raw_map(text: Column, levels: int = 2, requote: bool = False) -> Column:
    """A JSON object as ``map<string,string>``; null if it is none. ``requote``: an object
    in single quotes counts too."""
    text = unwrap(F.trim(text), levels)
    parsed = F.from_json(text, "map<string,string>")
    if requote:
        parsed = F.coalesce(parsed, F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "map<string,string>"))
    return parsed


def flow_entries(text: Column, levels: int = 2, requote: bool = False) -> Column:
    """``array<struct<area, weight>>`` of a map of visitors by area: ids are normalised,
    entries with another key or without a positive number are dropped."""
    entries = F.transform(F.map_entries(raw_map(text, levels, requote)), lambda e: F.struct(area_id(e["key"]).alias("area"), e["value"].try_cast("double").alias("weight")))
    return F.coalesce(F.filter(entries, lambda e: e["area"].isNotNull() & (e["weight"] > 0)), F.array().cast("array<struct<area:string,weight:double>>"))


def home_map(text: Column) -> Column:
    """Visitors by home area: keys padded to 12 characters, values of any sign."""
    entries = F.transform(F.map_entries(raw_map(text)), lambda e: F.struct(F.lpad(F.trim(e["key"]), 12, "0").alias("area"), e["value"].try_cast("double").alias("weight")))
    return F.filter(entries, lambda e: e["weight"].isNotNull())


def hours(text: Column) -> Column:
    """24 integers; anything that is not a list of 24 gives zeros, a null or odd element 0."""
    values = F.from_json(unwrap(F.trim(text)), "array<string>")
    zeros = F.array_repeat(F.lit(0).cast("bigint"), 24)
    return F.coalesce(F.when(F.size(values) == 24, F.transform(values, lambda x: F.coalesce(x.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint")))), zeros)


def weekdays(text: Column) -> Column:
    """Counts of the seven weekdays from Monday; other keys are dropped, missing days are 0."""
    parsed = raw_map(text, requote=True)
    return F.array(*(F.coalesce(F.try_element_at(parsed, F.lit(d)).try_cast("double"), F.lit(0.0)) for d in WEEKDAYS))


def clock(text: Column) -> Column:
    """``17:30`` as 17.5; null if it is no clock time."""
    part = F.regexp_extract(F.trim(text), r"^(\d+)(?::(\d+))?$", 1), F.regexp_extract(F.trim(text), r"^(\d+)(?::(\d+))?$", 2)
    return F.when(part[0] != "", part[0].try_cast("double") + F.coalesce(F.nullif(part[1], F.lit("")).try_cast("double"), F.lit(0.0)) / 60)


def open_hours(text: Column, weekday: str) -> Column:
    """The open hours of a weekday as sorted integers; null if none is given. An interval
    that ends before it begins wraps within the same weekday; one of equal ends is all day."""
    parsed = F.from_json(unwrap(F.trim(text)), "map<string,array<array<string>>>")
    given = F.flatten(F.transform(F.filter(F.map_entries(parsed), lambda e: F.initcap(F.substring(e["key"], 1, 3)) == weekday[:3]), lambda e: e["value"]))

    def within(span: Column, h: Column) -> Column:
        o, c = clock(span[0]), clock(span[1])
        plain = (o < h + 1) & (c > h)
        return F.when((F.size(span) == 2) & o.isNotNull() & c.isNotNull(), F.when(c == o, F.lit(True)).when(c > o, plain).otherwise((o < h + 1) | (c > h))).otherwise(F.lit(False))

    found = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.exists(given, lambda span: within(span, h)))
    return F.when(F.size(found) > 0, found)


def sector_gate(naics: Column) -> Column:
    """24 weights by the sector's usual hours; all 1 if the sector is unknown."""
    sector = F.substring(F.trim(naics.cast("string")), 1, 2)
    gate = F.array_repeat(F.lit(1.0), 24)
    for code, (a, b) in sorted(SECTOR_HOURS.items()):
        gate = F.when(sector == code, F.array(*(F.lit(1.0 if a <= h < b else CLOSED) for h in range(24)))).otherwise(gate)
    return gate


def open_gate(text: Column, naics: Column, weekday: str) -> Column:
    """24 weights: 0 or 1 on a weekday with open hours, else the sector's."""
    own = open_hours(text, weekday)
    hard = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.when(F.array_contains(own, h), F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(own.isNotNull(), hard).otherwise(sector_gate(naics))
