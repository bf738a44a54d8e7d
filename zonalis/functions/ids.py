"""Identifiers and plain text as Column expressions; garbage becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: State abbreviation of each two-digit FIPS code.
STATE_OF_FIPS = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT", "10": "DE", "11": "DC", "12": "FL", "13": "GA", "15": "HI",
    "16": "ID", "17": "IL", "18": "IN", "19": "IA", "20": "KS", "21": "KY", "22": "LA", "23": "ME", "24": "MD", "25": "MA", "26": "MI", "27": "MN",
    "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH", "34": "NJ", "35": "NM", "36": "NY", "37": "NC", "38": "ND", "39": "OH",
    "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD", "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA",
    "54": "WV", "55": "WI", "56": "WY", "60": "AS", "66": "GU", "69": "MP", "72": "PR", "78": "VI",
}


def area_id(raw: Column) -> Column:
    """A 12-digit area id from text or a number, float-formatted or with a lost leading zero."""
    s = F.trim(raw.cast("string"))
    number = s.rlike(r"^[0-9]+(\.[0-9]*)?([eE]\+?[0-9]+)?$")
    whole = F.when(number, F.floor(s.try_cast("double")).try_cast("decimal(20,0)").cast("string")).otherwise(s)
    return F.when(whole.rlike("^[0-9]{11}$"), F.concat(F.lit("0"), whole)).when(whole.rlike("^[0-9]{12}$"), whole)


def digits_id(raw: Column, width: int = 12) -> Column:
    """The digits of a text, zero-padded to ``width``; null if there are none or too many."""
    d = F.regexp_replace(F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", ""), "[^0-9]", "")
    return F.when((F.length(d) > 0) & (F.length(d) <= width), F.lpad(d, width, "0"))


def zip_code(raw: Column) -> Column:
    """Exactly five digits after all else is dropped, or null."""
    d = F.regexp_replace(raw.cast("string"), "[^0-9]", "")
    return F.when(F.length(d) == 5, d)


def state_fips(area: Column) -> Column:
    return F.substring(area, 1, 2)


def county_fips(area: Column) -> Column:
    return F.substring(area, 3, 3)


def state_abbr(area: Column) -> Column:
    """The state's abbreviation; null if its code is unknown."""
    pairs = [F.lit(x) for pair in sorted(STATE_OF_FIPS.items()) for x in pair]
    return F.try_element_at(F.create_map(*pairs), state_fips(area))


def ordered_distinct(values: Column) -> Column:
    """First occurrences in order, without nulls."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull()))


def clean(text: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def city_unit(city: Column, state: Column, zip_: Column) -> Column:
    """``city:ST:slug`` where the city is known, else ``zip:NNNNN``."""
    return F.when(clean(city).isNotNull(), F.concat(F.lit("city:"), F.upper(state), F.lit(":"), slug(city))).otherwise(F.concat(F.lit("zip:"), zip_))


def safe_int(raw: Column, default: int = 0) -> Column:
    return F.coalesce(raw.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(raw: Column) -> Column:
    """A double, or null for text that is none and for NaN."""
    x = raw.try_cast("double")
    return F.when(~F.isnan(x), x)


def is_blank(raw: Column) -> Column:
    """Null, or a text that stands for nothing."""
    return raw.isNull() | F.trim(raw.cast("string")).isin("", "[]", "{}", "nan", "None")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone, on any partitioning: the first
    32 bits of the MD5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(*parts: str) -> str:
    """The same number in DuckDB SQL, of SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
