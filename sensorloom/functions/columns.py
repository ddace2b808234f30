"""Column expressions shared by the operators: casts, clocks, bands, and portable randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readings that devices report as words.
SENTINELS = {"low": 39.0, "high": 401.0}
#: Hours from UTC for a zone code; an unknown zone counts as pst.
ZONE_HOURS = {"pst": -8, "cst": -6}
DEFAULT_HOURS = -8
#: Unit factors.
INSULIN_UNITS, HOMA_UNITS = 28.70, 4.783


def numeric(value: Column) -> Column:
    """A number, or null where the text is none."""
    return value.try_cast("double")


def instant(value: Column) -> Column:
    """A timestamp from ISO-8601 text, or null."""
    return F.try_to_timestamp(value)


def reading_value(value: Column) -> Column:
    """A device's reading: words stand for the ends of its range, other text is parsed or null."""
    word = F.lower(F.trim(value))
    out = numeric(value)
    for name, number in SENTINELS.items():
        out = F.when(word == name, F.lit(number)).otherwise(out)
    return out


def local_hour(ts: Column, offset: Column) -> Column:
    """Hour of day on the local clock, by whole hours from UTC; a missing offset counts as the default."""
    return F.pmod(F.hour(ts) + F.coalesce(offset, F.lit(DEFAULT_HOURS)), F.lit(24))


def local_time(ts: Column, offset: Column) -> Column:
    return ts + F.make_dt_interval(hours=F.coalesce(offset, F.lit(DEFAULT_HOURS)))


def in_hours(hour: Column, first: int, last: int) -> Column:
    """first <= hour < last, around midnight where first > last."""
    return (hour >= first) & (hour < last) if first <= last else (hour >= first) | (hour < last)


# Fixed values in the next three: cut points of effect sizes, p values and HbA1c.
def effect_band(effect: Column) -> Column:
    return F.when(effect >= 0.14, "large").when(effect >= 0.06, "medium").when(effect >= 0.01, "small").otherwise("negligible")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def hba1c_band(value: Column) -> Column:
    return F.when(value < 5.7, "normal").when(value < 6.5, "prediabetes").when(value >= 6.5, "diabetes")


def treatment(group: Column) -> Column:
    """First rule that fits: oral, insulin, unmedicated, other."""
    low = F.lower(group)
    return F.when(low.startswith("oral"), "Oral").when(low.contains("insulin"), "Insulin").when(low.startswith("healthy") | low.startswith("pre"), "Unmed").otherwise("other")


def quicki(insulin: Column, glucose: Column) -> Column:
    return 1 / (F.log10(insulin) + F.log10(glucose))


def tyg(triglycerides: Column, glucose: Column) -> Column:
    return F.log(triglycerides * glucose / 2)


def portable_hash(key: Column, rep: Column | int = 0, seed: int = 0) -> Column:
    """0..1000002 from integers, by modular arithmetic that any SQL engine repeats."""
    rep = rep if isinstance(rep, Column) else F.lit(rep)
    x = (F.pmod(key.cast("bigint"), F.lit(1_000_003)) * 7_919 + rep.cast("bigint") * 104_729 + seed * 15_485_863 + 12_345) % 1_000_003
    x = (x * x + 31 * x + 17) % 1_000_003
    return (x * x + 97 * x + 5) % 1_000_003


def portable_hash_sql(key: str, rep: str = "0", seed: int = 0) -> str:
    """The same in SQL text."""
    x = f"((({key}) % 1000003) * 7919 + ({rep}) * 104729 + {seed * 15_485_863} + 12345) % 1000003"
    for a, b in ((31, 17), (97, 5)):
        x = f"((({x}) * ({x}) + {a} * ({x}) + {b}) % 1000003)"
    return x
