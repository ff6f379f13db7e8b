"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Whole cents of an amount, rounded: doubles of raw files lie a little beside their cents."""
    return F.round(amount * 100).cast("long")


def money(whole_cents: Column) -> Column:
    return whole_cents.cast("double") / 100


def half_up(over: Column, under: Column, digits: int) -> Column:
    """over / under rounded half away from zero, by whole numbers only; null where ``under`` is 0 or null."""
    scale, wide = 10**digits, "decimal(38,0)"
    over, under = over.cast(wide), F.nullif(under, F.lit(0)).cast(wide)
    size = F.call_function("div", F.abs(over) * (2 * scale) + under, under * 2)
    return F.signum(over.cast("double")) * size.cast("double") / scale


def percent(over: Column, under: Column, digits: int = 2) -> Column:
    return half_up(over * 100, under, digits)


def months_between_whole(later: Column, earlier: Column) -> Column:
    """Whole months by calendar day: 31 January to 29 February is none."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier) - (F.day(later) < F.day(earlier)).cast("int")


def month_of(moment: Column) -> Column:
    return F.trunc(moment, "month")


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def padded_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 8, "0"))


def bucket(salt: str, key: Column) -> Column:
    """0..9999 from a hash of the key: the same row falls into the same bucket in any order and on any cluster."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key, F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") % 10000
