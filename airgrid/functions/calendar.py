"""Calendar column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(t: Column) -> Column:
    """Seconds since the epoch as a double (timestamps without zone count as UTC)."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def season_label(t: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    names = F.array(*[F.lit(s) for s in ("DJF", "MAM", "JJA", "SON")])
    return F.get(names, season_index(t))


def season_index(t: Column) -> Column:
    """0 for December to February, then one per quarter of the year that follows."""
    return F.floor((F.month(t) % 12) / 3).cast("int")


def season_number(t: Column) -> Column:
    return season_index(t) + 1


def temporal_columns(t: Column) -> dict[str, Column]:
    """Calendar features of a timestamp."""
    doy, month, dow = F.dayofyear(t), F.month(t), F.weekday(t)

    def wave(fn, c, period):
        return fn(2 * math.pi * c / period)

    return {
        "day_of_year": doy,
        "month": month,
        "day_of_week": dow,
        "quarter": F.quarter(t),
        "season": season_index(t),
        "day_of_year_sin": wave(F.sin, doy, 365),
        "day_of_year_cos": wave(F.cos, doy, 365),
        "month_sin": wave(F.sin, month, 12),
        "month_cos": wave(F.cos, month, 12),
        "is_weekend": (dow >= 5).cast("int"),
    }


def week_end(t: Column) -> Column:
    """Sunday that closes the Monday-to-Sunday week."""
    return F.date_add(F.date_trunc("week", t).cast("date"), 6)


def month_end(t: Column) -> Column:
    return F.last_day(t)
