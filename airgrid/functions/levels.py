"""Threshold tables and the level columns derived from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: expected unit and valid range per product
PRODUCT_RULES = {
    "no2": {"units": "mol m-2", "low": 0.0, "high": 100.0},
    "so2": {"units": "mol m-2", "low": 0.0, "high": 50.0},
    "co": {"units": "mol m-2", "low": 0.0, "high": 0.1},
    "o3": {"units": "mol m-2", "low": 0.0, "high": 0.5},
    "aod": {"units": "dimensionless", "low": 0.0, "high": 5.0},
}
# fixed values: bands of the summary table
QUALITY_BANDS = {
    "no2": {"good": 20.0, "moderate": 40.0, "poor": 60.0},
    "so2": {"good": 10.0, "moderate": 20.0, "poor": 30.0},
    "co": {"good": 0.05, "moderate": 0.1, "poor": 0.2},
}
# fixed values: monitoring thresholds
ALERT_THRESHOLDS = {
    "no2": {"moderate": 20.0, "warning": 40.0, "critical": 60.0},
    "so2": {"moderate": 10.0, "warning": 20.0, "critical": 30.0},
    "aod": {"moderate": 0.5, "warning": 1.0},
}
# fixed values: map colours by upper bound
VALUE_COLOURS = {0.2: "green", 0.4: "yellow", 0.6: "orange", 0.8: "red"}
TOP_COLOUR = "darkred"
# fixed values: ground resolution by product prefix
RESOLUTIONS = {"MOD04": "10km", "MYD04": "10km", "MOD08": "1degree", "MOD13": "250m"}
# fixed values: ranges by which a variable's values count as reasonable, in order of the name match
REASONABLE_RANGES = {"no2": (0.0, 100.0), "so2": (0.0, 50.0), "co": (0.0, 0.1), "aod": (0.0, 5.0)}


def lookup(name: Column, table: Mapping[str, Mapping[str, float | str]], field: str) -> Column:
    """``table[name][field]`` as a CASE expression; null where either is missing."""
    out = None
    for key, row in table.items():
        if field in row:
            out = (F if out is None else out).when(name == key, F.lit(row[field]))
    return out if out is not None else F.lit(None)


def value_bucket(v: Column) -> Column:
    out = F.when(v.isNull(), None)
    for bound, colour in VALUE_COLOURS.items():
        out = out.when(v < bound, colour)
    return out.otherwise(TOP_COLOUR)


def alert_level(variable: Column, v: Column, thresholds: Mapping = ALERT_THRESHOLDS) -> Column:
    """critical / warning / moderate / good; null for pollutants without thresholds."""
    infinite = F.lit(float("inf"))
    out = F.when(~variable.isin(*thresholds) | v.isNull(), None)
    for level in ("critical", "warning", "moderate"):
        out = out.when(v >= F.coalesce(lookup(variable, thresholds, level), infinite), level)
    return out.otherwise("good")


def tripped_threshold(variable: Column, level: Column, thresholds: Mapping = ALERT_THRESHOLDS) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name in ("critical", "warning", "moderate"):
        out = out.when(level == name, lookup(variable, thresholds, name))
    return out


def quality_band(variable: Column, v: Column, bands: Mapping = QUALITY_BANDS) -> Column:
    good, moderate = lookup(variable, bands, "good"), lookup(variable, bands, "moderate")
    return (
        F.when(v.isNull(), None).when(good.isNull() | (v < good), "good").when(v < moderate, "moderate").otherwise("poor")
    )


def product_resolution(product: Column) -> Column:
    out = F.when(product.isNull(), "unknown")
    for prefix, resolution in RESOLUTIONS.items():
        out = out.when(product.contains(prefix), resolution)
    return out.otherwise("unknown")


def product_units(product: Column) -> Column:
    return F.coalesce(lookup(F.lower(product), PRODUCT_RULES, "units"), F.lit("unknown"))


def assess_range(variable: Column, low: Column, high: Column, mean: Column) -> Column:
    """Judge a variable's value range by its name, else by its spread."""
    generic = F.when(low == high, "constant").when(high - low > mean * 10, "wide_range").otherwise("unknown")
    out = F.when(low.isNull(), "no_data")
    for name, (lo, hi) in REASONABLE_RANGES.items():
        fits = (low >= lo) & (high <= hi)
        out = out.when(F.lower(variable).contains(name), F.when(fits, "reasonable").otherwise(generic))
    return out.otherwise(generic)
