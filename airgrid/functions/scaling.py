"""Value transforms that depend on statistics of the whole variable."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import attach


def with_range(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", join: Callable = attach) -> DataFrame:
    """Adds ``_min`` and ``_max`` of the whole variable; ``core.same_keys`` joins many small groups."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    return join(df, span, keys)


def gamma_correct(df: DataFrame, gamma: float = 1.2, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    lo, span, v = F.col("_min"), F.col("_max") - F.col("_min"), F.col(value)
    curved = F.pow((v - lo) / span, F.lit(1.0 / gamma)) * span + lo
    return with_range(df, keys, value).withColumn(value, F.when(span > 0, curved).otherwise(v)).drop("_min", "_max")


def to_8bit(v: Column, lo: Column, hi: Column) -> Column:
    """Truncating scale to 0..255; null for a constant variable."""
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * 255).cast("int"))


def from_8bit(v8: Column, lo: Column, hi: Column) -> Column:
    return v8 / 255.0 * (hi - lo) + lo


def normalise_8bit(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Adds ``value_8bit`` and ``scaled_back``, the value that the 8-bit level stands for."""
    lo, hi = F.col("_min"), F.col("_max")
    return (
        with_range(df, keys, value)
        .withColumn("value_8bit", to_8bit(F.col(value), lo, hi))
        .withColumn("scaled_back", F.coalesce(from_8bit(F.col("value_8bit"), lo, hi), F.col(value)))
        .drop("_min", "_max")
    )


def adjusted_skew(column: str) -> Column:
    """Sample-adjusted skewness from the population form."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1.0)) / (n - 2))


def log1p_if_skewed(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], split: str = "split"
) -> DataFrame:
    """log1p of a column in every split where its training rows are positive and skewed above 1."""
    train = df.where(F.col(split) == "train")
    flags = train.groupBy(*keys).agg(
        *[((adjusted_skew(c) > 1.0) & (F.min(c) > 0)).alias(f"_log_{c}") for c in columns]
    )
    out = attach(df, flags, keys, how="left")
    return out.withColumns({c: F.when(F.col(f"_log_{c}"), F.log1p(c)).otherwise(F.col(c)) for c in columns}).drop(
        *[f"_log_{c}" for c in columns]
    )


def cross_features(df: DataFrame, columns: Sequence[str], first: int = 3) -> DataFrame:
    """Product of each of the first columns with the column after it."""
    pairs = list(zip(columns, columns[1:], strict=False))[:first]
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})
