"""Rates, shares and buckets. A rate without a denominator is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Unrounded percentage; null for an empty whole."""
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def percent2(part: Column, whole: Column) -> Column:
    """Two decimals, half up."""
    return F.round(percent(part, whole), 2)


def percent1(part: Column, whole: Column) -> Column:
    """One decimal, half up."""
    return F.round(percent(part, whole), 1)


def outcome(delta: Column, margin: float = 3.0) -> Column:
    """improved / worsened / steady by percentage points; the margin itself still counts as steady."""
    return F.when(delta.isNull(), F.lit(None)).when(delta > margin, "improved").when(delta < -margin, "worsened").otherwise("steady")


def similarity_score(cosine: Column) -> Column:
    """0..100 with one decimal, of a clamped cosine."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)) * 1000) / 10


def nearest_rank(total: Column, share: float) -> Column:
    """The rank that holds a quantile: ceil(total * share), in double arithmetic."""
    return F.ceil(total.cast("double") * F.lit(share)).cast("bigint")


def follow_up(next_gap: Column, mean_gap: Column) -> Column:
    return F.when(mean_gap > 0, next_gap / mean_gap)


def min_max(value: Column, over) -> Column:
    """A value scaled into 0..1 among its window; 0 where all are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def single_or_mixed(values: Column) -> Column:
    """The one distinct value of an array, else 'mixed'; null if it is empty."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).when(F.size(distinct) > 1, F.lit("mixed"))


def percent_decimal(part: Column, whole: Column) -> Column:
    """A percentage as DECIMAL(5,2), half up; null for an empty whole."""
    return F.round(percent(part, whole), 2).cast("decimal(5,2)")
