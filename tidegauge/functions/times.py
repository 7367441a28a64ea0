"""Calendar expressions. A day is the Asia/Seoul day (UTC+9, no daylight saving) of epoch seconds.

All are plain arithmetic, so they neither depend on the session's time zone nor leave
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KST_OFFSET, DAY = 9 * 3600, 86_400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_day(ts: Column | str) -> Column:
    """Days since 1970-01-01 of the Seoul calendar day."""
    return F.floor((col(ts) + KST_OFFSET) / F.lit(DAY)).cast("int")


def kst_date(ts: Column | str) -> Column:
    return F.date_from_unix_date(epoch_day(ts))


def day_start(date: Column | str) -> Column:
    """Epoch second at which a Seoul day begins."""
    return F.unix_date(col(date)).cast("bigint") * DAY - KST_OFFSET


def day_end(date: Column | str) -> Column:
    """Epoch second at which the next Seoul day begins."""
    return day_start(date) + DAY


def kst_year(ts: Column | str) -> Column:
    return F.year(kst_date(ts))


def partition_of(ts: Column | str) -> Column:
    """``yyyy-MM-dd`` of the landing partition."""
    return kst_date(ts).cast("string")


def hour_bucket(ts: Column | str) -> Column:
    """``HH`` of the landing partition."""
    return F.lpad(F.floor(F.pmod(col(ts) + KST_OFFSET, F.lit(DAY)) / 3600).cast("string"), 2, "0")


def ntz_seconds(ts: Column | str) -> Column:
    """Epoch seconds of a zone-less timestamp that holds UTC."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col(ts))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact days, with fractions, between two epoch seconds."""
    return (col(later) - col(earlier)) / F.lit(float(DAY))


def day_count(first: Column | str, last: Column | str) -> Column:
    """Days of a closed period."""
    return F.date_diff(col(last), col(first)) + 1


MAX_PERIOD_DAYS = 400


def checked_period(first, last, most: int = MAX_PERIOD_DAYS) -> int:
    """Days of a closed period of two dates; raises where it is empty or too long to answer."""
    days = (last - first).days + 1
    if not 1 <= days <= most:
        raise ValueError(f"{days} days: a period has 1 to {most}")
    return days
