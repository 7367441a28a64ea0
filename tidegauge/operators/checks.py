"""Validity predicates, conflict detection, reports and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECT_SHARE = 0.005


class DataConflict(ValueError):
    """Equal keys and times with different contents."""


def assert_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The typed columns only; raises on a missing or differently typed one, casts nothing."""
    have = dict(df.dtypes)
    wrong = {c: (have.get(c), t) for c, t in types.items() if have.get(c) != t}
    if wrong:
        raise TypeError(f"columns (found, wanted): {wrong}")
    return df.select(*types)


def invalid_review() -> Column:
    """A review version that can't be counted."""
    c = F.col
    some_null = c("appid").isNull() | c("recommendationid").isNull() | c("created_ts").isNull() | c("updated_ts").isNull() | c("collected_ts").isNull() | c("voted_up").isNull()
    return some_null | (c("appid") <= 0) | (c("recommendationid") <= 0) | (c("created_ts") < 0) | (c("updated_ts") < c("created_ts")) | (c("collected_ts") < c("updated_ts"))


def invalid_language(code: Column, most: int = 20) -> Column:
    """Null, blank, untrimmed or too long."""
    return code.isNull() | (F.length(F.trim(code)) == 0) | (F.length(code) > most) | (F.trim(code) != code)


def invalid_chunk(dim: int) -> Column:
    c = F.col
    return c("gid").isNull() | c("seq").isNull() | c("text").isNull() | (F.trim(c("text")) == "") | (c("embedding").isNotNull() & (F.size("embedding") != dim))


def invalid_topic() -> Column:
    c = F.col
    return F.coalesce((c("appid") <= 0) | (c("recommendationid") <= 0) | (c("topic_id") <= 0), F.lit(True)) | c("updated_ts").isNull()


def invalid_recent() -> Column:
    c = F.col
    return F.coalesce((c("recommendationid") <= 0) | (c("appid") <= 0) | (c("updated_ts") < c("created_ts")), F.lit(True)) | c("voted_up").isNull() | invalid_language(c("language_code"))


def developer_notice(feed: Column, excluded: str) -> Column:
    """Notices without a feed, or of the excluded one, aren't the developer's."""
    return feed.isNotNull() & (feed != excluded)


def blank(text: Column) -> Column:
    """Only white space, of any script."""
    return text.rlike(r"^[\s\p{Z}\x1c-\x1f\x85]*$")


def conflicts(df: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """Keys with more than one distinct payload; null is a value of its own."""
    return df.groupBy(*key).agg(F.countDistinct(F.struct(*payload)).alias("variants")).filter("variants > 1")


def conflicts_of_latest(df: DataFrame, repeat: list[str], key: list[str], payload: list[str]) -> DataFrame:
    """:func:`conflicts` after exact repeats (equal in ``repeat`` and payload) have collapsed, with the rows left."""
    once = df.dropDuplicates([*repeat, *payload])
    return once.groupBy(*key).agg(F.countDistinct(F.struct(*payload)).alias("variants"), F.count("*").alias("n_rows")).filter("variants > 1")


def unknown_codes(rows: DataFrame, codes: DataFrame, column: str, code: str) -> DataFrame:
    """Values of a column that a code list lacks, and how often: none must be left before rows are loaded."""
    listed = codes.select(F.col(code).alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(listed, column, "left_anti").groupBy(column).agg(F.count("*").alias("n_rows"))


def assert_no_conflicts(df: DataFrame, key: list[str], payload: list[str]) -> None:
    found = conflicts(df, key, payload)
    if not found.isEmpty():
        raise DataConflict(f"different {payload} for equal {key}: {found.limit(3).collect()}")


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass: rows and nulls of each column, a row per column."""
    counted = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counted.select("n_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns))).alias("x")).select("x.column_name", "x.n_null", "n_rows")


def reason_report(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """One pass: rows that each reason rejects."""
    counted = df.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in reasons.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("reason"), F.col(k).alias("n_rows")) for k in reasons))).alias("x")).select("x.*")


def reject_guard(df: DataFrame, invalid: Column, most: float = REJECT_SHARE) -> DataFrame:
    """Valid rows; raises if the invalid ones are more than a share ``most``."""
    bad = F.coalesce(invalid, F.lit(True))
    seen = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if seen["n"] and seen["bad"] / seen["n"] > most:
        raise ValueError(f"{seen['bad']} of {seen['n']} rows are invalid")
    return df.filter(~bad)


def assert_counts(written: int, stored: int) -> None:
    if written != stored:
        raise ValueError(f"wrote {written} rows, found {stored}")
