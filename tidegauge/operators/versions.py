"""Versions of a row: exact repeats collapse, the latest of a key is chosen by a total order.

``row_number() = 1`` plans a group limit on both sides of the exchange, so a key with many
versions is pruned before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def exact_versions(reviews: DataFrame) -> DataFrame:
    """One row per (recommendationid, updated_ts): the one collected last."""
    return latest(reviews, ["recommendationid", "updated_ts"], [F.col("collected_ts").desc_nulls_last()])


def latest_reviews(reviews: DataFrame, key: tuple[str, ...] = ("appid", "recommendationid")) -> DataFrame:
    return latest(reviews, list(key), [F.col("updated_ts").desc_nulls_last(), F.col("collected_ts").desc_nulls_last()])


def latest_notices(notices: DataFrame) -> DataFrame:
    return latest(notices, ["gid"], [F.col("collected_ts").desc_nulls_last()])


def latest_chunks(chunks: DataFrame, tie: list[str]) -> DataFrame:
    return latest(chunks, ["gid", "seq"], [F.col("processed_at").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in tie)])


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def bucketed_versions(reviews: DataFrame, buckets: int) -> DataFrame:
    """:func:`exact_versions` with rows dealt to ``bucket``s of ids first: one read, one exchange, same rows.

    A bucket holds all versions of its ids, so each can be written and checked on its own
    (:func:`tidegauge.sources.sinks.compact`).
    """
    dealt = reviews.withColumn("bucket", bucket_of("recommendationid", buckets)).repartition(buckets, "bucket")
    return latest(dealt, ["bucket", "recommendationid", "updated_ts"], [F.col("collected_ts").desc_nulls_last()]).drop("bucket")


def upsert(target: DataFrame, new: DataFrame, key: list[str], order: list[Column], keep_from: Column | None = None) -> DataFrame:
    """Target and new rows with the latest of each key; ``keep_from``: what stays in the window."""
    both = latest(target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))), key, [*order, F.col("__new").desc()]).drop("__new")
    return both if keep_from is None else both.filter(keep_from)


def merge_columns(target: DataFrame, new: DataFrame, key: list[str], when_judged: dict[str, str]) -> DataFrame:
    """Insert or update by key; ``when_judged`` columns keep the old value where a judge column is null.

    when_judged: column -> the column whose null means "not judged".
    """
    old = target.select(*key, *(F.col(c).alias(f"__old_{c}") for c in target.columns if c not in key), F.lit(True).alias("__was"))
    joined = old.join(new.withColumn("__is", F.lit(True)), key, "full")
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.col(c))
        elif c in when_judged:
            out.append(F.when(F.col(when_judged[c]).isNotNull(), F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c))
        else:
            out.append(F.when(F.col("__is"), F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c))
    return joined.select(*out)


def insert_missing(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the target lacks, one per key, after the target's own."""
    fresh = new.join(target.select(*key), key, "left_anti").dropDuplicates(key)
    return target.unionByName(fresh.select(*target.columns))


def replace_keys(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Delete the target's rows of every key that ``new`` has, then add ``new``."""
    return target.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*target.columns))


def changed(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from the old row of their key (nulls equal each other)."""
    prior = old.select(*key, *(F.col(c).alias(f"__old_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__old_{c}"))
    return new.join(prior, key).filter(~same).select(*new.columns)


def patch_columns(target: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Target with ``columns`` taken from ``new`` where the key matches."""
    fresh = new.select(*key, *(F.col(c).alias(f"__new_{c}") for c in columns), F.lit(True).alias("__hit"))
    return target.join(fresh, key, "left").select(*(F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))
