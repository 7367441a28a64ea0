"""Incremental ingest with Structured Streaming: landing files to the lake, and live counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.versions import exact_versions, upsert
from tidegauge.sources.sinks import read_table, write_buckets


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_counts(reviews: DataFrame, late: str = "2 days") -> DataFrame:
    """Versions per game and Seoul day, emitted once the watermark has passed the day.

    Exact re-collections within the watermark are dropped first.
    """
    timed = reviews.withColumn("at", F.timestamp_seconds("updated_ts")).withWatermark("at", late)
    once = timed.dropDuplicatesWithinWatermark(["recommendationid", "updated_ts"])
    return once.groupBy("appid", F.window("at", "1 day", startTime="15 hours")).agg(F.count("*").alias("versions"), F.count_if(F.col("voted_up")).alias("positives")).select("appid", F.col("window.start").alias("day_start"), "versions", "positives")


def upsert_batches(target: str, key: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch: merge each batch's latest versions into a versioned table; replays change nothing.

    The table is dealt to buckets by a hash of the key: a batch reads and rewrites the buckets
    that it touches, and the pointer moves once they are written.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        order = [F.desc("updated_ts"), F.desc("collected_ts")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        new = exact_versions(batch).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` rows
            if touched:
                old = read_table(spark, target, schema, touched)
                merged = upsert(old, new.drop("bucket"), key, order).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
                write_buckets(merged.repartition("bucket"), target, touched, buckets)
        finally:
            new.unpersist()

    return merge


def run_available(df: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what has landed, then stop; the checkpoint makes a restart resume."""
    query = df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def watermark(runs: DataFrame, slack: int) -> int | None:
    """Start of the last completed run less a slack; None: collect everything."""
    row = runs.filter("status = 'COMPLETED'").agg(F.max("started_ts").alias("at")).first()
    return None if row["at"] is None else row["at"] - slack


def until_known(pages: DataFrame, since: int | None) -> DataFrame:
    """Rows of collected pages down to, and with, the first page that reaches known versions."""
    if since is None:
        return pages
    oldest = pages.groupBy("appid", "page").agg(F.min("updated_ts").alias("oldest"))
    stop = oldest.filter(F.col("oldest") < since).groupBy("appid").agg(F.min("page").alias("last_page"))
    return pages.join(stop, "appid", "left").filter("last_page is null or page <= last_page").drop("last_page")


def not_done(work: DataFrame, done: DataFrame, key: tuple[str, ...] = ("key", "model", "input_hash")) -> DataFrame:
    return work.join(done.select(*key).distinct(), list(key), "left_anti")
