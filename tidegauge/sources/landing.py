"""Sources: landing JSON, the lake, partition planning, small reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions.times import DAY


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    return [p for p in paths if exists(spark, p)]


def partitions(spark: SparkSession, root: str) -> list[str]:
    """The ``dt`` values under a root, sorted."""
    if not exists(spark, root):
        return []
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n[3:] for n in names if n.startswith("dt="))


def pending(landed: list[str], done: list[str], today: str) -> list[str]:
    """Landed dates that aren't converted, without the unfinished current day."""
    return sorted(set(landed) - set(done) - {today})


def delta_paths(root: str, today: int, days: int) -> list[str]:
    """Paths of the last ``days`` dates, newest first; today: an epoch day."""
    from datetime import date, timedelta

    return [f"{root}/dt={date(1970, 1, 1) + timedelta(today - k)}" for k in range(days)]


def landed_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Landing pages in the lake's shape. A value that doesn't parse becomes null, to be counted."""
    raw = spark.read.schema(schemas.REVIEW_LANDING).option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*").json(path)
    a, c = F.col, lambda name, kind: F.col(name).try_cast(kind)
    return raw.select(
        c("recommendationid", "bigint").alias("recommendationid"), "appid", c("author.steamid", "bigint").alias("steam_id"), a("review").alias("review_text"), a("language").alias("language_code"),
        a("timestamp_created").alias("created_ts"), a("timestamp_updated").alias("updated_ts"), "voted_up", c("votes_up", "int").alias("votes_up"), c("votes_funny", "int").alias("votes_funny"), c("weighted_vote_score", "double").alias("weighted_vote_score"),
        "comment_count", "steam_purchase", "received_for_free", "refunded", "written_during_early_access", "primarily_steam_deck",
        *(a(f"author.{x}").alias(x) for x in ("playtime_at_review", "playtime_forever", "playtime_last_two_weeks", "num_games_owned", "num_reviews", "last_played")), "collected_ts",
    ).select(*schemas.columns(schemas.REVIEW))


def landed_notices(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.NOTICE_LANDING).option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*").json(path)
    return raw.withColumn("tags", F.array_join("tags", ",")).withColumnRenamed("date", "published_ts").select(*schemas.columns(schemas.NOTICE))


def lake(spark: SparkSession, base: str, delta: str, schema: str = schemas.REVIEW) -> DataFrame:
    """Base and delta of a lake, whichever exist; an empty typed table if neither does."""
    from tidegauge.sources.sinks import recover

    recover(spark, base)
    found = existing(spark, [base, delta])
    if not found:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(p).select(*schemas.columns(schema)) for p in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def notices(spark: SparkSession, path: str) -> DataFrame:
    """The notice lake; its two judgement columns are there wholly or not at all."""
    seen = spark.read.option("mergeSchema", "true").parquet(path)
    have = [c for c in schemas.JUDGED if c in seen.columns]
    if len(have) == 1:
        raise ValueError(f"only {have[0]} of {schemas.JUDGED} is in {path}")
    if have and not seen.filter(F.col("is_patch").isNull()).isEmpty():
        raise ValueError(f"rows without a judgement in {path}")
    return seen.select(*schemas.columns(schemas.NOTICE), *have)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """A directory that its writer has completed; raises if the mark is missing."""
    if not exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"{path}/_SUCCESS")
    return spark.read.parquet(path)


def window(df: DataFrame, today: int, days: int, columns: list[str]) -> DataFrame:
    """Rows of the last ``days`` Seoul days, pruned and pushed down to the scan; today: an epoch day."""
    cutoff = (today - days + 1) * DAY - 9 * 3600
    return df.select(*columns).filter(F.col("updated_ts") >= F.lit(cutoff))


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows whose title and body are base64."""
    raw = spark.read.schema("name string, title string, body string, tags string").option("sep", "\t").csv(path)
    return raw.select("name", *(F.unbase64(c).cast("string").alias(c) for c in ("title", "body")), "tags")


def catalog(raw: DataFrame) -> DataFrame:
    """Catalog entries: nameless ones go, developers are joined, blanks become null."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select("appid", blank(F.col("name")).alias("title"), blank(F.concat_ws(", ", F.transform("developers", lambda d: F.trim(d)))).alias("developer"), "release_ts", "review_count").filter("title is not null")


def targets(games: DataFrame, everything: bool = False) -> DataFrame:
    """Games to collect: those with reviews, in order."""
    return (games if everything else games.filter("review_count > 0")).orderBy("appid")


def typed_scan(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """Columns of Parquet files in the wanted types, cast where theirs differ; a value that can't be cast is null."""
    raw = spark.read.parquet(path)
    have = dict(raw.dtypes)
    return raw.select(*(F.col(c) if have[c] == t else F.col(c).try_cast(t).alias(c) for c, t in types.items()))


def json_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of all shards below a path, with the ``shard`` of their directory."""
    return spark.read.schema(f"{schema}, shard int").json(path)


def converted(raw: DataFrame, key: list[str], numbers: list[str]) -> DataFrame:
    """One row per key, numbers as nullable integers: what isn't one is null."""
    return raw.select(*(F.col(c).try_cast("double").try_cast("int").alias(c) if c in numbers else F.col(c) for c in raw.columns)).dropDuplicates(key)
