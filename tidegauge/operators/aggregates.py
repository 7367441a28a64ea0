"""Reaction statistics over review versions.

``strict`` runs the checks (actions); without it the result is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.rates import nearest_rank, percent
from tidegauge.functions.times import DAY, day_start, kst_date
from tidegauge.operators import checks
from tidegauge.operators.versions import latest, latest_reviews

QUARTILES, OPEN_BAND = (0.25, 0.5, 0.75), 4


def n_if(cond: Column) -> Column:
    return F.count_if(cond)


def daily_stat(reviews: DataFrame, strict: bool = False) -> DataFrame:
    """Per game and day: counts of each review's last version of the day.

    A version is new on the day the review was first written, else edited.
    """
    if strict:
        if not reviews.filter(checks.invalid_review()).isEmpty():
            raise ValueError("invalid review rows")
        checks.assert_no_conflicts(reviews, ["recommendationid", "updated_ts", "collected_ts"], ["appid", "voted_up", "created_ts"])
    # The day's last version by (updated, collected) is also the last collected of its time.
    dated = reviews.withColumn("stat_date", kst_date("updated_ts")).withColumn("is_new", kst_date("created_ts") == kst_date("updated_ts"))
    last = latest(dated, ["appid", "recommendationid", "stat_date"], [F.desc("updated_ts"), F.desc("collected_ts")])
    up, new = F.col("voted_up"), F.col("is_new")
    return last.groupBy("appid", "stat_date").agg(
        F.count("*").alias("review_count"), n_if(~up).alias("negative_count"), n_if(new).alias("new_review_count"),
        n_if(new & up).alias("new_positive_count"), n_if(~new).alias("edited_review_count"), n_if(~new & up).alias("edited_positive_count"),
    )


def language_stat(reviews: DataFrame) -> DataFrame:
    """Per game and language of each review's latest version."""
    return latest_reviews(reviews).groupBy("appid", "language_code").agg(F.count("*").alias("review_count"), n_if(F.col("voted_up")).alias("positive_count"))


def band_quality(reviews: DataFrame) -> DataFrame:
    """Latest reviews by whether their playtime can be used."""
    p = F.col("playtime")
    return latest_reviews(reviews).agg(F.count("*").alias("latest_count"), n_if(p.isNull()).alias("missing_count"), n_if(p < 0).alias("negative_count"), n_if(p >= 0).alias("included_count"))


def band_bounds(reviews: DataFrame) -> DataFrame:
    """Nearest-rank quartiles of playtime per game, as four half-open bands (the last open).

    The histogram comes first, so the running sums sort distinct playtimes, not reviews.
    """
    hist = latest_reviews(reviews).filter("playtime >= 0").groupBy("appid", "playtime").agg(F.count("*").alias("n"))
    w = Window.partitionBy("appid")
    run = hist.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("playtime").rowsBetween(Window.unboundedPreceding, 0)))
    q = [F.min(F.when(F.col("upto") >= nearest_rank(F.col("total"), s), F.col("playtime"))).alias(f"q{k}") for k, s in enumerate(QUARTILES, 1)]
    bounds = run.groupBy("appid").agg(*q)
    low, high = (F.lit(0), F.col("q1"), F.col("q2"), F.col("q3")), (F.col("q1"), F.col("q2"), F.col("q3"), F.lit(None).cast("int"))
    bands = F.array(*(F.struct(F.lit(k + 1).cast("int").alias("band_no"), low[k].cast("int").alias("playtime_from"), high[k].cast("int").alias("playtime_to")) for k in range(4)))
    return bounds.select("appid", F.explode(bands).alias("b")).select("appid", "b.*")


def in_band(playtime: Column) -> Column:
    return (playtime >= F.col("playtime_from")) & (F.col("playtime_to").isNull() | (playtime < F.col("playtime_to")))


def assign_band(reviews: DataFrame, bands: DataFrame) -> DataFrame:
    """Reviews with their band_no; null where no band holds them."""
    b = bands.select(F.col("appid").alias("band_appid"), "band_no", "playtime_from", "playtime_to")
    return reviews.join(b, (F.col("appid") == F.col("band_appid")) & in_band(F.col("playtime")), "left").select(*reviews.columns, "band_no")


def misplaced(reviews: DataFrame, bands: DataFrame) -> DataFrame:
    """Reviews with a playtime that aren't in exactly one band, and in how many they are."""
    b = bands.select(F.col("appid").alias("band_appid"), "playtime_from", "playtime_to")
    inside = (F.col("appid") == F.col("band_appid")) & in_band(F.col("playtime"))
    hits = reviews.filter("playtime >= 0").join(b, inside, "left")
    return hits.groupBy("appid", "recommendationid").agg(F.count("band_appid").alias("n_bands")).filter("n_bands <> 1")


def band_stat(reviews: DataFrame) -> DataFrame:
    """Four rows per game, empty bands included."""
    bounds = band_bounds(reviews)
    counted = assign_band(latest_reviews(reviews).filter("playtime >= 0"), bounds).groupBy("appid", "band_no").agg(F.count("*").alias("review_count"), n_if(F.col("voted_up")).alias("positive_count"))
    return bounds.join(counted, ["appid", "band_no"], "left").fillna(0, ["review_count", "positive_count"])


def band_topic_stat(reviews: DataFrame, topics: DataFrame, bands: DataFrame) -> DataFrame:
    """Positive and negative mentions per game, band and topic; topics match the exact version."""
    placed = assign_band(latest_reviews(reviews).filter("playtime >= 0"), bands).select("appid", "recommendationid", "updated_ts", "voted_up", "band_no")
    hits = topics.select("appid", "recommendationid", "updated_ts", "topic_id").distinct()
    return placed.join(hits, ["appid", "recommendationid", "updated_ts"]).groupBy("appid", "band_no", "topic_id").agg(n_if(F.col("voted_up")).alias("positive_count"), n_if(~F.col("voted_up")).alias("negative_count"))


def window_counts(reviews: DataFrame, days: int = 7) -> DataFrame:
    """appid, end_day, count, positive: of each window of ``days`` days that ends before a day,
    the reviews whose latest version inside the window is on one of its days.

    A day's last version of a review counts in the windows that end after it, up to the review's
    next day and ``days`` days on: a few rows a version, whatever the number of patches, and no
    range join. Windows without reviews have no row.
    """
    dated = reviews.withColumn("day", kst_date("updated_ts"))
    last = latest(dated, ["appid", "recommendationid", "day"], [F.desc("updated_ts"), F.desc("collected_ts")])
    then = F.lead("day").over(Window.partitionBy("appid", "recommendationid").orderBy("day"))
    upto = F.least(F.coalesce(then, F.date_add("day", days)), F.date_add("day", days))
    ends = last.withColumn("upto", upto).select("appid", "voted_up", F.explode(F.sequence(F.date_add("day", 1), F.col("upto"))).alias("end_day"))
    return ends.groupBy("appid", "end_day").agg(F.count("*").alias("count"), n_if(F.col("voted_up")).alias("positive"))


def patch_stat(reviews: DataFrame, patches: DataFrame, coverage_start: int, coverage_end: int, run_at: int, days: int = 7) -> DataFrame:
    """Counts and rates of the ``days`` days before and after each patch's day.

    A patch whose windows aren't fully covered, or not yet over, has no row. The latest
    version inside a window counts, of what was collected by the time of the run. Reviews of
    games without a patch are dropped first; windows are counted once per game and day and
    then looked up, before by the patch's day and after by the day ``days`` on.
    """
    start, span = day_start(kst_date("published_ts")), F.lit(days * DAY)
    windows = (
        patches.filter("published_ts is not null").select("gid", "appid", kst_date("published_ts").alias("day"), start.alias("day0"))
        .filter((F.col("day0") - span >= coverage_start) & (F.col("day0") + span <= F.lit(min(coverage_end, run_at))))
    )
    seen = reviews.filter(F.col("collected_ts") <= run_at).join(windows.select("appid").distinct(), "appid", "left_semi")
    counts = window_counts(seen, days)
    of = lambda name: counts.select("appid", F.col("end_day").alias(f"{name}_end"), F.col("count").alias(f"{name}_count"), F.col("positive").alias(f"{name}_positive"))
    out = windows.withColumn("before_end", F.col("day")).withColumn("after_end", F.date_add("day", days)).join(of("before"), ["appid", "before_end"], "left").join(of("after"), ["appid", "after_end"], "left")
    out = out.fillna(0, ["before_count", "before_positive", "after_count", "after_positive"])
    before, after = percent(F.col("before_positive"), F.col("before_count")), percent(F.col("after_positive"), F.col("after_count"))
    return out.select(
        "gid", "appid", "before_count", "before_positive", "after_count", "after_positive",
        F.round(before, 2).alias("before_pct"), F.round(after, 2).alias("after_pct"), F.round(after - before, 2).alias("delta_pct"),
        (F.round(after, 2) - F.round(before, 2)).alias("delta_pp"),
    )


def value_counts(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """column_name, value, n per value of ``by``, and over all where ``by`` is null.

    ``by`` must not be null itself. One pass: rows become a few (column, value) pairs, counted
    before they are shuffled.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns)))
    counted = rows.select(by, pairs.alias("x")).groupBy(by, "x.column_name", "x.value").agg(F.count("*").alias("n"))
    whole = counted.groupBy("column_name", "value").agg(F.sum("n").alias("n")).withColumn(by, F.lit(None).cast(rows.schema[by].dataType))
    return counted.unionByName(whole)
