"""Facts of a day series, and what follows a patch.

days: one row per (appid, stat_date) with reviews and positives. Moving ratios run over
rows, so a series with missing days should be gap-filled first. What follows a patch is read
from its game's series as one array, sorted by day: its length is bounded by the calendar
(some 120 KB for twenty years), so there is no range join and no row per patch and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators.versions import latest

LOW_DAY_REVIEWS, RECOVERED, SURGE_DAY, SURGE_MEAN, ROWS = 10, 0.9, 1.5, 1.2, 7


def facts(days: DataFrame) -> DataFrame:
    """Totals, first against last third, busiest day and worst day with enough reviews."""
    w = Window.partitionBy("appid")
    numbered = days.withColumn("rn", F.row_number().over(w.orderBy("stat_date"))).withColumn("n", F.count("*").over(w))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    head, tail = F.col("rn") <= third, F.col("rn") > F.col("n") - third
    s = lambda c, cond=None: F.sum(F.when(cond, F.col(c)).otherwise(0) if cond is not None else F.col(c))
    ratio = lambda p, r: F.when(r > 0, p / r)
    out = numbered.groupBy("appid").agg(
        F.count("*").alias("n_days"), s("reviews").alias("reviews"), s("positives").alias("positives"),
        ratio(s("positives", head), s("reviews", head)).alias("head_ratio"), ratio(s("positives", tail), s("reviews", tail)).alias("tail_ratio"),
    )
    peak = latest(days, ["appid"], [F.desc("reviews"), F.asc("stat_date")]).select("appid", F.col("stat_date").alias("peak_date"), F.col("reviews").alias("peak_reviews"))
    low = latest(days.filter(F.col("reviews") >= LOW_DAY_REVIEWS), ["appid"], [F.asc(F.col("positives") / F.col("reviews")), F.asc("stat_date")]).select("appid", F.col("stat_date").alias("lowest_date"), (F.col("positives") / F.col("reviews")).alias("lowest_ratio"))
    return out.join(peak, "appid", "left").join(low, "appid", "left")


def moving_ratio(days: DataFrame, rows: int = ROWS, least: int = 1) -> DataFrame:
    """``ahead``: positives over reviews of this and the next rows - 1 rows, null under ``least`` reviews."""
    w = Window.partitionBy("appid").orderBy("stat_date").rowsBetween(0, rows - 1)
    n = F.sum("reviews").over(w)
    return days.withColumn("ahead", F.when((n > 0) & (n >= least), F.sum("positives").over(w) / n))


def series(days: DataFrame, *columns: str) -> DataFrame:
    """appid and ``days``: the game's days in order, as structs of stat_date and ``columns``."""
    return days.groupBy(F.col("appid").alias("s_appid")).agg(F.array_sort(F.collect_list(F.struct("stat_date", *columns))).alias("days"))


def effect(days: DataFrame, patches: DataFrame, n: int = 7) -> DataFrame:
    """Ratios of the n days before and from a patch's day on, and their difference.

    A day counts in the n windows that end after it; a patch looks up the two that end on its
    day and n days on.
    """
    ends = days.select("appid", "reviews", "positives", F.explode(F.sequence(F.date_add("stat_date", 1), F.date_add("stat_date", n))).alias("end_day"))
    sums = ends.groupBy("appid", "end_day").agg(F.sum("reviews").alias("reviews"), F.sum("positives").alias("positives"))
    of = lambda name: sums.select("appid", F.col("end_day").alias(f"{name}_end"), F.lit(True).alias(f"{name}_is"), F.when(F.col("reviews") > 0, F.col("positives") / F.col("reviews")).alias(name))
    p = patches.select("gid", "appid", "patch_date").withColumn("before_end", F.col("patch_date")).withColumn("after_end", F.date_add("patch_date", n))
    out = p.join(of("before"), ["appid", "before_end"], "left").join(of("after"), ["appid", "after_end"], "left").filter("before_is or after_is")
    return out.select("gid", "appid", "patch_date", "before", "after").withColumn("delta", F.col("after") - F.col("before"))


def with_via(out: DataFrame, patches: DataFrame, until: str) -> DataFrame:
    """``via``: days of the game's other patches after a patch's day, up to ``until``."""
    dates = patches.groupBy("appid").agg(F.array_sort(F.collect_set("patch_date")).alias("__dates"))
    via = F.filter("__dates", lambda d: (d > F.col("patch_date")) & (d <= F.col(until)))
    return out.join(dates, "appid", "left").withColumn("via", F.coalesce(via, F.array().cast("array<date>"))).drop("__dates")


def recovery(days: DataFrame, effects: DataFrame, least: int = LOW_DAY_REVIEWS) -> DataFrame:
    """After a drop: the first day whose forward ratio is back at 0.9 of before, and how long it took.

    Windows of under ``least`` reviews don't count. pct_of_before is that day's ratio as a
    percentage of before (999 at most), without recovery the best one's.
    """
    drops = effects.filter("delta < 0").select("gid", "appid", "patch_date", "before")
    of = series(moving_ratio(days, least=least), "ahead")
    after = drops.join(of, F.col("appid") == F.col("s_appid")).withColumn("days", F.filter("days", lambda d: d["stat_date"] >= F.col("patch_date"))).filter(F.size("days") > 0)
    back = F.get(F.filter("days", lambda d: d["ahead"] >= RECOVERED * F.col("before")), F.lit(0))
    out = after.select("gid", "appid", "patch_date", "before", back.alias("back"), F.array_max(F.transform("days", lambda d: d["ahead"])).alias("best"))
    pct = F.least(F.round(100 * F.coalesce("back.ahead", "best") / F.col("before")), F.lit(999)).cast("int")
    return out.select("gid", "appid", "patch_date", F.col("back.stat_date").alias("recovered_on"), F.date_diff("back.stat_date", "patch_date").alias("days"), pct.alias("pct_of_before"))


def hold(days: DataFrame, effects: DataFrame, least: int = LOW_DAY_REVIEWS) -> DataFrame:
    """After a rise: rows from the patch on until the forward ratio is no longer above before.

    Windows of under ``least`` reviews don't count. ``peak`` is the best ratio while it held, and
    null if it never did; ``peak_after`` that of the whole rest of the series; ``held_until`` is
    the last day held.
    """
    rises = effects.filter("delta > 0").select("gid", "appid", "patch_date", "before")
    of = series(moving_ratio(days, least=least).filter("ahead is not null"), "ahead")
    after = rises.join(of, F.col("appid") == F.col("s_appid")).withColumn("days", F.filter("days", lambda d: d["stat_date"] >= F.col("patch_date"))).filter(F.size("days") > 0)
    ends = F.array_position(F.transform("days", lambda d: d["ahead"] <= F.col("before")), True)
    run = after.withColumn("ends", ends).withColumn("n", F.when(F.col("ends") > 0, F.col("ends") - 1).otherwise(F.size("days")).cast("bigint"))
    held = F.slice("days", F.lit(1), F.col("n").cast("int"))
    best = lambda a: F.array_max(F.transform(a, lambda d: d["ahead"]))
    return run.select("gid", "appid", "patch_date", F.col("n").alias("days_held"), best(held).alias("peak"), best(F.col("days")).alias("peak_after"), F.get(held, F.col("n").cast("int") - 1)["stat_date"].alias("held_until"), (F.col("ends") == 0).alias("to_the_end"))


def surge(days: DataFrame, patches: DataFrame, n: int = 7) -> DataFrame:
    """Review volume after a patch against the n days before, until the game's next patch.

    surged: the mean is at least 1.2 of the base and the first day at least 1.5 of it.
    """
    w = Window.partitionBy("appid").orderBy("patch_date", "gid")
    p = patches.withColumn("next_date", F.lead("patch_date").over(w)).select("gid", "appid", "patch_date", "next_date")
    near = p.join(series(days, "reviews"), F.col("appid") == F.col("s_appid"))
    early = F.filter("days", lambda d: (d["stat_date"] < F.col("patch_date")) & (d["stat_date"] >= F.date_sub("patch_date", n)))
    late = F.filter("days", lambda d: (d["stat_date"] >= F.col("patch_date")) & (d["stat_date"] < F.date_add("patch_date", n)) & (F.col("next_date").isNull() | (d["stat_date"] < F.col("next_date"))))
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("bigint"), lambda x, d: x + d["reviews"]) / F.size(c))
    out = near.select("gid", "appid", "patch_date", early.alias("early"), late.alias("late")).withColumn("base", mean(F.col("early"))).filter("base > 0")
    slow = F.array_position(F.transform("late", lambda d: d["reviews"] < SURGE_DAY * F.col("base")), True)
    out = out.withColumn("ratio", mean(F.col("late")) / F.col("base")).withColumn("run_days", F.when(slow > 0, slow - 1).otherwise(F.size("late")).cast("bigint"))
    return out.select("gid", "appid", "patch_date", "base", "ratio", "run_days", (F.coalesce(F.col("ratio") >= SURGE_MEAN, F.lit(False)) & (F.col("run_days") >= 1)).alias("surged"))


def ranges(days: DataFrame, unit: str = "week") -> DataFrame:
    """Days re-aggregated to weeks or months: the unrounded ratio over the days that have reviews."""
    own = days.filter("reviews > 0").withColumn("period", F.trunc("stat_date", unit))
    return own.groupBy("appid", "period").agg(F.count("*").alias("n_days"), F.sum("reviews").alias("reviews"), (F.sum("positives") / F.sum("reviews")).alias("ratio"))


def channel_totals(days: DataFrame) -> DataFrame:
    """Per game and channel (new, edited): reviews, positives, unrounded ratio, busiest day."""
    channel = lambda name: F.struct(F.lit(name).alias("channel"), F.col(f"{name}_review_count").alias("reviews"), F.col(f"{name}_positive_count").alias("positives"))
    rows = days.select("appid", "stat_date", F.explode(F.array(channel("new"), channel("edited"))).alias("x")).select("appid", "stat_date", "x.*")
    peak = latest(rows.filter("reviews > 0"), ["appid", "channel"], [F.desc("reviews"), F.asc("stat_date")]).select("appid", "channel", F.col("stat_date").alias("peak_date"))
    sums = rows.groupBy("appid", "channel").agg(F.sum("reviews").alias("reviews"), F.sum("positives").alias("positives"))
    return sums.withColumn("ratio", F.when(F.col("reviews") > 0, F.col("positives") / F.col("reviews"))).join(peak, ["appid", "channel"], "left")
