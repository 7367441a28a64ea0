"""Read-side queries: lists with keyset pages, details, grids, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.rates import percent1
from tidegauge.operators.versions import latest
from tidegauge.sources.shared import written

MIN_SAMPLE = 30
#: Rows up to which a code list is broadcast.
CODE_ROWS = 100_000


def title_key(text: Column) -> Column:
    """Letters, digits and marks only, lower-cased: both sides of a title search."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]", ""))


def contains(text: Column, wanted: str) -> Column:
    """Literal, case-insensitive: no pattern characters to escape."""
    return F.contains(F.lower(text), F.lit(wanted.lower()))


def with_all_tags(games: DataFrame, tags: DataFrame, wanted: list) -> DataFrame:
    """Games that have every wanted tag (relational division)."""
    n = len(set(wanted))
    has = tags.filter(F.col("tag").isin(*set(wanted))).groupBy("appid").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") == n)
    return games.join(has.select("appid"), "appid", "left_semi")


def keyset(df: DataFrame, sort: str, ident: str, descending: bool, size: int, after: tuple | None = None) -> DataFrame:
    """A page of size + 1 rows in order (sort nulls last, id), after the cursor (value, id)."""
    c = F.col(sort)
    if after is not None:
        value, last = after
        if value is None:
            df = df.filter(c.isNull() & (F.col(ident) > last))
        else:
            beyond = c < value if descending else c > value
            df = df.filter(beyond | ((c == value) & (F.col(ident) > last)) | c.isNull())
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(ident).asc()).limit(size + 1)


def latest_patch(games: DataFrame, patches: DataFrame) -> DataFrame:
    """Games with their latest patch (gid, published_ts), null if none."""
    one = latest(patches.select("appid", "gid", "published_ts"), ["appid"], [F.col("published_ts").desc_nulls_last(), F.desc("gid")])
    return games.join(one, "appid", "left")


def ordered_tags(tags: DataFrame) -> DataFrame:
    """appid, tags: names by weight (descending), then name."""
    return tags.groupBy("appid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("tag").alias("t")))), lambda x: x["t"]).alias("tags"))


def flagged(games: DataFrame, members: DataFrame, flag: str = "is_mine") -> DataFrame:
    return games.join(members.select("appid").distinct().withColumn(flag, F.lit(True)), "appid", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def helpful(reviews: DataFrame, size: int, after: tuple[int, int] | None = None) -> DataFrame:
    """Most helpful first, then the newer id; after a (votes, id) cursor."""
    if after:
        v, i = after
        reviews = reviews.filter((F.col("votes_up") < v) | ((F.col("votes_up") == v) & (F.col("recommendationid") < i)))
    return reviews.orderBy(F.desc("votes_up"), F.desc("recommendationid")).limit(size)


def with_total(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first rows and, on each, the number of all rows."""
    total = df.agg(F.count("*").alias("total_count"))
    return df.orderBy(*order).limit(size).crossJoin(F.broadcast(total))  # one row


def calendar(days: DataFrame, first: str, last: str) -> DataFrame:
    """``days`` (stat_date ...) on every day of a closed period, missing ones null."""
    spark = days.sparkSession
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("stat_date"))
    return dates.join(days, "stat_date", "left")


def totals(days: DataFrame) -> DataFrame:
    """Sums over days with exact and one-decimal positive rates per channel."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    summed = days.agg(s("review_count").alias("reviews"), s("negative_count").alias("negatives"), s("new_review_count").alias("new_reviews"), s("new_positive_count").alias("new_positives"), s("edited_review_count").alias("edited_reviews"), s("edited_positive_count").alias("edited_positives"))
    good = F.col("new_positives") + F.col("edited_positives")
    return summed.select("*", F.when(F.col("reviews") > 0, good / F.col("reviews")).alias("positive_ratio"), percent1(good, F.col("reviews")).alias("positive_rate"), percent1(F.col("new_positives"), F.col("new_reviews")).alias("new_rate"), percent1(F.col("edited_positives"), F.col("edited_reviews")).alias("edited_rate"))


def patch_ordinals(patches: DataFrame, first: int, last: int) -> DataFrame:
    """Patches of a period with their number among all of the game's, and how many there are."""
    w = Window.partitionBy("appid")
    numbered = patches.withColumn("ordinal", F.row_number().over(w.orderBy("published_ts", "gid"))).withColumn("patch_count", F.count("*").over(w))
    return numbered.filter((F.col("published_ts") >= first) & (F.col("published_ts") < last))


def patch_cycles(patches: DataFrame) -> DataFrame:
    """Days since the game's previous patch, until its next, and the mean of gaps so far."""
    w = Window.partitionBy("appid").orderBy("published_ts", "gid")
    gap = (F.col("published_ts") - F.lag("published_ts").over(w)) / F.lit(86400.0)
    out = patches.withColumn("prev_days", gap).withColumn("next_days", (F.lead("published_ts").over(w) - F.col("published_ts")) / F.lit(86400.0))
    return out.withColumn("mean_days", F.avg("prev_days").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def canonical_language(code: Column) -> Column:
    return F.when(code == "koreana", "korean").otherwise(code)


def language_share(reviews: DataFrame, names: DataFrame) -> DataFrame:
    """Latest reviews per canonical language: counts, share of the total, rate, sample flag."""
    counted = reviews.groupBy(canonical_language(F.col("language_code")).alias("language_code")).agg(F.count("*").alias("review_count"), F.count_if(F.col("voted_up")).alias("positive_count"))
    total = counted.agg(F.sum("review_count").alias("total"))
    named = names.groupBy(canonical_language(F.col("language_code")).alias("language_code")).agg(F.max("name").alias("name"))
    return counted.crossJoin(F.broadcast(total)).join(named, "language_code", "left").select(
        "language_code", F.coalesce("name", "language_code").alias("name"), "review_count", "positive_count",
        percent1(F.col("review_count"), F.col("total")).alias("share"), percent1(F.col("positive_count"), F.col("review_count")).alias("positive_rate"), (F.col("review_count") >= MIN_SAMPLE).alias("enough"),
    )


def band_counts(bands: DataFrame, placed: DataFrame) -> DataFrame:
    """Per game and band, and over all bands (band_no null): reviews and positives, zeros kept."""
    joined = bands.select("appid", "band_no").join(placed.select("appid", "band_no", "recommendationid", "voted_up"), ["appid", "band_no"], "left")
    return joined.rollup("appid", "band_no").agg(F.count("recommendationid").alias("review_count"), F.count_if(F.col("voted_up")).alias("positive_count")).filter("appid is not null")


def topic_grid(bands: DataFrame, topics: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every band with every topic, zeros kept. topics: the code list, broadcast if it is short."""
    codes = topics.select("topic_id")
    grid = bands.select("appid", "band_no").crossJoin(F.broadcast(codes) if codes.count() <= CODE_ROWS else codes)
    counted = mentions.groupBy("appid", "band_no", "topic_id").agg(F.count("*").alias("mentions"))
    return grid.join(counted, ["appid", "band_no", "topic_id"], "left").fillna(0, ["mentions"])


def highest_band(grid: DataFrame, counts: DataFrame) -> DataFrame:
    """Per game and topic the band of the highest mention rate; ties to the lower band, empty bands out."""
    rated = grid.join(counts.select("appid", "band_no", "review_count"), ["appid", "band_no"]).filter("review_count > 0").withColumn("rate", F.col("mentions") / F.col("review_count"))
    return latest(rated, ["appid", "topic_id"], [F.desc("rate"), F.asc("band_no")]).select("appid", "topic_id", "band_no", "rate")


def broken_bands(bands: DataFrame) -> DataFrame:
    """Games whose bands aren't four, contiguous from 0, with the last open."""
    w = Window.partitionBy("appid").orderBy("band_no")
    seen = bands.withColumn("before", F.lag("playtime_to").over(w))
    wrong = ((F.col("band_no") == 1) & (F.col("playtime_from") != 0)) | ((F.col("band_no") > 1) & ~F.col("before").eqNullSafe(F.col("playtime_from"))) | ((F.col("band_no") == 4) != F.col("playtime_to").isNull())
    return seen.groupBy("appid").agg(F.count("*").alias("n_bands"), F.count_if(wrong).alias("n_wrong")).filter("n_bands <> 4 or n_wrong > 0")


def plan_page(plans: DataFrame, slots: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """Newest plans first with their slot counts; a page is cut before the join."""
    if after:
        at, i = after
        plans = plans.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("plan_id") < i)))
    page = plans.orderBy(F.desc("created_at"), F.desc("plan_id")).limit(size)
    counted = slots.join(F.broadcast(page.select("plan_id")), "plan_id", "left_semi").groupBy("plan_id").agg(F.count("*").alias("slot_count"), F.countDistinct(F.when(F.col("confirmed"), F.col("kind"))).alias("confirmed_kinds"))
    return page.withColumn("preview", F.left("raw_text", F.lit(200))).drop("raw_text").join(counted, "plan_id", "left").fillna(0, ["slot_count", "confirmed_kinds"])


def budget_prefix(rows: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows in order until the first that would exceed the budget; at least one row of a group.

    A group's running sums are taken by ranges of the order, with the ranges' sums before them
    added, so one group may hold any share of the rows. Null sizes count as nothing.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("own_size", size).repartitionByRange(n, *group, *order).withColumn("range_no", F.spark_partition_id())
    w = Window.partitionBy(*group, "range_no").orderBy(*order)
    own = written(dealt.withColumn("own_n", F.row_number().over(w)).withColumn("own_sum", F.coalesce(F.sum("own_size").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))))
    parts = own.groupBy(*group, "range_no").agg(F.count("*").alias("rows"), F.coalesce(F.sum("own_size"), F.lit(0)).alias("sum"))
    past = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = parts.select(*group, "range_no", F.coalesce(F.sum("rows").over(past), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("sum").over(past), F.lit(0)).alias("sum_before"))
    placed = own.join(before, [*group, "range_no"]).withColumn("own_n", F.col("own_n") + F.col("rows_before")).withColumn("own_sum", F.col("own_sum") + F.col("sum_before"))
    over = placed.filter(F.col("own_sum") > budget).groupBy(*group).agg(F.min("own_n").alias("first_over"))
    return placed.join(over, group, "left").filter("first_over is null or own_n < first_over or own_n = 1").select(*rows.columns)


def numbered(rows: DataFrame, order: list[Column], name: str = "nth") -> DataFrame:
    """``name``: each row's place (from 0) in an order of all rows, without sorting them in one task.

    Rows are dealt by ranges of the order and numbered there, and the counts of the ranges before
    (a row each) are added. The numbered ranges are a written table: dealt again, their bounds could
    differ. Equal keys of the order must not matter.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("range_no", F.spark_partition_id())
    own = written(dealt.withColumn("in_range", F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1))
    counts = own.groupBy("range_no").agg(F.count("*").alias("range_rows"))
    before = counts.withColumn("before", F.coalesce(F.sum("range_rows").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("range_rows")  # a row per range
    return own.join(F.broadcast(before), "range_no").withColumn(name, F.col("before") + F.col("in_range")).drop("range_no", "in_range", "before")


def shards(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Round-robin shard numbers in priority order, which must be a total one."""
    return numbered(rows, order, "shard").withColumn("shard", F.pmod("shard", F.lit(n)))


def seeded_sample(rows: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(size)


def first_occurrence(rows: DataFrame, group: list[str], text: str, order: list[Column]) -> DataFrame:
    """``is_first``: the first row of a group with its text, but for case and spacing."""
    norm = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s]+", " "), r"^ +| +$", "")))
    keyed = rows.withColumn("__norm", norm)
    return keyed.withColumn("is_first", F.row_number().over(Window.partitionBy(*group, "__norm").orderBy(*order)) == 1).drop("__norm")
