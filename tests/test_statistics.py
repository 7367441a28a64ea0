"""Literal rows for the aggregates, versions, checks and reads."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import rates, times
from tidegauge.operators import aggregates as agg
from tidegauge.operators import checks, search, serving, trends, versions

REVIEW = "appid bigint, recommendationid bigint, created_ts bigint, updated_ts bigint, collected_ts bigint, voted_up boolean"
DAY = 86_400
NOON = 1_788_577_765  # 2026-09-05 in Seoul


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_days(spark):
    df = spark.createDataFrame([(NOON,), (1_700_006_399,), (1_700_006_400 - 9 * 3600 + 8 * 3600,)], "t bigint")
    got = df.select(times.kst_date("t").alias("d"), times.day_start(times.kst_date("t")).alias("s"), times.hour_bucket("t").alias("h")).collect()
    assert got[0]["d"] == date(2026, 9, 5)
    for r, t in zip(got, df.collect()):
        assert r["s"] <= t["t"] < r["s"] + DAY and int(r["h"]) == (t["t"] + 32400) % DAY // 3600
    edge = spark.createDataFrame([(1_757_084_399,), (1_757_084_400,)], "t bigint")  # 14:59:59Z, 15:00:00Z
    assert [r[0] for r in edge.select(times.kst_date("t")).collect()] == [date(2025, 9, 5), date(2025, 9, 6)]


def daily_rows():
    return [(1, 1, NOON, NOON, NOON + 5, True), (1, 1, NOON, NOON, NOON + 9, False), (1, 1, NOON, NOON + 60, NOON + 70, True), (1, 1, NOON, NOON + DAY, NOON + DAY + 1, False), (1, 2, NOON, NOON, NOON + 1, False), (2, 3, NOON, NOON + 30, NOON + 900, True), (2, 3, NOON, NOON + 10, NOON + 9000, False)]


def test_daily_stat(spark):
    df = spark.createDataFrame(daily_rows(), REVIEW)
    want = [(1, date(2026, 9, 5), 2, 1, 2, 1, 0, 0), (1, date(2026, 9, 6), 1, 1, 0, 0, 1, 0), (2, date(2026, 9, 5), 1, 0, 1, 1, 0, 0)]
    assert rows(agg.daily_stat(df, strict=True)) == want
    assert rows(agg.daily_stat(df.union(df).repartition(5))) == want  # repeats and order change nothing
    assert agg.daily_stat(df.limit(0), strict=True).count() == 0
    clash = df.union(spark.createDataFrame([(1, 2, NOON, NOON, NOON + 1, True)], REVIEW))
    with pytest.raises(checks.DataConflict):
        agg.daily_stat(clash, strict=True)
    with pytest.raises(ValueError):
        agg.daily_stat(df.union(spark.createDataFrame([(0, 2, NOON, NOON, NOON + 1, True)], REVIEW)), strict=True)


def playtimes(spark, values, appid=1):
    return spark.createDataFrame([(appid, k, NOON, NOON, NOON + 1, True, v, "en") for k, v in enumerate(values, 1)], REVIEW + ", playtime int, language_code string")


@pytest.mark.parametrize(("values", "bounds", "counts"), [(range(10, 90, 10), [0, 20, 40, 60], [1, 2, 2, 3]), ([7] * 5, [0, 7, 7, 7], [0, 0, 0, 5]), ([3], [0, 3, 3, 3], [0, 0, 0, 1]), ([None, -1, 0, 2**31 - 1], [0, 0, 0, 2**31 - 1], [0, 0, 1, 1])])
def test_bands(spark, values, bounds, counts):
    df = playtimes(spark, values)
    got = rows(agg.band_stat(df), "band_no", "playtime_from", "review_count")
    assert [g[1] for g in got] == bounds and [g[2] for g in got] == counts
    quality = agg.band_quality(df).first()
    assert quality["included_count"] == sum(counts) and quality["missing_count"] == sum(v is None for v in values)
    assert serving.broken_bands(agg.band_bounds(df)).count() == 0


def test_band_topics_match_the_version(spark):
    df = playtimes(spark, [10, 20, 30, 40])
    topics = spark.createDataFrame([(1, 1, NOON, 5), (1, 1, NOON, 5), (1, 1, NOON, 6), (1, 2, NOON - 1, 5)], "appid bigint, recommendationid bigint, updated_ts bigint, topic_id int")
    assert rows(agg.band_topic_stat(df, topics, agg.band_bounds(df))) == [(1, 2, 5, 1, 0), (1, 2, 6, 1, 0)]


def test_patch_stat(spark):
    day0 = (NOON + 32400) // DAY * DAY - 32400
    r = lambda i, at, up, collected=None: (1, i, at, at, collected or at + 1, up)
    seen = [r(1, day0 - 7 * DAY, True), r(2, day0 - 7 * DAY - 1, True), r(3, day0 - 1, False), r(4, day0, True), r(4, day0 + 9, False), r(5, day0 + 7 * DAY - 1, True), r(6, day0 + 7 * DAY, True), r(7, day0 + 5, True, day0 + 900 * DAY), (2, 8, day0, day0, day0 + 1, True)]
    patches = spark.createDataFrame([(10, 1, NOON), (11, 2, None), (12, 3, NOON), (13, 1, NOON + 100 * DAY)], "gid bigint, appid bigint, published_ts bigint")
    out = agg.patch_stat(spark.createDataFrame(seen, REVIEW), patches, day0 - 7 * DAY, day0 + 50 * DAY, day0 + 40 * DAY)
    assert rows(out, "gid", "before_count", "before_positive", "after_count", "after_positive", "before_pct", "delta_pct") == [(10, 2, 1, 2, 1, 50.0, 0.0), (12, 0, 0, 0, 0, None, None)]


def test_rates(spark):
    df = spark.createDataFrame([(1, 6), (1, 12), (0, 0)], "a bigint, b bigint")
    got = df.select(rates.percent2(F.col("a"), F.col("b")).alias("p")).collect()
    assert [g["p"] for g in got] == [16.67, 8.33, None]
    d = spark.createDataFrame([(3.0,), (3.01,), (-3.0,), (-3.5,), (None,)], "d double")
    assert [x[0] for x in d.select(rates.outcome(F.col("d"))).collect()] == ["steady", "improved", "steady", "worsened", None]


def test_versions(spark):
    df = spark.createDataFrame(daily_rows(), REVIEW)
    assert rows(versions.bucketed_versions(df, 3)) == rows(versions.exact_versions(df))
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, v string, judged string")
    new = spark.createDataFrame([(2, "B", None), (1, "A", "y"), (3, "C", "z")], "id int, v string, judged string")
    assert rows(versions.merge_columns(target, new, ["id"], {"judged": "judged"})) == [(1, "A", "y"), (2, "B", None), (3, "C", "z")]
    assert rows(versions.insert_missing(target, new, ["id"])) == [(1, "a", "x"), (2, "b", None), (3, "C", "z")]
    assert rows(versions.changed(target, new, ["id"], ["judged"])) == [(1, "A", "y")]


def test_checks(spark):
    df = spark.createDataFrame([("en",), (None,), (" ",), (" de",), ("x" * 21,)], "c string")
    assert [r[0] for r in df.select(checks.invalid_language(F.col("c"))).collect()] == [False, True, True, True, True]
    blank = spark.createDataFrame([("　 \t",), ("a",), ("",)], "c string")
    assert [r[0] for r in blank.select(checks.blank(F.col("c"))).collect()] == [True, False, True]
    with pytest.raises(TypeError):
        checks.assert_types(df, {"c": "bigint"})
    with pytest.raises(ValueError):
        checks.reject_guard(df, F.col("c").isNull())
    assert checks.reject_guard(df, F.col("c").isNull(), 0.5).count() == 4
    nulls = spark.createDataFrame([(1, None), (1, 2), (3, 3)], "k int, v int")
    assert rows(checks.conflicts(nulls, ["k"], ["v"])) == [(1, 2)]


def test_pages(spark):
    games = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 9.0), (5, None)], "appid int, rate double")
    ids = lambda after=None: [r["appid"] for r in serving.keyset(games, "rate", "appid", True, 1, after).collect()]
    assert ids() == [4, 1] and ids((9.0, 4)) == [1, 3] and ids((5.0, 3)) == [2, 5] and ids((None, 2)) == [5]
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (3, "a")], "appid int, tag string")
    assert rows(serving.with_all_tags(games, tags, ["a", "b"]), "appid") == [(1,)]
    texts = spark.createDataFrame([(1, 1, 4), (1, 2, 4), (1, 3, 9), (1, 4, 1), (2, 1, 99)], "g int, n int, size int")
    assert rows(serving.budget_prefix(texts, ["g"], [F.asc("n")], F.col("size"), 10), "g", "n") == [(1, 1), (1, 2), (2, 1)]


def test_search(spark):
    c = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [0.6, 0.8]), (3, 8, [0.0, 0.0]), (4, 8, [-1.0, 0.0])], "id int, gid int, vector array<double>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "slot int, vector array<double>")
    hits = search.nearest(c, q, 3)
    assert [(r["id"], round(r["cosine"], 3)) for r in hits.orderBy("rank").collect()] == [(1, 1.0), (2, 0.6), (4, -1.0)]
    assert rows(search.best_per_patch(hits), "gid", "id") == [(7, 1), (8, 4)]
    m = spark.createDataFrame([([False, True, False], ["a", "b", "c"])], "m array<boolean>, t array<string>")
    assert m.select(search.matched_first(F.col("m"), F.col("t"), 2)).first()[0] == ["b", "a"]


def test_after_a_patch(spark):
    days = [(1, date(2024, 1, k), 10, 9 if k < 8 else 3 if k < 12 else 9) for k in range(1, 25)]
    d = spark.createDataFrame(days, "appid int, stat_date date, reviews bigint, positives bigint")
    p = spark.createDataFrame([(5, 1, date(2024, 1, 8))], "gid int, appid int, patch_date date")
    effect = trends.effect(d, p)
    assert round(effect.first()["delta"], 4) == round((4 * 3 + 3 * 9) / 70 - 0.9, 4)
    assert trends.recovery(d, effect).first()["recovered_on"] == date(2024, 1, 11)
    busy = spark.createDataFrame([(1, date(2024, 1, k), 10 if k < 8 else 30 if k < 10 else 8, 1) for k in range(1, 20)], d.schema)
    surge = trends.surge(busy, p).first()
    assert (surge["run_days"], surge["surged"]) == (2, True)
