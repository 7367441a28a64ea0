"""Whole answers and cursors on literal rows."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import responses, serving


def test_cursors():
    scope = {"sort": "rate", "tags": [1, 2]}
    text = responses.cursor({"value": 4.5, "id": 7}, scope)
    assert responses.read_cursor(text, dict(reversed(scope.items()))) == {"value": 4.5, "id": 7}
    for bad, of in ((text, scope | {"sort": "name"}), ("abc", scope), ("", scope), (text[:-6], scope)):
        with pytest.raises(ValueError):
            responses.read_cursor(bad, of)


def test_case_orders(spark):
    hits = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.8), (4, 0.7)], "gid int, cosine double")
    stats = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0), (4, None)], "gid int, delta_pct double")
    notes = spark.createDataFrame([(1, 10), (2, None), (3, 30), (4, 40)], "gid int, published_ts int")
    order = lambda name: [r["gid"] for r in responses.case_answer(hits, stats, notes, name, batch=2).orderBy("outcome", "place").collect()]
    assert order("similarity") == [1, 2, 3] and order("recent") == [3, 1, 2] and order("improved") == [2, 3, 1] and order("worsened") == [1, 2, 3]
    assert [r["batch"] for r in responses.case_answer(hits, stats, notes, batch=2).orderBy("place").collect()] == [0, 0, 1]


def test_small_samples_fall_back(spark):
    counts = spark.createDataFrame([(1, 1, 20, 10), (1, 2, 20, 5), (1, None, 40, 15), (2, 1, 9, 9), (2, None, 9, 9)], "appid int, band_no int, review_count long, positive_count long")
    assert sorted(tuple(r) for r in responses.playtime_analysis(counts).collect()) == [(1, 0, 40, 37.5, True), (1, 1, 20, 50.0, True), (1, 2, 20, 25.0, True), (2, 0, 9, None, False)]


def test_numbers_over_ranges(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("p"), "id").repartition(5)
    got = [(r["p"], r["id"]) for r in serving.numbered(df, [F.asc("p"), F.desc("id")]).orderBy("nth").collect()]
    assert got == sorted(((r["p"], r["id"]) for r in df.collect()), key=lambda x: (x[0], -x[1]))
    assert serving.numbered(df.limit(0), [F.asc("p")]).count() == 0


def test_periods():
    from datetime import date

    from tidegauge.functions import times

    assert times.checked_period(date(2024, 1, 1), date(2024, 1, 31)) == 31 and times.checked_period(date(2024, 1, 1), date(2025, 2, 3)) == 400
    for last in (date(2023, 12, 31), date(2025, 2, 4)):
        with pytest.raises(ValueError):
            times.checked_period(date(2024, 1, 1), last)
