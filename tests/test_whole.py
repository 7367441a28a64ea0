"""Queries and operators do the whole job, on small rows."""

from datetime import date

from pyspark.sql import functions as F

import __spark_entry__ as e
from tidegauge.operators import search, topics, trends


def saved(spark, path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def test_min_max_of_every_customer(spark, tmp_path):
    orders = spark.createDataFrame([(1, 1, 10.0), (2, 1, 30.0), (3, 2, 5.0), (4, 2, 9.0), (5, 2, 6.0), (6, 3, 1.0)], "o_orderkey bigint, o_custkey bigint, o_totalprice double")
    out = e.queries()["min_max_scaled_all"](spark, saved(spark, tmp_path, orders=orders))
    assert sorted((r["o_orderkey"], r["scaled"]) for r in out.collect()) == [(1, 0.0), (2, 1.0), (3, 0.0), (4, 1.0), (5, 0.25)]


def test_topics_are_scored_in_five_folds(spark, tmp_path, monkeypatch):
    fitted = []
    monkeypatch.setattr(topics, "pipeline", lambda *_: type("P", (), {"fit": lambda _, rows: fitted.append(rows.count())})())
    monkeypatch.setattr(topics, "scored", lambda model, rows: rows.withColumn("prob", F.col("label")))
    documents = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    out = e.queries()["topic_classify"](spark, saved(spark, tmp_path, documents=documents, labels=labels))
    assert fitted == [16] * 5 and out.first()["f1"] == 1.0


def test_any_number_of_query_vectors(spark, monkeypatch):
    c = spark.range(40).select("id", F.array(F.cos("id"), F.sin("id")).alias("vector"))
    q = c.select(F.col("id").alias("slot"), "vector")
    hits = lambda: sorted((r["slot"], r["rank"], r["id"]) for r in search.nearest(c, q, 3).collect())
    whole = hits()
    monkeypatch.setattr(search, "MAX_QUERIES", 7)
    assert len(whole) == 120 and hits() == whole


def test_recovery_and_hold_need_ten_reviews(spark):
    on = lambda k: date(2024, 1, k)
    rated = lambda ks: spark.createDataFrame([(1, on(k), n, p) for k, n, p in ks], "appid int, stat_date date, reviews bigint, positives bigint")
    patches = spark.createDataFrame([(5, 1, on(8)), (6, 1, on(10)), (7, 1, on(25))], "gid int, appid int, patch_date date")
    first = lambda d: trends.effect(d, patches).filter("gid = 5")
    low = rated([(k, 10, 8) for k in range(1, 8)] + [(k, 10, 2) for k in range(8, 15)] + [(15, 1, 1)])
    got = trends.recovery(low, first(low)).first()
    assert (got["recovered_on"], got["pct_of_before"]) == (None, 34)  # the last window, of one review, would be back at 125 %
    back = rated([(k, 10, 8) for k in range(1, 8)] + [(k, 10, 2) for k in range(8, 15)] + [(k, 10, 8) for k in range(15, 30)])
    got = trends.with_via(trends.recovery(back, first(back)), patches, "recovered_on").first()
    assert (got["recovered_on"], got["days"], got["pct_of_before"], got["via"]) == (on(15), 7, 100, [on(10)])
    high = rated([(k, 10, 4) for k in range(1, 8)] + [(k, 10, 6) for k in range(8, 15)] + [(k, 10, 0) for k in range(15, 22)] + [(22, 10, 10), (23, 1, 0)])
    got = trends.with_via(trends.hold(high, first(high)), patches, "held_until").first()
    assert (round(got["peak"], 6), got["peak_after"] > 0.6, got["days_held"], got["held_until"], got["to_the_end"], got["via"]) == (0.6, True, 3, on(10), False, [on(10)])


def test_each_field_of_a_change_is_grounded(spark, tmp_path):
    out = e.queries()["grounding_check"](spark, saved(spark, tmp_path, benchmark=spark.createDataFrame([(1, "some plain words of an item that go on for a while")], "item_id bigint, text string"))).collect()
    got = {r["case"]: (r["grounded"], r["refusal"]) for r in out}
    assert got.pop("true") == (True, None) and got.pop("quote")[1] in (None, "sentence")
    assert got == {k: (False, k) for k in ("target", "attribute", "values", "conditions", "direction", "sentence")}
