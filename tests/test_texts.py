from pyspark.sql import functions as F

from tidegauge.functions import texts


def test_strings(spark):
    df = spark.createDataFrame([("up 5% from 3 to 7.5 and 9", "한국", "다리")], "a string, b string, c string")
    r = df.select(
        texts.numbers(F.col("a")).alias("n"), texts.shortened(F.col("a"), 10).alias("s"), texts.shortened(F.lit("short"), 10).alias("t"), texts.with_particle(F.col("b"), "은", "는").alias("p"), texts.with_particle(F.col("c"), "은", "는").alias("q"),
        texts.tidy_units(F.lit("5 % in 3days")).alias("u"), texts.change_sentence(F.lit("add"), F.lit("none"), F.lit("map")).alias("v"), texts.input_hash(F.col("a"), F.lit(None)).alias("h"),
    ).first()
    assert r["n"] == ["5%", "3", "7.5"] and r["s"] == "up 5%…" and r["t"] == "short" and r["p"] == "한국은" and r["q"] == "다리는" and r["u"] == "5% in 3 days" and r["v"] == "map was added" and len(r["h"]) == 64


def test_batches(spark):
    df = spark.createDataFrame([("s", k, "x" * n) for k, n in enumerate([4, 4, 4, 30, 1, 1, 1])] + [("t", 0, None)], "shard string, k int, text string")
    got = {(r["shard"], r["k"]): r["batch"] for r in texts.batches(df, "shard", "k", "text", 10, 2).collect()}
    assert [got["s", k] for k in range(7)] == [0, 0, 1, 2, 3, 3, 4] and got["t", 0] == 0
