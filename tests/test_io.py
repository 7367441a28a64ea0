"""Sources, sinks and streams in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.plans import pipeline
from tidegauge.sources import landing, sinks
from tidegauge.streaming import ingest

REVIEW = "appid bigint, recommendationid bigint, created_ts bigint, updated_ts bigint, collected_ts bigint, voted_up boolean"


def test_landing(spark, tmp_path):
    d = tmp_path / "dt=2026-09-05" / "03"
    d.mkdir(parents=True)
    page = {"recommendationid": "77", "appid": 5, "author": {"steamid": "9", "playtime_at_review": 30}, "review": "ok", "language": "english", "timestamp_created": 1, "timestamp_updated": 2, "voted_up": True, "weighted_vote_score": 0.5, "collected_ts": 3}
    (d / "a.json").write_text(json.dumps(page) + "\n" + json.dumps(page | {"recommendationid": "bad", "weighted_vote_score": "0.25"}))
    (d / ".b.json.inprogress").write_text("{")
    got = landing.landed_reviews(spark, str(tmp_path)).orderBy(F.desc_nulls_last("recommendationid")).collect()
    assert [(r["recommendationid"], r["weighted_vote_score"], r["playtime_at_review"]) for r in got] == [(77, 0.5, 30), (None, 0.25, 30)]
    assert got[0].asDict().keys() == dict.fromkeys(schemas.columns(schemas.REVIEW)).keys()
    assert landing.partitions(spark, str(tmp_path)) == ["2026-09-05"] and landing.pending(["a", "b", "c"], ["a"], "c") == ["b"]
    n = tmp_path / "n.json"
    n.write_text(json.dumps({"gid": "1", "title": "t", "tags": ["a", "b"], "date": 4}))
    assert landing.landed_notices(spark, str(n)).first()["tags"] == "a,b"


def test_lake_and_compaction(spark, tmp_path):
    base, delta = str(tmp_path / "base"), str(tmp_path / "delta")
    assert landing.lake(spark, base, delta, REVIEW).count() == 0
    spark.createDataFrame([(1, 1, 1, 1, 5, True), (1, 2, 1, 1, 5, True)], REVIEW).write.parquet(base)
    spark.createDataFrame([(1, 1, 1, 1, 9, False), (1, 1, 1, 3, 9, False)], REVIEW).write.parquet(f"{delta}/dt=2024-01-01")
    with pytest.raises(ValueError):
        sinks.compact(spark, base, delta, REVIEW, expect=4)
    assert sinks.compact(spark, base, delta, REVIEW, expect=3) == 3
    assert sorted(tuple(r) for r in landing.lake(spark, base, delta, REVIEW).collect()) == [(1, 1, 1, 1, 9, False), (1, 1, 1, 3, 9, False), (1, 2, 1, 1, 5, True)]
    assert landing.existing(spark, [base, delta]) == [base]
    assert landing.finished(spark, base).count() == 3
    with pytest.raises(FileNotFoundError):
        landing.finished(spark, delta)


class Crash(Exception):
    pass


def crashing(monkeypatch, at):
    """Steps raise at the at-th of them; returns the list of those that were reached."""
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == at:
            raise Crash(name)

    monkeypatch.setattr(sinks, "step", step)
    return seen


def test_compaction_survives_a_crash_anywhere(spark, tmp_path, monkeypatch):
    """Ended between any two steps, readers find the old or the new table, and a second run ends it."""
    old = [(1, 1, 1, 1, 5, True), (1, 2, 1, 1, 5, True)]
    new = [(1, 1, 1, 1, 9, False), (1, 1, 1, 3, 9, False), (1, 7, 1, 3, 9, True)]
    want = sorted([(1, 1, 1, 1, 9, False), (1, 1, 1, 3, 9, False), (1, 2, 1, 1, 5, True), (1, 7, 1, 3, 9, True)])
    found = lambda base, delta: sorted(tuple(r) for r in landing.lake(spark, base, delta, REVIEW).collect())
    at, reached = 0, 1
    while reached > at:
        at += 1
        base, delta = str(tmp_path / f"base{at}"), str(tmp_path / f"delta{at}")
        spark.createDataFrame(old, REVIEW).coalesce(1).write.parquet(base)
        spark.createDataFrame(new, REVIEW).coalesce(1).write.parquet(f"{delta}/dt=2024-01-01")
        seen = crashing(monkeypatch, at)
        try:
            sinks.compact(spark, base, delta, REVIEW, buckets=2)
            reached = 0
        except Crash:
            reached = at + 1
        monkeypatch.undo()
        assert found(base, delta) in (sorted(old + new), sorted(want + new), want), seen[-1]
        assert sinks.compact(spark, base, delta, REVIEW, expect=4, buckets=2) == 4
        assert found(base, delta) == want and not landing.exists(spark, delta), seen[-1]
    assert at > 10


def test_versioned_table_survives_a_crash(spark, tmp_path, monkeypatch):
    table, schema = str(tmp_path / "t"), "id bigint, v string"
    write = lambda rows: sinks.write_buckets(spark.createDataFrame(rows, "id bigint, v string, bucket int"), table, sorted({r[2] for r in rows}), 3)
    read = lambda: sorted(tuple(r) for r in sinks.read_table(spark, table, schema).collect())
    assert read() == []
    write([(1, "a", 0), (2, "a", 1)])
    for at in (1, 2):
        crashing(monkeypatch, at)
        with pytest.raises(Crash):
            write([(1, "b", 0), (3, "b", 2)])
        monkeypatch.undo()
        assert read() == [(1, "a"), (2, "a")]
    write([(1, "b", 0), (3, "b", 2)])
    sinks.vacuum(spark, table)
    assert read() == [(1, "b"), (2, "a"), (3, "b")] and sorted(tuple(r) for r in sinks.read_table(spark, table, schema, [1]).collect()) == [(2, "a")]
    with pytest.raises(ValueError):
        sinks.write_buckets(spark.createDataFrame([(1, "a", 0)], "id bigint, v string, bucket int"), table, [0], 4)


def test_swap_recovers(spark, tmp_path, monkeypatch):
    live, staged = str(tmp_path / "live"), str(tmp_path / "staged")
    spark.range(3).write.parquet(live)
    spark.range(5).write.parquet(staged)
    crashing(monkeypatch, 2)
    with pytest.raises(Crash):
        sinks.swap(spark, staged, live)
    monkeypatch.undo()
    assert not landing.exists(spark, live)
    sinks.recover(spark, live)
    assert spark.read.parquet(live).count() == 3
    sinks.swap(spark, staged, live)
    assert spark.read.parquet(live).count() == 5


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("shard", F.col("id") % 3)
    path = sinks.write_partition(df, str(tmp_path / "t"), "2024-01-01", 10)
    assert spark.read.parquet(path).count() == 10 and sinks.file_count(450_000) == 3 and sinks.compact_files(0) == 1
    assert sinks.replace_table(df, str(tmp_path / "r")) == 10 and sinks.replace_table(df.limit(4), str(tmp_path / "r")) == 4
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    sinks.write_shards(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 10


def test_streams_equal_batches(spark, tmp_path):
    src, target, mark = (str(tmp_path / x) for x in ("in", "target", "mark"))
    first = spark.createDataFrame([(1, 1, 1, 1, 5, True), (1, 2, 1, 1, 5, True)], REVIEW)
    second = spark.createDataFrame([(1, 1, 1, 9, 10, False), (1, 2, 0, 0, 99, False)], REVIEW)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(src)
        ingest.run_available(ingest.stream(spark, src, REVIEW), mark, ingest.upsert_batches(target, ["recommendationid"]))
    assert sorted((r["recommendationid"], r["updated_ts"], r["voted_up"]) for r in sinks.read_table(spark, target, REVIEW).collect()) == [(1, 9, False), (2, 1, True)]
    live = ingest.daily_counts(ingest.stream(spark, src, REVIEW))
    q = live.writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "m2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("live").columns == ["appid", "day_start", "versions", "positives"]


def test_incremental(spark):
    runs = spark.createDataFrame([("COMPLETED", 100), ("FAILED", 200)], "status string, started_ts bigint")
    assert ingest.watermark(runs, 10) == 90 and ingest.watermark(runs.limit(0), 10) is None
    pages = spark.createDataFrame([(1, 0, 300), (1, 1, 80), (1, 2, 50)], "appid int, page int, updated_ts bigint")
    assert sorted(r["page"] for r in ingest.until_known(pages, 90).collect()) == [0, 1]
    done = spark.createDataFrame([("a", "m", "h")], "key string, model string, input_hash string")
    work = spark.createDataFrame([("a", "m", "h"), ("a", "m", "h2")], "key string, model string, input_hash string")
    assert ingest.not_done(work, done).count() == 1
    order = []
    stages = [(n, lambda n=n: order.append(n)) for n in "abc"]
    pipeline.run(stages, start="b")
    pipeline.run(stages, only="a")
    assert order == ["b", "c", "a"]
    with pytest.raises(KeyError):
        pipeline.run(stages, only="x")
