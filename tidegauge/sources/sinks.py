"""Sinks over plain Parquet: partition overwrite, table swap, compaction, shards."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.checks import assert_counts
from tidegauge.operators.versions import bucket_of, exact_versions
from tidegauge.sources.landing import _fs, exists

ROWS_PER_FILE, COMPACT_ROWS = 200_000, 2_000_000


def file_count(rows: int, most: int = 16, per_file: int = ROWS_PER_FILE) -> int:
    return max(1, min(most, rows // per_file + 1))


def compact_files(rows: int, most: int = 200) -> int:
    return max(1, min(most, -(-rows // COMPACT_ROWS)))


def write_partition(df: DataFrame, root: str, dt: str, rows: int, most: int = 16) -> str:
    """Overwrite one date's partition; ``coalesce`` keeps it shuffle-free."""
    path = f"{root}/dt={dt}"
    df.coalesce(file_count(rows, most)).write.mode("overwrite").parquet(path)
    return path


def step(name: str) -> None:
    """Called before every step that a crash may separate from the next; tests raise here."""


def recover(spark: SparkSession, live: str) -> None:
    """Undo a swap that ended between its renames: a live directory that was moved aside comes back."""
    fs, to = _fs(spark, live)
    if fs.exists(to):
        return
    aside = [x.getPath() for x in fs.listStatus(to.getParent())] if fs.exists(to.getParent()) else []
    aside = sorted((p for p in aside if p.getName().startswith(f"{to.getName()}.old-")), key=lambda p: fs.getFileStatus(p).getModificationTime())
    if aside:
        fs.rename(aside[-1], to)


def swap(spark: SparkSession, staged: str, live: str, keep_old: bool = False) -> None:
    """Put a staged directory in a live one's place; on failure the old one comes back.

    A crash between the two renames is mended by :func:`recover`, which readers and writers of
    the directory call first. Where readers must not wait, use a versioned table instead.
    """
    recover(spark, live)
    fs, s = _fs(spark, staged)
    _, to = _fs(spark, live)
    _, old = _fs(spark, f"{live}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(to)
    step("move aside")
    if had and not fs.rename(to, old):
        raise OSError(f"can't move {live} aside")
    step("move in")
    if not fs.rename(s, to):
        if had:
            fs.rename(old, to)
        raise OSError(f"can't publish {staged}")
    step("retire")
    if had and not keep_old:
        fs.delete(old, True)


# ---- versioned tables: a directory of versions and a pointer to the current one ----------


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file at once: readers see the old or the new text."""
    jvm = spark._jvm
    fs, beside = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    _, to = _fs(spark, path)
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(to), overwrite)


def _read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    fs, p = _fs(spark, path)
    return "\n".join(r["value"] for r in spark.read.text(fs.makeQualified(p).toString()).collect())


def current(spark: SparkSession, table: str) -> dict | None:
    """The pointer of a versioned table: its buckets' directories; None before the first version."""
    text = _read_text(spark, f"{table}/CURRENT")
    return None if text is None else json.loads(text)


def read_table(spark: SparkSession, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The current version (of some buckets, if asked)."""
    at = current(spark, table) or {"paths": {}}
    paths = [p for b, p in at["paths"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*(f"{table}/{p}" for p in paths)) if paths else spark.createDataFrame([], schema)


def write_buckets(df: DataFrame, table: str, touched: list[int], buckets: int) -> None:
    """A new version in which the touched buckets are ``df``'s (with a ``bucket`` column) and the others stay.

    Data first, then the pointer: a crash leaves the old version current, and what it wrote is
    garbage for :func:`vacuum`.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex[:12]}"
    step("write")
    df.write.partitionBy("bucket").parquet(f"{table}/{version}")
    at = current(spark, table) or {"buckets": buckets, "paths": {}}
    if at["buckets"] != buckets:
        raise ValueError(f"{table} has {at['buckets']} buckets")
    found = {b: f"{version}/bucket={b}" for b in touched if exists(spark, f"{table}/{version}/bucket={b}")}
    step("point")
    _write_text(spark, f"{table}/CURRENT", json.dumps({"buckets": buckets, "paths": {k: v for k, v in at["paths"].items() if int(k) not in touched} | {str(b): p for b, p in found.items()}}))


def vacuum(spark: SparkSession, table: str) -> None:
    """Delete what no bucket of the current version points to; readers of older versions must be done."""
    keep = set((current(spark, table) or {"paths": {}})["paths"].values())
    fs, p = _fs(spark, table)
    for v in (s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-")):
        for b in fs.listStatus(v):
            if f"{v.getName()}/{b.getPath().getName()}" not in keep:
                fs.delete(b.getPath(), True)
        if not list(fs.listStatus(v)):
            fs.delete(v, True)


def replace_table(df: DataFrame, path: str) -> int:
    """Write beside, count what is stored, then swap: readers see the old or the new table."""
    spark, staged = df.sparkSession, f"{path}.staged-{uuid.uuid4().hex[:8]}"
    recover(spark, path)
    df.write.parquet(staged)
    n = spark.read.parquet(staged).count()
    swap(spark, staged, path)
    return n


def compact(spark: SparkSession, base: str, delta: str, schema: str, expect: int | None = None, buckets: int = 4) -> int:
    """Base and delta become a new base without exact repeats; the delta is retired after the swap.

    The sources are read once and dealt to buckets of ids beside the base; each bucket is then
    deduplicated and marked on its own. A run that finds the work of one with the same sources
    (the manifest) goes on where that ended; other work is thrown away. Until the swap the old
    base stays as it is, after it the delta's rows are in the base already, so a run that ended
    anywhere can be run again.
    """
    from tidegauge.sources.landing import lake

    recover(spark, base)
    work = f"{base}.compaction"
    sources = json.dumps({"buckets": buckets, "files": sorted(f for p in (base, delta) if exists(spark, p) for f in spark.read.schema(schema).parquet(p).inputFiles())})
    fs, w = _fs(spark, work)
    if _read_text(spark, f"{work}/MANIFEST") != sources:
        fs.delete(w, True)
        fs.mkdirs(w)
        _write_text(spark, f"{work}/MANIFEST", sources)
    step("deal")
    if not exists(spark, f"{work}/dealt/_SUCCESS"):
        lake(spark, base, delta, schema).withColumn("bucket", bucket_of("recommendationid", buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{work}/dealt")
    for b in range(buckets):
        step(f"bucket {b}")
        if exists(spark, f"{work}/dealt/bucket={b}") and not exists(spark, f"{work}/done/{b}/_SUCCESS"):
            part = exact_versions(spark.read.schema(schema).parquet(f"{work}/dealt/bucket={b}"))
            part.write.mode("overwrite").option("maxRecordsPerFile", COMPACT_ROWS).parquet(f"{work}/done/{b}")
    done = [f"{work}/done/{b}" for b in range(buckets) if exists(spark, f"{work}/done/{b}/_SUCCESS")]
    n = spark.read.schema(schema).parquet(*done).count() if done else 0
    if expect is not None:
        assert_counts(expect, n)
    step("stage")
    staged = f"{work}/staged"
    _, s = _fs(spark, staged)
    fs.delete(s, True)
    fs.mkdirs(s)
    for b, path in enumerate(done):  # files of all buckets in one directory, by renames
        _, mark = _fs(spark, f"{path}/_SUCCESS")
        fs.delete(mark, False)  # first: a bucket whose files are on the move is written again after a crash
        step(f"move bucket {b}")
        _, d = _fs(spark, path)
        for f in [x.getPath() for x in fs.listStatus(d) if x.getPath().getName().startswith("part-")]:
            _, to = _fs(spark, f"{staged}/part-{b:05d}-{f.getName()[5:]}")
            fs.rename(f, to)
    _, mark = _fs(spark, f"{staged}/_SUCCESS")
    fs.create(mark, True).close()
    swap(spark, staged, base)
    step("drop delta")
    if exists(spark, delta):
        _, p = _fs(spark, delta)
        fs.delete(p, True)
    step("clean")
    fs.delete(w, True)
    return n


def write_shards(df: DataFrame, path: str) -> None:
    """JSON lines in one directory per value of ``shard``."""
    df.repartition("shard").write.partitionBy("shard").mode("overwrite").json(path)
