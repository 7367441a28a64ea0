"""Lineage cuts in the cluster's shared folder, and small Arrow helpers."""

from __future__ import annotations

import ctypes
import itertools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows of a text batch that Python holds as objects at once.
SLICE_ROWS, SLICE_BYTES = 4096, 4_000_000
#: Rows of a file of a thin table whose size is known: 10 to 20 MB.
FILE_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local-mode session gets a temporary folder; on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut", rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there.

    rows: at most so many rows of a few numbers, which go to files of about FILE_ROWS; else
    every task writes its own file.
    """
    bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df if rows is None else df.repartition(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


#: Bounds of what the JVM and a Python worker hold of a table at once, where a session sets none:
#: rows may be long texts, so bytes bound a batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def bound_batches(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def new_names(columns: list[str], n: int) -> list[str]:
    """Column names that clash with none of ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    return list(itertools.islice((x for k in itertools.count() if (x := f"own_{k}") not in taken), n))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of Arrow batches with about ``size`` bytes of the column ``text`` at most."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            upto = min(max(upto, at + 1), at + rows)
            yield batch.slice(at, upto - at)
            at = min(upto, batch.num_rows)
    trim()


def trim() -> None:
    """Give freed memory back at a task's end: workers live on, and stages differ in their needs."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
