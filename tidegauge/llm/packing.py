"""Operator 10: best-fit packing of tokenised documents by large-item matching.

Only the number of pieces of each length matters for a packing, and there are at most
``capacity`` lengths. So one histogram goes to the driver, which packs lengths with
multiplicity: pieces above a third of the capacity go at most two to a bin, each matched
greedily with the largest other one that fits; smaller ones, longest first, go best-fit
into the remaining gaps. The plan is a list of runs "pieces rank a..b of length s, k to a
bin, from bin b on, at offset o"; a step ends a length or a group of bins, so it has a few
rows per length, whatever the corpus. Pieces then look their run up by their rank among
those of their length, which is a row number within salted groups plus the groups' offsets.

Defined results: null text is empty, so it is the end id alone; repeated rows are packed
each on its own (doc_id is carried, not used as a key, and may be null); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.shared import cut, in_arrow, slices, table
from tidegauge.llm.units import RankEncoder

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: Rows that a salted group of one length has at most, in the mean.
GROUP_ROWS = 500_000


class WholeEncoder(RankEncoder):
    """Ids of whole texts as the ``tokenizers`` library gives them, special strings included."""

    def __init__(self, path: str):
        super().__init__(path, public_tokenizers.PATTERN)

    def ids_of_all(self, texts: pa.Array) -> Iterator[bytes]:
        rows = self.rows(texts)
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        for k in range(len(texts)):
            yield rows.of_row(k) if rows.clean[k] and not special[k] else self.ids(texts[k].as_py() or "")

    def ids(self, text: str) -> bytes:
        for special, i in sorted(self.specials.items(), key=lambda x: -len(x[0])):
            if special in text:
                return np.array([i], "<u4").tobytes().join(map(self.ids, text.split(special)))
        return self.plain(text)


@functools.cache
def encoder(path: str) -> WholeEncoder:
    """One per Python worker."""
    return WholeEncoder(path)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the rest."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document with a row id that is unique in the run."""
    path = path or public_tokenizers.path(VOCABULARY)
    small = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    kind = small.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row = encoder(path), TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            owner, cols = [], ([], [], [], [], [], [])
            for k, raw in enumerate(of.ids_of_all(batch.column(1))):
                ids = memoryview(raw + end)
                for n, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    owner.append(k)
                    for col, x in zip(cols, (n, start, length, zlib.crc32(part), row, np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None), strict=True):
                        col.append(x)
                    row += 1
            piece, start, length, crc, rows, ids = cols
            arrays = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rows, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32", "row_id"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return in_arrow(small, run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row_id bigint" + ", ids array<int>" * keep_ids)


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, rank from, rank to, first bin, pieces per bin, offset), and the bins used."""
    left = {s: n for s, n in counts.items() if n > 0}
    ranks: dict[int, int] = defaultdict(int)
    runs, bins = [], 0
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: first bin, bins

    def put(size: int, n: int, first: int, per_bin: int, offset: int) -> None:
        runs.append((size, ranks[size], ranks[size] + n, first, per_bin, offset))
        ranks[size] += n
        left[size] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        for b in (b for b in large if b <= min(a, capacity - a)):
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n > 0:
                put(a, n, bins, 1, 0)
                put(b, n, bins, 1, a)
                groups[capacity - a - b].append((bins, n))
                bins += n
        if n := left[a]:
            put(a, n, bins, 1, 0)
            groups[capacity - a].append((bins, n))
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            fitting = [g for g, of in groups.items() if g >= s and of]
            if not fitting:
                n = -(-left[s] // (capacity // s))
                groups[capacity].append((bins, n))
                bins += n
                fitting = [capacity]
            gap = min(fitting)
            first, n = groups[gap].pop()
            per_bin = gap // s
            full = min(n, left[s] // per_bin)
            if full:
                put(s, full * per_bin, first, per_bin, capacity - gap)
                groups[gap - per_bin * s].append((first, full))
            rest = n - full
            if rest and 0 < left[s] < per_bin:
                few = left[s]
                put(s, few, first + full, few, capacity - gap)
                groups[gap - few * s].append((first + full, 1))
                full, rest = full + 1, rest - 1
            if rest:
                groups[gap].append((first + full, rest))
    return runs, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, row_id and more, as a written table) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan_bins(counts, capacity)
    salts = max(16, -(-sum(counts.values()) // GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_id"))).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    plan = spark.createDataFrame(runs, "p_length bigint, p_from bigint, p_to bigint, p_bin bigint, p_per_bin bigint, p_offset bigint")
    at = F.col("rank") - F.col("p_from")
    return (
        ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
        .withColumn("sequence_id", F.col("p_bin") + F.expr("(rank - p_from) div p_per_bin"))
        .withColumn("offset", F.col("p_offset") + (at % F.col("p_per_bin")) * F.col("length"))
        .select(*[c for c in pieces.columns if c != "row_id"], "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, if kept), sequence_id, offset per piece."""
    pieces = cut(tokenised_pieces(docs, id_col, text_col, capacity, end_id, path, keep_ids), "pieces")
    return pack(pieces, capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
