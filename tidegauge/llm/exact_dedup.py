"""Operator 7: exact dedup through counting quotient filters.

Every partition builds a counting quotient filter of its texts' 64-bit fingerprints: the
high bits (quotient) give a slot, the low bits (remainder) are kept there in sorted runs,
found again through the two bitmaps ``occupied`` and ``runend``; repeats add to a counter.
A filter is dealt out by blocks of the fingerprint's highest bits; the filters of a block
merge losslessly by their sorted remainders. Fingerprints with a merged count above one
route their texts to byte verification: grouping by the normalised text itself. A hot
text is one filter entry and one pre-aggregated row per partition. All other texts are
single, since equal texts have equal fingerprints.

Defined results: null text counts as empty, and empty texts are equal to each other and to
texts of white space only; a null id comes after all others in ties; of repeated rows
(same id, same text) one row is kept; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.shared import cut, in_arrow, new_names, release, table

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Fingerprints of one merged block in the mean, and of one filter before it is emitted.
BLOCK_ENTRIES, FLUSH_ENTRIES = 1 << 17, 1 << 22
#: Rows up to which a table of (fingerprint, digest, ...) is broadcast: about 100 MB in Spark.
BROADCAST_ROWS = 500_000


class CountingQuotientFilter:
    """Sorted distinct keys of ``bits`` bits with counts, in quotient-filter form."""

    FIELDS = "bits int, quotient_bits int, occupied binary, runend binary, remainders binary, many binary, counts binary"

    def __init__(self, bits, quotient_bits, occupied, runend, remainders, many, counts):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.runend, self.remainders, self.many, self.counts = occupied, runend, remainders, many, counts

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """keys: sorted distinct uint64 below 2**bits."""
        n = len(keys)
        q = min(bits - 1, max(1, int(np.ceil(np.log2(max(2, n) / 0.75)))))
        r = bits - q
        quotient = (keys >> np.uint64(r)).astype(np.int64)
        at = np.arange(n)
        slot = at + np.maximum.accumulate(quotient - at) if n else at  # linear probing of sorted runs
        last = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
        slots = int(slot[-1]) + 1 if n else 0
        occupied, runend = np.zeros(1 << q, bool), np.zeros(slots, bool)
        occupied[quotient] = True
        runend[slot[last]] = True
        wide = np.uint32 if r <= 32 else np.uint64
        remainders = np.zeros(slots, wide)
        remainders[slot] = (keys & np.uint64((1 << r) - 1)).astype(wide)
        more = counts > 1
        return cls(bits, q, np.packbits(occupied), np.packbits(runend), remainders, slot[more].astype(np.uint32), counts[more].astype(np.uint64))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys and their counts, from the slots."""
        r = self.bits - self.quotient_bits
        slots = len(self.remainders)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.quotient_bits))
        ends = np.flatnonzero(np.unpackbits(self.runend, count=slots))
        starts = np.maximum(quotients, np.append(-1, ends[:-1]) + 1)[:len(ends)]
        sizes = ends - starts + 1
        slot = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1])[:len(sizes)], sizes) + np.arange(int(sizes.sum()))
        keys = (np.repeat(quotients, sizes).astype(np.uint64) << np.uint64(r)) | self.remainders[slot].astype(np.uint64)
        counts = np.ones(slots, np.uint64)
        counts[self.many] = self.counts
        return keys, counts[slot]

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        keys, counts = merged(*zip(*(f.entries() for f in filters), strict=True))
        return cls.build(keys, counts, filters[0].bits)

    def pack(self) -> tuple:
        return (self.bits, self.quotient_bits, *(x.tobytes() for x in (self.occupied, self.runend, self.remainders, self.many, self.counts)))

    @classmethod
    def unpack(cls, bits, quotient_bits, occupied, runend, remainders, many, counts) -> CountingQuotientFilter:
        wide = np.uint32 if bits - quotient_bits <= 32 else np.uint64
        return cls(bits, quotient_bits, np.frombuffer(occupied, np.uint8), np.frombuffer(runend, np.uint8), np.frombuffer(remainders, wide), np.frombuffer(many, np.uint32), np.frombuffer(counts, np.uint64))


def merged(keys: tuple[np.ndarray, ...], counts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of keys as one, with the counts of equal keys added."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(all_keys) else np.zeros(0, np.int64)
    return all_keys[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def partition_filters(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """Filters of each partition of one bigint column, one row per block."""
    bits = 64 - block_bits

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        blocks = (keys >> np.uint64(bits)).astype(np.int64) if block_bits else np.zeros(len(keys), np.int64)
        low = keys & np.uint64((1 << bits) - 1)
        edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        rows = [(int(blocks[a]), *CountingQuotientFilter.build(low[a:b], counts[a:b], bits).pack()) for a, b in zip(edges, np.append(edges[1:], len(keys)), strict=True)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", *(f.split()[0] for f in CountingQuotientFilter.FIELDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                n += batch.num_rows
            if n >= FLUSH_ENTRIES:
                yield emit(parts)
                parts, n = [], 0
        if n:
            yield emit(parts)

    return in_arrow(fingerprints, run, f"block bigint, {CountingQuotientFilter.FIELDS}")


def repeated_fingerprints(filters: DataFrame) -> DataFrame:
    """fp, fp_count of merged counts above one."""

    def run(block: pa.Table) -> pa.Table:
        rows = block.drop_columns(["block"]).to_pylist()
        one = CountingQuotientFilter.merge([CountingQuotientFilter.unpack(*r.values()) for r in rows])
        keys, counts = one.entries()
        high = np.uint64(block.column("block")[0].as_py() << one.bits if one.bits < 64 else 0)
        more = counts > 1
        return pa.table({"fp": (keys[more] | high).view(np.int64), "fp_count": counts[more].astype(np.int64)})

    return filters.groupBy("block").applyInArrow(run, "fp bigint, fp_count bigint")


def fingerprint(text: F.Column) -> F.Column:
    return F.xxhash64(text)


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _order(chars: F.Column, doc_id: F.Column) -> F.Column:
    """One number: more characters first, then the smaller id, then null ids."""
    low = F.coalesce(F.expr("9223372036854775808BD") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return (chars.cast("decimal(10,0)") * F.lit("36893488147419103232").cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _id_of(order: F.Column) -> F.Column:
    low = order % F.lit("36893488147419103232").cast("decimal(20,0)")
    return F.when(low > 0, (F.expr("9223372036854775808BD") - low).cast("bigint"))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast where ``rows`` is small enough, else Spark's own choice (a skew-split join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_mark(text: F.Column) -> F.Column:
    """A text's name among rows of one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, as a written table: id, keep_id, group_size, kept, text_sha256 (and n_chars, mark)."""
    small = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    norm = normalised(F.col("text"))
    rows = cut(
        small.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), text_mark(F.col("text")).alias("mark"), norm.alias("norm"))
        .select("doc_id", "n_chars", "mark", fingerprint(F.col("norm")).alias("fp"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row_id")),
        "digests",
    )
    n = rows.count()
    block_bits = max(0, int(np.ceil(np.log2(max(1, n) / BLOCK_ENTRIES))))
    repeats = cut(repeated_fingerprints(partition_filters(rows.select("fp"), block_bits)).select("fp"), "repeats", n // 2)

    suspects = small.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), norm.alias("norm")).withColumn("fp", fingerprint(F.col("norm"))).join(bounded_broadcast(repeats, repeats.count()), "fp", "left_semi")
    verified = (
        suspects.groupBy("fp", "norm").agg(F.count("*").alias("group_size"), F.max(_order(F.col("n_chars"), F.col("doc_id"))).alias("best"))
        .filter("group_size > 1")
        .select("fp", F.sha2("norm", 256).alias("text_sha256"), "group_size", "best")
    )
    verified = cut(verified, "verified", n // 2)
    release(repeats)
    n_groups = verified.count()
    key = ["fp", "text_sha256"]
    best = rows.join(bounded_broadcast(verified, n_groups), key).filter(_order(F.col("n_chars"), F.col("doc_id")) == F.col("best")).groupBy(*key).agg(F.min("row_id").alias("best_row"))
    groups = verified.join(best, key).select(*key, "group_size", _id_of(F.col("best")).alias("best_id"), "best_row")
    out = cut(rows.join(bounded_broadcast(groups, n_groups), key, "left").select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("best_row").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("best_row").isNull() | (F.col("best_row") == F.col("row_id"))).alias("kept"),
        "text_sha256",
        "n_chars",
        "mark",
    ), "exact")
    release(rows)
    release(verified)
    return out


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops, all columns.

    Of rows with the same id and text, as many stay as are kept there: one at most. Names of
    columns that the operator adds are new ones, so columns of any name pass through.
    """
    groups = exact_groups(docs, id_col, text_col)
    fate = groups.filter("group_size > 1").groupBy(id_col, "mark").agg(F.max(F.col("kept").cast("int")).alias("stays"), F.count("*").alias("rows"))
    fate = cut(fate.filter("stays = 0 or rows > 1"), "fates", groups.count())
    release(groups)
    id_, mark, of_id, of_mark, stays, place = new_names(docs.columns, 6)
    fate = bounded_broadcast(fate.select(F.col(id_col).alias(of_id), F.col("mark").alias(of_mark), F.col("stays").alias(stays)), fate.count())
    named = docs.select("*", F.col(f"`{id_col}`").cast("bigint").alias(id_), text_mark(F.col(f"`{text_col}`")).alias(mark))
    marked = named.join(fate, F.col(id_).eqNullSafe(F.col(of_id)) & (F.col(mark) == F.col(of_mark)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = Window.partitionBy(id_, mark).orderBy(F.lit(0))
    repeated = marked.filter(F.col(stays) == 1).withColumn(place, F.row_number().over(once)).filter(F.col(place) == 1)
    return marked.filter(F.col(stays).isNull()).select(*columns).unionByName(repeated.select(*columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chars", "mark")


OP7_SQL = r"""
with d as (
    select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents
)
select doc_id,
       first_value(doc_id) over g as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over g = 1 as kept,
       sha256(norm) as text_sha256
from d
window g as (partition by norm order by length(t) desc, doc_id asc nulls last)
"""
