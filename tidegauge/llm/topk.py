"""Operator 9: exact top-k by tiled matrix products.

Vectors are dealt by a hash of their id into shards, queries into blocks; each shard and
each block is one row holding a matrix. A tile is one block with one shard: a matrix
product, then a partial selection of k candidates per query. The lists of a query merge in
a tree, a fixed number of shards at a time, so no step gathers more than a bounded number
of lists in a task. Scores are exact: products run in doubles where no sum can reach 2**53,
else in 64-bit integers.

Defined results: vectors that are null, or hold null or non-finite components, take no
part, nor do null ids; vectors are compared only with vectors of the same length (empty
ones score 0); rows that repeat an id count once, with the smallest vector; ties go to the
smaller id; fewer than k candidates give all; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.shared import cut, table

SHARD_ROWS, BLOCK_ROWS = 8192, 1024
#: Queries of a block that are scored at once: bounds a score tile to 8 MB.
STRIP_ROWS = 128
FAN_IN = 32
SCALE = 256


def scaled_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors that take part."""
    x = F.col("v0")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v0"))
        .filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)))
        .select("vec_id", F.transform(x, lambda c: F.floor(c * float(scale)).cast("bigint")).alias("v"))
    )


def matrices(vectors: DataFrame, parts: int, name: str) -> DataFrame:
    """One row per (part, vector length): ids ascending and their matrix."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        dim = group.column("dim")[0].as_py()
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        mat = np.ascontiguousarray(flat, dtype=np.int64).reshape(len(ids), dim)
        order = np.lexsort([*mat.T[::-1], ids])
        ids, mat = ids[order], mat[order]
        first = np.append(True, ids[1:] != ids[:-1])
        ids, mat = ids[first], mat[first]
        top = int(np.abs(mat).max()) if mat.size else 0
        kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
        return pa.table({name: pa.array([group.column("part")[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), f"{name}_ids": [ids.astype(np.int64).tobytes()], f"{name}_kind": [np.dtype(kind).str], f"{name}_mat": [mat.astype(kind).tobytes()]})

    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.size("v").alias("dim"), "vec_id", "v")
    return dealt.groupBy("part", "dim").applyInArrow(run, f"{name} bigint, dim int, {name}_ids binary, {name}_kind string, {name}_mat binary")


def tile_top(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best; cids ascend."""
    n = len(cids)
    top = (float(np.abs(q).max()) if q.size else 0.0) * (float(np.abs(c).max()) if c.size else 0.0) * q.shape[1]
    wide = np.float64 if top < 2.0**53 else np.int64
    ct, out = c.astype(wide).T, []
    for a in range(0, len(qids), STRIP_ROWS):
        score = (q[a:a + STRIP_ROWS].astype(wide) @ ct).astype(np.int64)
        at = np.minimum(np.searchsorted(cids, qids[a:a + STRIP_ROWS]), n - 1)
        own = cids[at] == qids[a:a + STRIP_ROWS]
        if top * n < 2.0**61:
            key = score * n + (n - 1 - np.arange(n))  # distinct: ties to the smaller id
            key[np.flatnonzero(own), at[own]] = np.iinfo(np.int64).min
            best = np.argpartition(key, n - k, axis=1)[:, n - k:] if n > k else np.broadcast_to(np.arange(n), key.shape)
        else:
            best = np.stack([np.lexsort([np.arange(n), -s.astype(object) if top >= 2.0**63 else -s])[:k + 1] for s in score])
        row = np.repeat(np.arange(len(score)), best.shape[1])
        col = best.ravel()
        keep = ~(own[row] & (col == at[row]))
        out.append((row[keep] + a, col[keep], score[row[keep], col[keep]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_lists(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact_top_k(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, itself left out."""
    c, q = scaled_vectors(candidates, id_col, vec_col, scale), scaled_vectors(queries, id_col, vec_col, scale)
    n_shards, n_blocks = max(1, -(-candidates.count() // SHARD_ROWS)), max(1, -(-q.count() // BLOCK_ROWS))
    shards = cut(matrices(c, n_shards, "shard"), "shards")
    blocks = matrices(q, n_blocks, "block").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint"))))
    tiles = blocks.join(shards, ["shard", "dim"]).select("shard", "dim", *(f"{n}_{f}" for n in ("block", "shard") for f in ("ids", "kind", "mat")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qids, cids = np.frombuffer(r["block_ids"], np.int64), np.frombuffer(r["shard_ids"], np.int64)
                mats = [np.frombuffer(r[f"{n}_mat"], r[f"{n}_kind"]).reshape(len(ids), r["dim"]) for n, ids in (("block", qids), ("shard", cids))]
                row, col, score = tile_top(qids, mats[0], cids, mats[1], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), r["shard"])), pa.array(qids[row]), pa.array(cids[col]), pa.array(score)], names=["part", "query_id", "vec_id", "score"])

    lists = tiles.mapInArrow(run, "part bigint, query_id bigint, vec_id bigint, score bigint")
    while n_shards > FAN_IN:
        lists = top_lists(lists.withColumn("part", F.expr(f"part div {FAN_IN}")), ["query_id", "part"], k).drop("rank")
        n_shards = -(-n_shards // FAN_IN)
    return top_lists(lists, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP9_SQL = """
with x as (
    select vec_id, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
), s as (
    select q.vec_id query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) score
    from x q join x c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
