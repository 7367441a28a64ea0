"""Similar cases: filters first, then exact nearest neighbours, then assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.rates import outcome, similarity_score
from tidegauge.functions.vectors import dot, norm, normalised
from tidegauge.operators.versions import latest

#: Query vectors of a block, about: each block is broadcast.
MAX_QUERIES = 1000


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """The k nearest candidates (id, vector) of each query slot (slot, vector) by cosine.

    Slots beyond MAX_QUERIES are searched in blocks, dealt by a hash of the slot. Vectors
    without length are left out; ties go to the smaller id.
    """
    blocks = -(-queries.count() // MAX_QUERIES)
    if blocks <= 1:
        return _nearest(candidates, queries, k)
    dealt = queries.withColumn("__block", F.pmod(F.xxhash64("slot"), F.lit(blocks)))
    return reduce(DataFrame.unionByName, (_nearest(candidates, dealt.filter(F.col("__block") == b), k) for b in range(blocks)))


def _nearest(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    q = queries.filter(norm(F.col("vector")) > 0).select("slot", normalised(F.col("vector")).alias("qv"))
    units = candidates.filter(norm(F.col("vector")) > 0).withColumn("vector", normalised(F.col("vector")))
    scored = units.join(F.broadcast(q), F.size("vector") == F.size("qv")).withColumn("cosine", dot(F.col("vector"), F.col("qv")))
    w = Window.partitionBy("slot").orderBy(F.desc("cosine"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("vector", "qv")


def best_per_patch(hits: DataFrame) -> DataFrame:
    """One row per patch: its nearest chunk over all slots."""
    return latest(hits, ["gid"], [F.desc("cosine"), F.asc("id")])


def with_qualifying_change(chunks: DataFrame, changes: DataFrame, change_type: str, direction: str | None = None, statuses: tuple[str, ...] = ("valid", "needs_review")) -> DataFrame:
    """Chunks with a change of the type, and of the direction if one is asked for."""
    ok = (F.col("change_type") == change_type) & F.col("validation_status").isin(*statuses)
    if direction:
        ok = ok & (F.col("direction") == direction)
    return chunks.join(changes.filter(ok).select("id").distinct(), "id", "left_semi")


def outcomes(cases: DataFrame, margin: float = 3.0) -> DataFrame:
    """Cases with outcome group and 0..100 similarity, in reading order."""
    return cases.withColumn("outcome", outcome(F.col("delta_pct"), margin)).withColumn("similarity", similarity_score(F.col("cosine")))


def patterns(cases: DataFrame, least: int = 20) -> DataFrame:
    """Per outcome: share of cases with several kinds, the modal target and direction.

    cases: outcome, kinds, targets, directions (arrays). Ties go to the alphabetically first.
    Groups of fewer than ``least`` cases give no row.
    """
    def modal(column: str) -> DataFrame:
        counted = cases.select("outcome", F.explode(F.array_distinct(column)).alias(column)).groupBy("outcome", column).agg(F.count("*").alias("n"))
        return latest(counted, ["outcome"], [F.desc("n"), F.asc(column)]).select("outcome", F.col(column).alias(f"modal_{column}"))

    base = cases.groupBy("outcome").agg(F.count("*").alias("cases"), F.avg((F.size(F.array_distinct("kinds")) > 1).cast("double")).alias("multi_share")).filter(F.col("cases") >= least)
    return base.join(modal("targets"), "outcome", "left").join(modal("directions"), "outcome", "left").withColumn("mostly_multi", F.col("multi_share") >= 0.5)


def set_parts(a: Column, b: Column) -> list[Column]:
    """shared, only_a, only_b: sorted distinct."""
    return [F.array_sort(F.array_distinct(F.array_intersect(a, b))).alias("shared"), F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b")]


def matched_first(matched: Column, texts: Column, size: int = 200) -> Column:
    """Matched texts before the others, else in their order; at most ``size``."""
    pairs = F.zip_with(matched, texts, lambda m, t: F.struct(m.alias("m"), t.alias("t")))
    front, back = F.filter(pairs, lambda x: x["m"]), F.filter(pairs, lambda x: ~x["m"])
    return F.slice(F.transform(F.concat(front, back), lambda x: x["t"]), 1, size)


def compare(plan: dict, cases: DataFrame) -> DataFrame:
    """How each case differs from a plan: direction, size, extra kinds, genres (three each at most)."""
    genres, kinds = (F.array(*map(F.lit, plan[k])) if plan[k] else F.array().cast("array<string>") for k in ("genres", "kinds"))
    return cases.select(
        "gid",
        (F.col("direction") == plan["direction"]).alias("same_direction"),
        (F.col("target_type") == plan["target_type"]).alias("same_target"),
        F.slice(F.array_sort(F.array_intersect("genres", genres)), 1, 3).alias("shared_genres"),
        F.slice(F.array_sort(F.array_except("genres", genres)), 1, 3).alias("other_genres"),
        F.slice(F.array_sort(F.array_except("kinds", kinds)), 1, 3).alias("simultaneous"),
    )


def best_pair(plan_slots: DataFrame, changes: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Per case the (slot, change) pair of the highest weighted equality; the first pair wins ties."""
    score = sum((F.when(F.col(f"p_{c}") == F.col(c), F.lit(w)).otherwise(0) for c, w in weights.items()), F.lit(0))
    slots = plan_slots.select(F.col("slot").alias("slot"), *(F.col(c).alias(f"p_{c}") for c in weights))
    pairs = changes.crossJoin(F.broadcast(slots) if slots.count() <= MAX_QUERIES else slots).withColumn("score", score)
    return latest(pairs, ["gid"], [F.desc("score"), F.asc("slot"), F.asc("change_seq")]).select("gid", "slot", "change_seq", "score")
