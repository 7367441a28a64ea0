"""Whole answers of the read side: trends, playtime analysis, case search, and what they join.

Every function takes and returns DataFrames (or Columns) and stays one lazy plan.
"""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.rates import outcome, percent1, similarity_score
from tidegauge.operators.serving import MIN_SAMPLE
from tidegauge.operators.versions import latest

#: Rows up to which a code or key table is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast of a counted table, if it is short enough; else Spark's own choice."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


# ---- keys and lookups ------------------------------------------------------------------


def without_rows(rows: DataFrame, bad: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among the bad ones; null key parts equal each other."""
    other = bad.select(*(F.col(c).alias(f"bad_{c}") for c in key)).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"bad_{c}"))
    return rows.join(other, same, "left_anti")


def with_surrogate(rows: DataFrame, ids: DataFrame, key: list[str], surrogate: str) -> DataFrame:
    """Rows with the surrogate key of their natural one, and without that; rows unknown to ``ids`` go.

    A natural key that stands for several surrogates takes the least.
    """
    one = ids.groupBy(*key).agg(F.min(surrogate).alias(surrogate))
    return rows.join(one, key).select(surrogate, *(c for c in rows.columns if c not in key))


def by_model(changes: DataFrame, chunks: DataFrame, prefix: str) -> DataFrame:
    """Changes of chunks whose model version, the row's or else the chunk's, starts with a prefix (case aside)."""
    info = chunks.select("gid", "seq", F.col("model_version").alias("chunk_version"))
    version = F.coalesce("model_version", "chunk_version")
    return changes.join(info, ["gid", "seq"]).withColumn("version", version).filter(F.lower("version").startswith(prefix.lower())).drop("chunk_version", "model_version")


def in_any_band(reviews: DataFrame, bands: DataFrame, selected: list[int] | None = None) -> DataFrame:
    """Reviews whose playtime is in one of the game's bands, or in one of the selected."""
    own = bands.select(F.col("appid").alias("b_appid"), "band_no", "playtime_from", "playtime_to")
    if selected is not None:
        own = own.filter(F.col("band_no").isin(selected))
    inside = (F.col("appid") == F.col("b_appid")) & (F.col("playtime") >= F.col("playtime_from")) & (F.col("playtime_to").isNull() | (F.col("playtime") < F.col("playtime_to")))
    return reviews.join(own, inside, "left_semi")


def complete_patches(notices: DataFrame, stats: DataFrame, genres: DataFrame | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Notices that are patches, have counts on both sides, and (if asked) a game of a wanted genre."""
    full = stats.filter("before_count > 0 and after_count > 0").select("gid")
    out = notices.filter("is_patch").join(full, "gid", "left_semi")
    return out if not wanted else out.join(genres.filter(F.col("genre").isin(wanted)).select("appid").distinct(), "appid", "left_semi")


def patch_details(notices: DataFrame, games: DataFrame, stats: DataFrame, cycles: DataFrame) -> DataFrame:
    """A row per patch with its game's title, its statistics and its place in the game's cycle."""
    return notices.join(stats.drop("appid"), "gid").join(cycles.drop("appid"), "gid").join(games.select("appid", F.col("title").alias("game_title")), "appid")


def copied_children(children: DataFrame, parents: DataFrame, old: str, new: str) -> DataFrame:
    """Children of one search's parents for the parents of another with the same order."""
    a = parents.filter(F.col("search") == old).select(F.col("parent_id").alias("from_id"), "entity_order")
    b = parents.filter(F.col("search") == new).select(F.col("parent_id").alias("to_id"), "entity_order")
    pairs = a.join(b, "entity_order").select("from_id", "to_id")
    return children.join(pairs, children["parent_id"] == pairs["from_id"]).select(F.col("to_id").alias("parent_id"), *(c for c in children.columns if c != "parent_id"))


def with_rank(rows: DataFrame, ranks: DataFrame, key: str, missing: int = 10**9) -> DataFrame:
    """``rank``, a large one for rows that the ranking doesn't know."""
    return rows.join(ranks.select(key, "rank"), key, "left").withColumn("rank", F.coalesce("rank", F.lit(missing)).cast("bigint"))


def equals_if_given(column: str, wanted) -> Column:
    """An optional parameter: true where none is given."""
    return F.lit(True) if wanted is None else F.coalesce(F.col(column) == F.lit(wanted), F.lit(False))


def since_or_unknown(at: str, since: int) -> Column:
    """Rows from a time on, and those without one."""
    return F.col(at).isNull() | (F.col(at) >= since)


def shaped(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Columns with a default of '' and at most so many characters (code points)."""
    return rows.select(*(F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(widths[c])).alias(c) if c in widths else F.col(c) for c in rows.columns))


def appended(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Target and the new rows with keys of their own: a key on both sides is left alone, one twice in ``new`` comes once."""
    return target.unionByName(new.join(target.select(*key), key, "left_anti").dropDuplicates(key))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both runs, each with its ``side``."""
    return before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after")))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with repeats: none where the tables are equal."""
    return compared(a.exceptAll(b), b.exceptAll(a))


def status_counts(steps: DataFrame) -> DataFrame:
    """Runs of each step and status, and over all steps the distinct names ever run."""
    names = steps.agg(F.countDistinct("step").alias("steps_ever"))
    return steps.groupBy("step", "status").agg(F.count("*").alias("n")).crossJoin(F.broadcast(names))  # one row


def judgement_preview(judged: DataFrame) -> DataFrame:
    """Notices per decision and scope."""
    return judged.groupBy("decision", "scope").agg(F.count("*").alias("n"))


def chunk_sets(changes: DataFrame) -> DataFrame:
    """Per chunk the sorted sets of directions, kinds and targets, and the quote of its first change."""
    sets = [F.array_sort(F.collect_set(c)).alias(name) for c, name in (("direction", "directions"), ("change_type", "kinds"), ("target_type", "targets"))]
    return changes.groupBy("gid", "seq").agg(*sets, F.min_by("quote", "change_seq").alias("first_quote"))


# ---- text rows -------------------------------------------------------------------------


def input_text(game: Column, heading: Column, text: Column) -> Column:
    """The text that a model reads of a chunk: game and heading in the first line, if there are any."""
    head = F.concat_ws(" | ", F.nullif(F.trim(game), F.lit("")), F.nullif(F.trim(heading), F.lit("")))
    return F.when(head != "", F.concat(head, F.lit("\n\n"), text)).otherwise(text)


def split_text(whole: Column) -> Column:
    """struct(head, text): the inverse of :func:`input_text`; no head where there is no blank line."""
    at = F.instr(whole, "\n\n")
    return F.struct(F.when(at > 0, F.left(whole, at - 1)).otherwise(F.lit("")).alias("head"), F.when(at > 0, F.substr(whole, at + 2)).otherwise(whole).alias("text"))


def chunk_rows(chunks: DataFrame, least: int = 20) -> DataFrame:
    """``status`` of each chunk: skipped (too short), duplicate (the game's chunk with that text came first) or pending."""
    norm = F.lower(F.trim(F.regexp_replace("chunk", r"\s+", " ")))
    w = Window.partitionBy("appid", "norm_text").orderBy("gid", "seq")
    first = chunks.withColumn("norm_text", norm).withColumn("nth", F.row_number().over(w))
    status = F.when(F.length("norm_text") < least, "skipped").when(F.col("nth") > 1, "duplicate").otherwise("pending")
    return first.withColumn("status", status).drop("norm_text", "nth")


def action_slots(action: Column, before: Column, after: Column) -> list[Column]:
    """change_type and direction of a model's action; numbers decide where it only says "change"."""
    kind = F.when(action.isin("add", "remove", "fix", "deprecate"), action).when(action.isNotNull(), "modify")
    way = F.when(action.isin("increase", "decrease"), action).when(action.isin("add", "remove", "fix", "deprecate"), "not_applicable").when(after > before, "increase").when(after < before, "decrease").when(after == before, "none").otherwise("unknown")
    return [kind.alias("change_type"), F.when(action.isNotNull(), way).alias("direction")]


def round_half_even(value: Column, digits: int = 1) -> Column:
    """Half-way values to the even digit."""
    return F.bround(value, digits)


# ---- answers ---------------------------------------------------------------------------


def reaction_trend(days: DataFrame, patches: DataFrame, first: str, last: str) -> DataFrame:
    """Every game on every day of a closed period: counts, rates per channel (null without reviews),
    the day's patches and the game's available period."""
    games = days.groupBy("appid").agg(F.min("stat_date").alias("available_from"), F.max("stat_date").alias("available_to"))
    grid = games.withColumn("stat_date", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    on_day = patches.groupBy("appid", F.col("patch_date").alias("stat_date")).agg(F.array_sort(F.collect_list("gid")).alias("patches"))
    out = grid.join(days, ["appid", "stat_date"], "left").join(on_day, ["appid", "stat_date"], "left")
    good = F.col("new_positive_count") + F.col("edited_positive_count")
    return out.select(
        "appid", "stat_date", F.coalesce("review_count", F.lit(0)).alias("reviews"), percent1(good, F.col("review_count")).alias("rate"), percent1(F.col("new_positive_count"), F.col("new_review_count")).alias("new_rate"),
        percent1(F.col("edited_positive_count"), F.col("edited_review_count")).alias("edited_rate"), F.coalesce("patches", F.array().cast("array<bigint>")).alias("patches"), "available_from", "available_to",
    )


def topic_rates(grid: DataFrame, counts: DataFrame) -> DataFrame:
    """Per game and topic: every band's mention rate, the rate over all bands, their difference, and
    the band of the highest rate (ties to the lower; bands without reviews don't count).

    Rates are null where a game has under MIN_SAMPLE reviews in all, or a band none.
    """
    rows = grid.join(counts.select("appid", "band_no", "review_count"), ["appid", "band_no"])
    w = Window.partitionBy("appid", "topic_id")
    total, mentions = F.sum("review_count").over(w), F.sum("mentions").over(w)
    rate = F.when((total >= MIN_SAMPLE) & (F.col("review_count") > 0), F.col("mentions") / F.col("review_count"))
    overall = F.when(total >= MIN_SAMPLE, mentions / total)
    rated = rows.withColumn("rate", rate).withColumn("overall", overall)
    best = latest(rated.filter("rate is not null"), ["appid", "topic_id"], [F.desc("rate"), F.asc("band_no")]).select("appid", "topic_id", F.col("band_no").alias("highest_band"))
    return rated.join(best, ["appid", "topic_id"], "left").select("appid", "topic_id", "band_no", "mentions", "review_count", "rate", "overall", (F.col("rate") - F.col("overall")).alias("delta"), "highest_band")


def playtime_analysis(counts: DataFrame) -> DataFrame:
    """Per game its bands and all of them (band_no 0): reviews, positive rate, and whether the sample is enough.

    counts: appid, band_no (null for all), review_count, positive_count. A game with under
    MIN_SAMPLE reviews falls back to the row over all bands, without a rate.
    """
    whole = F.max(F.when(F.col("band_no").isNull(), F.col("review_count"))).over(Window.partitionBy("appid"))
    rows = counts.withColumn("enough", whole >= MIN_SAMPLE).filter("enough or band_no is null")
    return rows.select("appid", F.coalesce("band_no", F.lit(0)).alias("band_no"), "review_count", F.when(F.col("enough"), percent1(F.col("positive_count"), F.col("review_count"))).alias("positive_rate"), "enough")


CASE_ORDERS = ("similarity", "recent", "improved", "worsened")


def case_order(name: str) -> list[Column]:
    """One of CASE_ORDERS; ties by cosine, then the smaller gid."""
    first = {"similarity": lambda: F.desc("similarity"), "recent": lambda: F.col("published_ts").desc_nulls_last(), "improved": lambda: F.col("delta_pct").desc_nulls_last(), "worsened": lambda: F.col("delta_pct").asc_nulls_last()}[name]()
    return [first, F.desc("cosine"), F.asc("gid")]


def case_answer(hits: DataFrame, stats: DataFrame, notices: DataFrame, order: str = "similarity", batch: int = 60, margin: float = 3.0) -> DataFrame:
    """Cases in order with outcome group, place in the group, and the batch of cards that a group's place is in.

    hits: gid and cosine of each patch's nearest chunk. Groups are numbered apart, so that each
    can be paged alone.
    """
    joined = hits.join(stats.select("gid", "delta_pct"), "gid").join(notices.select("gid", "published_ts"), "gid")
    scored = joined.withColumn("outcome", outcome(F.col("delta_pct"), margin)).withColumn("similarity", similarity_score(F.col("cosine"))).filter("outcome is not null")
    place = F.row_number().over(Window.partitionBy("outcome").orderBy(*case_order(order)))
    return scored.withColumn("place", place).withColumn("batch", F.floor((F.col("place") - 1) / batch).cast("int"))


def compared_sizes(plan_before: float, plan_after: float, before: Column, after: Column) -> Column:
    """larger, smaller or similar (within a quarter): a case's relative change against a plan's; null without numbers."""
    own = abs(plan_after - plan_before) / abs(plan_before) if plan_before else None
    if not own:
        return F.lit(None).cast("string")
    theirs = F.when(before != 0, F.abs(after - before) / F.abs(before))
    return F.when(theirs > 1.25 * own, "larger").when(theirs < 0.75 * own, "smaller").when(theirs.isNotNull(), "similar")


def card_line(kinds: Column, target: Column, delta: Column) -> Column:
    """One line of a case's card."""
    what = F.concat_ws(", ", F.slice(F.array_sort(F.array_distinct(kinds)), 1, 3))
    way = F.when(delta > 0, F.concat(F.lit("up "), F.format_number(delta, 1))).when(delta < 0, F.concat(F.lit("down "), F.format_number(-delta, 1))).when(delta == 0, "unchanged").otherwise("no figures")
    return F.concat_ws(" | ", F.nullif(what, F.lit("")), F.coalesce(target, F.lit("unknown")), way)


def _scope_mark(scope: dict) -> str:
    return hashlib.sha256(json.dumps(scope, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cursor(values: dict, scope: dict) -> str:
    """An opaque page cursor that only fits the filters and order that it was made for."""
    return base64.urlsafe_b64encode(json.dumps({"v": values, "s": _scope_mark(scope)}, sort_keys=True, default=str).encode()).decode()


def read_cursor(text: str, scope: dict) -> dict:
    """The values of a cursor; raises ValueError on one that is damaged or of another scope."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text.encode()))
        values, mark = found["v"], found["s"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if mark != _scope_mark(scope):
        raise ValueError("the cursor is of other filters")
    return values
