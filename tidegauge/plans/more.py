"""Queries over lookups, checks, text rows and whole answers, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rates, texts, times, vectors
from tidegauge.operators import aggregates as agg
from tidegauge.operators import checks, notices, responses, search, serving, topics, trends, versions
from tidegauge.plans.fixtures import COVERAGE_END, COVERAGE_START, RUN_AT, Tables, with_
from tidegauge.plans.queries import DIRTY_SQL, PATCH_SQL, _dirty, query

# ---- validity --------------------------------------------------------------------------


@query("with x as (select o_orderkey, case o_orderkey % 6 when 0 then null when 1 then ' en' when 2 then '' when 3 then repeat('x', 21) when 4 then 'korean' else '  ' end code from orders) select o_orderkey from x where code is null or length(trim(code)) = 0 or length(code) > 20 or trim(code) <> code")
def invalid_languages(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    code = F.when(k == 1, " en").when(k == 2, "").when(k == 3, "x" * 21).when(k == 4, "korean").when(k == 5, "  ")
    return t.raw("orders").select("o_orderkey", code.alias("code")).filter(checks.invalid_language(F.col("code"))).select("o_orderkey")


@query("select vec_id from embeddings where vec_id % 11 = 0 or vec_id % 13 = 0 or (vec_id % 7 = 0 and len(embedding) <> 0)")
def invalid_chunks(t: Tables) -> DataFrame:
    """Chunks without a key, with a blank text, or with a vector of the wrong size."""
    v = F.col("vec_id")
    dim = F.when(v % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    chunks = t.raw("embeddings").select("vec_id", F.when(v % 11 != 0, v).alias("gid"), F.lit(1).alias("seq"), F.when(v % 13 == 0, " ").otherwise("text").alias("text"), dim.alias("embedding"))
    size = t.raw("embeddings").select(F.size("embedding").alias("n")).first()["n"]
    return chunks.filter(checks.invalid_chunk(size)).select("vec_id")


@query("with x as (select event_id, user_id % 12 appid, case when event_id % 9 <> 1 then user_id end rid, case when event_id % 10 <> 2 then event_id end ts, event_id % 5 - 1 topic from events) select event_id from x where coalesce(appid <= 0 or rid <= 0 or topic <= 0, true) or ts is null")
def invalid_topics(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.raw("events").select("event_id", (F.col("user_id") % 12).alias("appid"), F.when(e % 9 != 1, F.col("user_id")).alias("recommendationid"), F.when(e % 10 != 2, e).alias("updated_ts"), (e % 5 - 1).alias("topic_id"))
    return rows.filter(checks.invalid_topic()).select("event_id")


@query(DIRTY_SQL + " select event_id from dirty where coalesce(recommendationid <= 0 or appid <= 0 or updated_ts < created_ts, true) or voted_up is null or event_id % 4 = 0")
def invalid_recent(t: Tables) -> DataFrame:
    rows = _dirty(t).withColumn("language_code", F.when(F.col("event_id") % 4 == 0, " ").otherwise("english"))
    return rows.filter(checks.invalid_recent()).select("event_id")


@query(DIRTY_SQL + ", bad as (select recommendationid, updated_ts, collected_ts from dirty where appid <= 0) select event_id from dirty d where not exists (select 1 from bad b where b.recommendationid is not distinct from d.recommendationid and b.updated_ts is not distinct from d.updated_ts and b.collected_ts is not distinct from d.collected_ts)")
def without_invalid(t: Tables) -> DataFrame:
    """Rows without those of the keys that some invalid row has."""
    d = _dirty(t)
    return responses.without_rows(d, d.filter("appid <= 0"), ["recommendationid", "updated_ts", "collected_ts"]).select("event_id")


@query("select o_orderkey from orders where o_orderkey % 3 <> 0 and case when o_orderkey % 3 = 1 then 'ads' else 'news' end <> 'ads'")
def developer_notices(t: Tables) -> DataFrame:
    """Notices of the developer's feed: one without a feed isn't, nor one of the excluded feed."""
    k = F.col("o_orderkey") % 3
    feed = F.when(k == 1, "ads").when(k == 2, "news")
    return t.raw("orders").filter(checks.developer_notice(feed, "ads")).select("o_orderkey")


@query("select doc_id, regexp_full_match(case when doc_id % 4 = 0 then '  　  ' else coalesce(text, '') end, '[\\s\\p{Z}\\x1c-\\x1f\\x{85}]*') is_blank from documents")
def blank_texts(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 0, "  　  ").otherwise(F.coalesce("text", F.lit("")))
    return t.raw("documents").select("doc_id", checks.blank(text).alias("is_blank"))


@query("select (select count(*) from orders where o_totalprice < 0) > 0 any_negative, (select count(*) from orders where o_totalprice > 100000) > 0 any_large")
def existence_probe(t: Tables) -> DataFrame:
    """Whether any row fails, without counting them all: each probe reads up to its first hit."""
    o = t.raw("orders")
    return t.spark.createDataFrame([(not o.filter("o_totalprice < 0").isEmpty(), not o.filter("o_totalprice > 100000").isEmpty())], "any_negative boolean, any_large boolean")


@query("select o_orderkey from orders where o_orderkey % 5 = 0 or o_orderdate >= timestamp '1996-01-01'")
def since_or_unknown(t: Tables) -> DataFrame:
    at = F.when(F.col("o_orderkey") % 5 != 0, times.ntz_seconds("o_orderdate"))
    return t.raw("orders").withColumn("at", at).filter(responses.since_or_unknown("at", 820454400)).select("o_orderkey")


@query("select 'all' asked, count(*) n from orders union all select 'F', count(*) from orders where o_orderstatus = 'F'")
def optional_filter(t: Tables) -> DataFrame:
    of = lambda wanted: t.raw("orders").filter(responses.equals_if_given("o_orderstatus", wanted)).agg(F.count("*").alias("n")).select(F.lit(wanted or "all").alias("asked"), "n")
    return of(None).unionByName(of("F"))


# ---- keys, lookups, versions -----------------------------------------------------------


@query("select min(vec_id) chunk_id, o_orderkey, o_orderstatus from orders join (select vec_id, vec_id % 100 gid, vec_id % 3 seq from embeddings) on gid = o_custkey % 150 and seq = o_orderkey % 3 group by o_orderkey, o_orderstatus")
def surrogate_keys(t: Tables) -> DataFrame:
    ids = t.raw("embeddings").select((F.col("vec_id") % 100).alias("gid"), (F.col("vec_id") % 3).alias("seq"), F.col("vec_id").alias("chunk_id"))
    rows = t.raw("orders").select((F.col("o_custkey") % 150).alias("gid"), (F.col("o_orderkey") % 3).alias("seq"), "o_orderkey", "o_orderstatus")
    return responses.with_surrogate(rows, ids, ["gid", "seq"], "chunk_id")


@query("with v as (select l_orderkey gid, l_linenumber seq, coalesce(case when l_linenumber % 2 = 0 then 'Model-A.' || l_linenumber end, case when l_orderkey % 3 = 0 then 'model-a.0' else 'rules-5' end) as version from (select distinct l_orderkey, l_linenumber from lineitem)) select * from v where starts_with(lower(version), 'model-a')")
def changes_by_model(t: Tables) -> DataFrame:
    """Changes by a model, told by the row's version or else by its chunk's."""
    line = t.raw("lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("seq")).distinct()
    changes = line.withColumn("model_version", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Model-A."), F.col("seq").cast("string"))))
    chunks = line.withColumn("model_version", F.when(F.col("gid") % 3 == 0, "model-a.0").otherwise("rules-5"))
    return responses.by_model(changes, chunks, "MODEL-a")


@query(with_("bd p", "select recommendationid, appid from p where exists (select 1 from bd where bd.appid = p.appid and band_no in (2, 4) and playtime >= playtime_from and (playtime_to is null or playtime < playtime_to))"))
def reviews_in_bands(t: Tables) -> DataFrame:
    p = t.playtimes()
    return responses.in_any_band(p, agg.band_bounds(p), [2, 4]).select("recommendationid", "appid")


PATCHES_SQL = PATCH_SQL[: PATCH_SQL.index("select gid, appid, bc before_count")]


def _patch_stat(t: Tables) -> DataFrame:
    return agg.patch_stat(t.reviews(), t.patches(), COVERAGE_START, COVERAGE_END, RUN_AT)


@query(PATCHES_SQL + "select gid, appid from q where bc > 0 and ac > 0 and gid % 3 <> 0 and appid % 4 = 1")
def candidate_patches(t: Tables) -> DataFrame:
    """Notices that are patches with reviews on both sides, of games of a genre."""
    notes = t.patches().select("gid", "appid", (F.col("gid") % 3 != 0).alias("is_patch"))
    genres = t.patches().select("appid").distinct().withColumn("genre", F.concat(F.lit("g"), (F.col("appid") % 4).cast("string")))
    return responses.complete_patches(notes, _patch_stat(t), genres, ["g1"]).select("gid", "appid")


@query(PATCHES_SQL + ", cy as (select gid, (published_ts - lag(published_ts) over (partition by appid order by published_ts, gid)) / 86400.0::double prev_days from pt) select q.gid, q.appid, 'Game ' || q.appid game_title, round(a - b, 2) delta_pct, round(prev_days, 6) prev_days from q join cy on cy.gid = q.gid where q.appid <> 5")
def patch_details(t: Tables) -> DataFrame:
    p = t.patches()
    games = p.select("appid").distinct().filter("appid <> 5").withColumn("title", F.concat(F.lit("Game "), F.col("appid").cast("string")))
    return responses.patch_details(p, games, _patch_stat(t), serving.patch_cycles(p).select("appid", "gid", "prev_days")).select("gid", "appid", "game_title", "delta_pct", F.round("prev_days", 6).alias("prev_days"))


@query("with p as (select c_custkey parent_id, c_nationkey entity_order, case when c_custkey % 2 = 0 then 'old' else 'new' end search from customer qualify row_number() over (partition by c_nationkey, c_custkey % 2 order by c_custkey) = 1) select b.parent_id, o_orderkey from orders join p a on a.parent_id = o_custkey and a.search = 'old' join p b on b.entity_order = a.entity_order and b.search = 'new'")
def copied_children(t: Tables) -> DataFrame:
    """The orders of one customer a nation, for the customer of the other search with that nation."""
    c = t.raw("customer").select(F.col("c_custkey").alias("parent_id"), F.col("c_nationkey").alias("entity_order"), F.when(F.col("c_custkey") % 2 == 0, "old").otherwise("new").alias("search"))
    parents = versions.latest(c, ["entity_order", "search"], [F.asc("parent_id")])
    return responses.copied_children(t.raw("orders").select(F.col("o_custkey").alias("parent_id"), "o_orderkey"), parents, "old", "new")


@query("select c_custkey appid, coalesce(r, 1000000000)::bigint as rank from customer left join (select s_suppkey, s_nationkey r from supplier) on s_suppkey = c_custkey")
def rank_or_last(t: Tables) -> DataFrame:
    ranks = t.raw("supplier").select(F.col("s_suppkey").alias("appid"), F.col("s_nationkey").alias("rank"))
    return responses.with_rank(t.raw("customer").select(F.col("c_custkey").alias("appid")), ranks, "appid")


@query("select l_orderkey gid, l_linenumber change_seq, n_nationkey target_id from lineitem left join nation on n_name = case when l_suppkey % 30 < 25 then (select n_name from nation where n_nationkey = l_suppkey % 30) else 'nowhere' end")
def change_code_ids(t: Tables) -> DataFrame:
    """Codes to ids; what the code list lacks is null."""
    codes = t.raw("nation").select("n_name", "n_nationkey")
    names = codes.select((F.col("n_nationkey").cast("bigint")).alias("k"), F.col("n_name").alias("target"))
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("change_seq"), (F.col("l_suppkey") % 30).alias("k")).join(names, "k", "left").withColumn("target", F.coalesce("target", F.lit("nowhere")))
    return notices.change_codes(rows, codes, "target", "n_name", "n_nationkey", "target_id").select("gid", "change_seq", "target_id")


@query("select vec_id % 100 gid, vec_id % 3 seq, max(vec_id) vec_id from embeddings group by 1, 2")
def latest_chunks(t: Tables) -> DataFrame:
    """The last processed chunk of each place; the larger id among equals, unknown times last."""
    c = t.raw("embeddings").select("vec_id", (F.col("vec_id") % 100).alias("gid"), (F.col("vec_id") % 3).alias("seq"), F.when(F.col("vec_id") >= 0, F.floor(F.col("vec_id") / 7)).alias("processed_at"))
    return versions.latest_chunks(c, ["vec_id"]).select("gid", "seq", "vec_id")


@query("select r_regionkey, left(coalesce(r_name, ''), 4) r_name, left(repeat(r_name, 200), 600) long_text from region")
def shaped_rows(t: Tables) -> DataFrame:
    """Columns cut to their widths, in code points."""
    return responses.shaped(t.raw("region").select("r_regionkey", "r_name", F.repeat("r_name", F.lit(200)).alias("long_text")), {"r_name": 4, "long_text": 600})


@query("select o_orderkey from orders where o_orderkey % 2 = 0 union select o_orderkey from orders where o_orderkey % 3 = 0")
def appended_rows(t: Tables) -> DataFrame:
    o = t.raw("orders").select("o_orderkey")
    new = o.filter("o_orderkey % 3 = 0")
    return responses.appended(o.filter("o_orderkey % 2 = 0"), new.unionByName(new), ["o_orderkey"])


@query("select o_orderkey, 'after' side from orders where o_orderkey % 7 = 0 and o_orderkey % 11 <> 0 union all select o_orderkey, 'before' from orders where o_orderkey % 11 = 0 and o_orderkey % 7 <> 0")
def run_differences(t: Tables) -> DataFrame:
    """Rows that only one of two runs has, with repeats: the second lacks some and repeats some."""
    o = t.raw("orders").select("o_orderkey")
    return responses.differences(o, o.filter("o_orderkey % 11 <> 0").unionByName(o.filter("o_orderkey % 7 = 0")))


@query("select o_orderpriority step, o_orderstatus status, count(*) n, (select count(distinct o_orderpriority) from orders) steps_ever from orders group by 1, 2")
def step_status(t: Tables) -> DataFrame:
    return responses.status_counts(t.raw("orders").select(F.col("o_orderpriority").alias("step"), F.col("o_orderstatus").alias("status")))


@query("select l_orderkey gid, l_linestatus seq, array_to_string(list_sort(list(distinct l_returnflag)), ',') directions, array_to_string(list_sort(list(distinct l_linenumber % 3)), ',') kinds, arg_min('q' || l_partkey, l_linenumber * 10000000 + l_partkey) first_quote from lineitem group by 1, 2")
def chunk_change_sets(t: Tables) -> DataFrame:
    c = t.raw("lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_linestatus").alias("seq"), F.col("l_returnflag").alias("direction"), (F.col("l_linenumber") % 3).cast("string").alias("change_type"), F.lit("x").alias("target_type"), F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("quote"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("change_seq"))
    return responses.chunk_sets(c).select("gid", "seq", F.array_join("directions", ",").alias("directions"), F.array_join("kinds", ",").alias("kinds"), "first_quote")


@query("select n_nationkey, n_name from nation order by n_nationkey")
def ordered_codes(t: Tables) -> DataFrame:
    return t.raw("nation").select("n_nationkey", "n_name").orderBy("n_nationkey")


# ---- text and numbers ------------------------------------------------------------------


@query("select p_partkey, case when p_size % 3 = 0 then case when p_size % 2 = 0 then '' else 'h' || p_size end else concat_ws(' | ', p_brand, case when p_size % 2 <> 0 then 'h' || p_size end) end head, p_name as body from part")
def model_inputs(t: Tables) -> DataFrame:
    """Inputs of a model, made and taken apart again."""
    game, heading = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_brand")), F.when(F.col("p_size") % 2 != 0, F.concat(F.lit("h"), F.col("p_size").cast("string")))
    parts = responses.split_text(responses.input_text(game, heading, F.col("p_name")))
    return t.raw("part").select("p_partkey", parts["head"].alias("head"), parts["text"].alias("body"))


@query("with x as (select doc_id, cast(substr(source, 4) as bigint) appid, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) n from documents where text is not null) select doc_id, case when length(n) < 40 then 'skipped' when row_number() over (partition by appid, n order by doc_id) > 1 then 'duplicate' else 'pending' end status from x")
def chunk_status(t: Tables) -> DataFrame:
    chunks = t.raw("documents").filter("text is not null").select("doc_id", F.substr("source", F.lit(4)).cast("bigint").alias("appid"), F.col("text").alias("chunk"), F.col("doc_id").alias("gid"), F.lit(0).alias("seq"))
    return responses.chunk_rows(chunks, 40).select("doc_id", "status")


@query("with x as (select l_orderkey gid, l_linenumber seq, case l_linenumber % 6 when 0 then 'add' when 1 then 'increase' when 2 then 'change' when 3 then 'fix' when 4 then 'change' end act, l_quantity a, l_discount * 100 b from lineitem) select gid, seq, case when act in ('add', 'fix') then act when act is not null then 'modify' end change_type, case when act = 'increase' then act when act in ('add', 'fix') then 'not_applicable' when act is null then null when b > a then 'increase' when b < a then 'decrease' else 'none' end direction from x")
def action_slots(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 6
    act = F.when(k == 0, "add").when(k == 1, "increase").when(k.isin(2, 4), "change").when(k == 3, "fix")
    return t.raw("lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("seq"), *responses.action_slots(act, F.col("l_quantity"), F.col("l_discount") * 100))


@query("select o_orderkey, round_even(o_orderkey / 4.0::double, 1) half_even, round(o_orderkey / 4.0::double, 1) half_up from orders")
def half_even(t: Tables) -> DataFrame:
    v = F.col("o_orderkey") / F.lit(4.0)
    return t.raw("orders").select("o_orderkey", responses.round_half_even(v).alias("half_even"), F.round(v, 1).alias("half_up"))


@query("select p_partkey, case when length(p_name) <= 14 then p_name else rtrim(regexp_replace(left(p_name, 13), '\\s\\S*$', '')) || '…' end short, p_size || '%' || ' in ' || p_size || ' ms' units from part")
def short_texts(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    return t.raw("part").select("p_partkey", texts.shortened(F.col("p_name"), 14).alias("short"), texts.tidy_units(F.concat(size, F.lit(" % in "), size, F.lit("ms"))).alias("units"))


@query("select p_partkey, case when p_size % 2 = 0 then '강' || '을' else '가' || '를' end phrase from part")
def particles(t: Tables) -> DataFrame:
    """The particle follows the last syllable's final consonant."""
    word = F.when(F.col("p_size") % 2 == 0, "강").otherwise("가")
    return t.raw("part").select("p_partkey", texts.with_particle(word, "을", "를").alias("phrase"))


@query("select p_partkey, p_size in (select unnest([3, 7, 12])) as known, case when p_size in (3, 7, 12) then '' else cast(cast(p_size as double) as varchar) end unknown from part")
def unknown_numbers(t: Tables) -> DataFrame:
    found = notices.unknown_numbers(F.concat(F.lit("of "), F.col("p_size").cast("string"), F.lit(" and 7.0")), F.lit("3, 7 or 12"))
    return t.raw("part").select("p_partkey", (F.size(found) == 0).alias("known"), F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("unknown"))


@query("select o_orderkey, year(o_orderdate + interval 9 hour) as year, case when o_custkey % 5 > 0 then (o_orderkey % 7) / cast(o_custkey % 5 as double) end follow_up, date_diff('day', date '1992-01-01', cast(o_orderdate + interval 9 hour as date)) + 1 n_days from orders")
def period_rules(t: Tables) -> DataFrame:
    at = times.ntz_seconds("o_orderdate")
    return t.raw("orders").select("o_orderkey", times.kst_year(at).alias("year"), rates.follow_up((F.col("o_orderkey") % 7).cast("double"), F.col("o_custkey") % 5).alias("follow_up"), times.day_count(F.lit("1992-01-01").cast("date"), times.kst_date(at)).cast("bigint").alias("n_days"))


@query("select vec_id, '[' || list_aggregate(list_transform(embedding[1:2], lambda x: cast(cast(floor(x * 4) as int) as varchar)), 'string_agg', ',') || ']' literal, vec_id % 9 <> 0 is_finite from embeddings")
def vector_literals(t: Tables) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 2), lambda x: F.floor(x * 4).cast("int"))
    odd = F.when(F.col("vec_id") % 9 == 0, F.array(F.lit(float("nan")))).otherwise(F.array(F.lit(1.0)))
    return t.raw("embeddings").select("vec_id", vectors.literal(v).alias("literal"), vectors.finite(odd).alias("is_finite"))


# ---- search and models -----------------------------------------------------------------


@query("with s(slot, a, b) as (values (1, 'R', 'F'), (2, 'N', 'O')), x as (select l_orderkey gid, slot, l_linenumber change_seq, case when a = l_returnflag then 2 else 0 end + case when b = l_linestatus then 1 else 0 end score from lineitem, s) select gid, slot, change_seq, score from x qualify row_number() over (partition by gid order by score desc, slot, change_seq) = 1")
def best_pairs(t: Tables) -> DataFrame:
    slots = t.spark.createDataFrame([(1, "R", "F"), (2, "N", "O")], "slot int, l_returnflag string, l_linestatus string")
    changes = t.raw("lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("change_seq"), "l_returnflag", "l_linestatus")
    return search.best_pair(slots, changes, {"l_returnflag": 2, "l_linestatus": 1})


@query("with x as (select l_orderkey, l_linenumber, l_returnflag = 'R' m from lineitem), y as (select *, row_number() over (partition by l_orderkey order by case when m then 0 else 1 end, l_linenumber) k from x) select l_orderkey, string_agg(cast(l_linenumber as varchar), ',' order by k) first_three from y where k <= 3 group by 1")
def matched_first(t: Tables) -> DataFrame:
    g = t.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_returnflag") == "R").alias("m")))).alias("x"))
    front = search.matched_first(F.transform("x", lambda r: r["m"]), F.transform("x", lambda r: r["l_linenumber"].cast("string")), 3)
    return g.select("l_orderkey", F.array_join(front, ",").alias("first_three"))


@query("select l_orderkey, case when avg(case when l_returnflag = 'N' then 1 else 0 end) >= 0.5 then 1 else 0 end as label from lineitem group by 1")
def majority_votes(t: Tables) -> DataFrame:
    return topics.majority(t.raw("lineitem").withColumn("vote", (F.col("l_returnflag") == "N").cast("int")), "l_orderkey", "vote")


@query("select l_orderkey gid, l_returnflag = 'R' same_direction, l_linestatus = 'F' same_target, case when l_quantity = 0 then null when l_extendedprice / 1000 / l_quantity > 1.25 * 0.5 then 'larger' when l_extendedprice / 1000 / l_quantity < 0.75 * 0.5 then 'smaller' else 'similar' end as size, l_linenumber seq from lineitem")
def plan_comparison(t: Tables) -> DataFrame:
    """A plan (up from 10 to 15) against each case: direction, target, relative size."""
    cases = t.raw("lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("direction"), F.col("l_linestatus").alias("target_type"), F.array(F.lit("g")).alias("genres"), F.array(F.lit("k")).alias("kinds"), "l_quantity", "l_extendedprice")
    size = responses.compared_sizes(10, 15, F.col("l_quantity"), F.col("l_quantity") + F.col("l_extendedprice") / 1000)
    return cases.select("gid", "seq", (F.col("direction") == "R").alias("same_direction"), (F.col("target_type") == "F").alias("same_target"), size.alias("size"))


# ---- answers ---------------------------------------------------------------------------


@query(with_("ds pd", """, av as (select appid, min(stat_date) available_from, max(stat_date) available_to from ds group by 1), grid as (select av.*, cast(d as date) stat_date from av, generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day) g(d)),
x as (select appid, patch_date, string_agg(cast(gid as varchar), ',' order by gid) patches from pd group by 1, 2)
select g.appid, g.stat_date, coalesce(review_count, 0) reviews, round(100.0::double * (new_positive_count + edited_positive_count) / nullif(review_count, 0), 1) rate, round(100.0::double * new_positive_count / nullif(new_review_count, 0), 1) new_rate, round(100.0::double * edited_positive_count / nullif(edited_review_count, 0), 1) edited_rate, coalesce(patches, '') patches, available_from, available_to
from grid g left join ds on ds.appid = g.appid and ds.stat_date = g.stat_date left join x on x.appid = g.appid and x.patch_date = g.stat_date""").replace(" , av as", ", av as"))
def reaction_trend(t: Tables) -> DataFrame:
    out = responses.reaction_trend(agg.daily_stat(t.reviews()), t.patch_days(), "2024-01-01", "2024-01-31")
    return out.withColumn("patches", F.array_join("patches", ","))


TOPIC_SQL = with_("bd pb t", """, m as (select b.appid, b.band_no, x.topic_id, count(*) mentions from pb b join t x on x.recommendationid = b.recommendationid group by 1, 2, 3),
c as (select appid, band_no, count(*) n from pb where band_no is not null group by 1, 2),
g as (select d.appid, d.band_no, k.topic_id, coalesce(m.mentions, 0) mentions, coalesce(c.n, 0) n from bd d cross join (values (1), (2), (3), (4), (5)) k(topic_id) left join m on m.appid = d.appid and m.band_no = d.band_no and m.topic_id = k.topic_id left join c on c.appid = d.appid and c.band_no = d.band_no),
y as (select *, sum(n) over w total, sum(mentions) over w all_mentions from g window w as (partition by appid, topic_id)),
z as (select *, case when total >= 30 and n > 0 then mentions / cast(n as double) end rate, case when total >= 30 then all_mentions / cast(total as double) end overall from y)
select appid, topic_id, band_no, mentions, n review_count, round(rate, 8) rate, round(overall, 8) overall, round(rate - overall, 8) delta, case when count(rate) over (partition by appid, topic_id) > 0 then first_value(band_no) over (partition by appid, topic_id order by rate desc nulls last, band_no) end highest_band from z""").replace(" , m as", ", m as")


@query(TOPIC_SQL)
def topic_rates(t: Tables) -> DataFrame:
    p = t.playtimes()
    bands = agg.band_bounds(p)
    placed = agg.assign_band(p, bands)
    grid = serving.topic_grid(bands, t.topic_codes(), placed.join(t.topics().select("recommendationid", "topic_id"), "recommendationid"))
    out = responses.topic_rates(grid, serving.band_counts(bands, placed).filter("band_no is not null"))
    return out.select("appid", "topic_id", "band_no", "mentions", "review_count", *(F.round(c, 8).alias(c) for c in ("rate", "overall", "delta")), "highest_band")


@query(with_("bd pb", ", j as (select d.appid, d.band_no, b.recommendationid, b.voted_up from bd d left join pb b on b.appid = d.appid and b.band_no = d.band_no), c as (select appid, band_no, count(recommendationid) n, count(*) filter (voted_up) good from j group by grouping sets ((appid, band_no), (appid))), x as (select *, max(case when band_no is null then n end) over (partition by appid) >= 30 enough from c) select appid, coalesce(band_no, 0) band_no, n review_count, case when enough then round(100.0::double * good / nullif(n, 0), 1) end positive_rate, enough from x where enough or band_no is null").replace(" , j as", ", j as"))
def playtime_analysis(t: Tables) -> DataFrame:
    p = t.playtimes()
    bands = agg.band_bounds(p)
    return responses.playtime_analysis(serving.band_counts(bands, agg.assign_band(p, bands)))


@query("with h as (select o_orderkey gid, (o_custkey % 1000) / 1000.0::double cosine, case when o_orderkey % 13 <> 0 then (o_totalprice % 21) - 10 end delta_pct, cast(floor(epoch(o_orderdate)) as bigint) published_ts from orders), s as (select *, case when delta_pct > 3 then 'improved' when delta_pct < -3 then 'worsened' else 'steady' end outcome from h where delta_pct is not null), p as (select *, row_number() over (partition by outcome order by published_ts desc nulls last, cosine desc, gid) place from s) select gid, outcome, place, cast((place - 1) // 60 as int) batch from p")
def case_answer(t: Tables) -> DataFrame:
    """Cases by outcome group, the newest first, with the batch of sixty cards that each is in."""
    o = t.raw("orders")
    hits = o.select(F.col("o_orderkey").alias("gid"), ((F.col("o_custkey") % 1000) / F.lit(1000.0)).alias("cosine"))
    stats = o.select(F.col("o_orderkey").alias("gid"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") % 21 - 10).alias("delta_pct"))
    notes = o.select(F.col("o_orderkey").alias("gid"), times.ntz_seconds("o_orderdate").alias("published_ts"))
    return responses.case_answer(hits, stats, notes, "recent").select("gid", "outcome", F.col("place").cast("bigint").alias("place"), "batch")


@query("select o_orderkey gid, o_custkey % 7 - 3 d, 'F, O | ' || case when o_orderstatus = 'F' then 'weapon' else 'unknown' end || ' | ' || case when o_custkey % 7 > 3 then 'up ' || (o_custkey % 7 - 3) || '.0' when o_custkey % 7 < 3 then 'down ' || (3 - o_custkey % 7) || '.0' else 'unchanged' end as line from orders")
def card_lines(t: Tables) -> DataFrame:
    d = F.col("o_custkey") % 7 - 3
    line = responses.card_line(F.array(F.lit("O"), F.lit("F"), F.lit("O")), F.when(F.col("o_orderstatus") == "F", "weapon"), d.cast("double"))
    return t.raw("orders").select(F.col("o_orderkey").alias("gid"), d.alias("d"), line.alias("line"))


# ---- ranges, channels, periods, decimals -----------------------------------------------


@query(with_("dy", "select appid, cast(date_trunc('week', stat_date) as date) period, count(*) n_days, cast(sum(reviews) as bigint) reviews, round(sum(positives) / cast(sum(reviews) as double), 8) ratio from dy where reviews > 0 group by 1, 2"))
def trend_ranges(t: Tables) -> DataFrame:
    return trends.ranges(t.days()).withColumn("ratio", F.round("ratio", 8))


@query(with_("ds", ", x as (select appid, stat_date, 'new' channel, new_review_count reviews, new_positive_count positives from ds union all select appid, stat_date, 'edited', edited_review_count, edited_positive_count from ds) select appid, channel, cast(sum(reviews) as bigint) reviews, cast(sum(positives) as bigint) positives, round(sum(positives) / cast(nullif(sum(reviews), 0) as double), 8) ratio, arg_max(stat_date, reviews * 100000 - date_diff('day', date '1970-01-01', stat_date)) filter (reviews > 0) peak_date from x group by 1, 2").replace(" , x as", ", x as"))
def trend_channels(t: Tables) -> DataFrame:
    return trends.channel_totals(agg.daily_stat(t.reviews())).withColumn("ratio", F.round("ratio", 8))


@query(with_("p", ", q as (select * from p where updated_ts >= 1700010000 and updated_ts < 1700300000), c as (select case language_code when 'koreana' then 'korean' else language_code end language_code, count(*) review_count, count(*) filter (voted_up) positive_count from q group by 1) select language_code, review_count, round(100.0::double * review_count / sum(review_count) over (), 1) share, round(100.0::double * positive_count / review_count, 1) positive_rate from c").replace(" , q as", ", q as"))
def language_share_period(t: Tables) -> DataFrame:
    """Shares of the latest reviews of a half-open period."""
    names = t.spark.createDataFrame([("korean", "Korean")], "language_code string, name string")
    return serving.language_share(t.playtimes().filter("updated_ts >= 1700010000 and updated_ts < 1700300000"), names).select("language_code", "review_count", "share", "positive_rate")


@query(with_("g tl", ", f as (select appid, min(published_ts) released from tl group by 1) select g.appid, title, released from g join f on f.appid = g.appid where year(make_timestamp((released + 32400) * 1000000)) between 1996 and 1997").replace(" , f as", ", f as"))
def games_release_year(t: Tables) -> DataFrame:
    released = t.timeline().groupBy("appid").agg(F.min("published_ts").alias("released"))
    return t.games().join(released, "appid").filter(times.kst_year("released").between(1996, 1997)).select("appid", "title", "released")


@query(with_("g tl", ", f as (select appid, min(published_ts) released from tl group by 1) select g.appid, released from g left join f on f.appid = g.appid order by released desc nulls last, g.appid limit 21").replace(" , f as", ", f as"))
def games_by_release(t: Tables) -> DataFrame:
    released = t.timeline().groupBy("appid").agg(F.min("published_ts").alias("released"))
    return serving.keyset(t.games().select("appid").join(released, "appid", "left"), "released", "appid", True, 20)


@query(PATCHES_SQL + "select gid, cast(round(b, 2) as decimal(5,2)) before_pct, cast(round(a, 2) as decimal(5,2)) after_pct from q")
def patch_decimals(t: Tables) -> DataFrame:
    s = _patch_stat(t)
    return s.select("gid", *(rates.percent_decimal(F.col(f"{x}_positive"), F.col(f"{x}_count")).alias(f"{x}_pct") for x in ("before", "after")))


@query("select p_partkey, p_size || '>' || (p_size + 1) || ',5%>7%' pairs from part")
def number_transitions(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("from "), size, F.lit(" to "), (F.col("p_size") + 1).cast("string"), F.lit(" and 5% -> 7%, not 9"))
    return t.raw("part").select("p_partkey", F.array_join(texts.transitions(text), ",").alias("pairs"))


@query("select l_orderkey, to_json(list({'n': l_linenumber, 'f': l_returnflag} order by l_linenumber, l_partkey, l_returnflag) filter (l_returnflag <> 'N')) lines from lineitem group by 1")
def json_lists(t: Tables) -> DataFrame:
    """Ordered JSON arrays of some of a group's rows; null where there are none."""
    pairs = F.collect_list(F.when(F.col("l_returnflag") != "N", F.struct(F.col("l_linenumber").alias("n"), "l_partkey", F.col("l_returnflag").alias("f"))))
    g = t.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(pairs).alias("x"))
    return g.select("l_orderkey", F.when(F.size("x") > 0, F.to_json(F.transform("x", lambda r: F.struct(r["n"].alias("n"), r["f"].alias("f"))))).alias("lines"))


@query("select o_orderkey, unnest(['a', o_orderstatus, 'c']) item, unnest([1, 2, 3])::bigint as place from orders")
def json_ordinality(t: Tables) -> DataFrame:
    """Elements of a JSON array with their places, from 1."""
    text = F.concat(F.lit('["a","'), "o_orderstatus", F.lit('","c"]'))
    return t.raw("orders").select("o_orderkey", F.posexplode(F.from_json(text, "array<string>")).alias("k", "item")).select("o_orderkey", "item", (F.col("k") + 1).cast("bigint").alias("place"))


@query("with x as (select unnest([quality, toxic]) y, unnest([case when doc_id % 3 = 0 then 1 else 0 end, case when doc_id % 5 = 0 then 1 else 0 end]) p from labels), s as (select count(*) filter (y = 1 and p = 1) tp, count(*) filter (y = 0 and p = 1) fp, count(*) filter (y = 1 and p = 0) fn from x) select tp, fp, fn, tp / cast(tp + fp as double) as precision, tp / cast(tp + fn as double) recall, 2 * tp / cast(2 * tp + fp + fn as double) f1 from s")
def micro_f1(t: Tables) -> DataFrame:
    rows = t.raw("labels").select("quality", "toxic", (F.col("doc_id") % 3 == 0).cast("int").alias("p_quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("p_toxic"))
    return topics.micro_f1(rows, [("quality", "p_quality"), ("toxic", "p_toxic")])


@query("select c_custkey appid, left(case when c_custkey % 4 = 0 then 'New ' || c_name else c_name end, 12) title from customer union all select 1000000 + n_nationkey, left(n_name, 12) from nation")
def catalog_upsert(t: Tables) -> DataFrame:
    """Catalogue rows updated and added by key, none deleted, strings cut to their width."""
    old = t.raw("customer").select(F.col("c_custkey").cast("bigint").alias("appid"), F.col("c_name").alias("title"))
    new = old.filter("appid % 4 = 0").select("appid", F.concat(F.lit("New "), "title").alias("title")).unionByName(t.raw("nation").select((F.lit(1_000_000) + F.col("n_nationkey")).cast("bigint").alias("appid"), F.col("n_name").alias("title")))
    return responses.shaped(versions.merge_columns(old, new, ["appid"], {}), {"title": 12})


# ---- guards ----------------------------------------------------------------------------


@query(with_("bd p", ", x as (select * from bd where not (appid = 3 and band_no = 2) union all select * from bd where appid = 4 and band_no = 1) select p.appid, recommendationid, count(x.appid) n_bands from p left join x on x.appid = p.appid and playtime >= playtime_from and (playtime_to is null or playtime < playtime_to) where playtime >= 0 group by 1, 2 having count(x.appid) <> 1").replace(" , x as", ", x as"))
def misplaced_reviews(t: Tables) -> DataFrame:
    """Reviews in no band or in two, where one band is missing and another comes twice."""
    p = t.playtimes()
    bands = agg.band_bounds(p)
    return agg.misplaced(p, bands.filter("not (appid = 3 and band_no = 2)").unionByName(bands.filter("appid = 4 and band_no = 1")))


@query("with o as (select distinct o_custkey, o_orderstatus, o_orderpriority from orders) select o_custkey, count(distinct (o_orderstatus, o_orderpriority)) variants, count(*) n_rows from o group by 1 having count(distinct (o_orderstatus, o_orderpriority)) > 1")
def conflicts_after_repeats(t: Tables) -> DataFrame:
    return checks.conflicts_of_latest(t.raw("orders"), ["o_custkey"], ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("select cast(l_suppkey % 30 as bigint) code, count(*) n_rows from lineitem where l_suppkey % 30 not in (select n_nationkey from nation) group by 1")
def unknown_codes(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").select((F.col("l_suppkey") % 30).cast("bigint").alias("code"))
    return checks.unknown_codes(rows, t.raw("nation"), "code", "n_nationkey")


@query("select l_orderkey, string_agg(l_returnflag, '' order by first_at) flags from (select l_orderkey, l_returnflag, min(l_linenumber * 10 + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end) first_at from lineitem group by 1, 2) group by 1")
def ordered_unique(t: Tables) -> DataFrame:
    """The distinct values of a list in the order of their first occurrence."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return t.raw("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(rows, lambda x: x["l_returnflag"])), "").alias("flags"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def log_preview(t: Tables) -> DataFrame:
    """The ten rows that a job's log shows."""
    return t.raw("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(with_("r", ", m as (select max(updated_ts) hi from r), l as (select recommendationid, updated_ts, collected_ts from r qualify row_number() over (partition by recommendationid order by updated_ts desc, collected_ts desc) = 1) select l.* from l, m where updated_ts >= hi - 172800").replace(" , m as", ", m as"))
def recent_upsert(t: Tables) -> DataFrame:
    """An upsert that drops what has left the window."""
    r = t.reviews().select("recommendationid", "updated_ts", "collected_ts")
    newest = r.agg(F.max("updated_ts").alias("hi")).first()["hi"]
    return versions.upsert(r.filter("collected_ts % 3 <> 0"), r.filter("collected_ts % 3 = 0"), ["recommendationid"], [F.desc("updated_ts"), F.desc("collected_ts")], F.col("updated_ts") >= newest - 172_800)
