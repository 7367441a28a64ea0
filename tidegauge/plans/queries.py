"""The engine's queries over the driver's tables, each with the SQL that DuckDB runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions import rates, texts, times, vectors
from tidegauge.operators import aggregates as agg
from tidegauge.operators import checks, notices, search, serving, topics, trends, versions
from tidegauge.plans import notices_sql
from tidegauge.plans.fixtures import COVERAGE_END, COVERAGE_START, RUN_AT, Tables, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its own name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- statistics ------------------------------------------------------------------------


@query(with_("ds", "select * from ds"))
def daily_stat(t: Tables) -> DataFrame:
    return agg.daily_stat(t.reviews())


@query(with_("p", "select appid, language_code, count(*) review_count, count(*) filter (voted_up) positive_count from p group by 1, 2"))
def language_stat(t: Tables) -> DataFrame:
    return agg.language_stat(t.playtime_versions())


@query(with_("bd pb", "select d.appid, d.band_no, d.playtime_from, d.playtime_to, count(b.recommendationid) review_count, count(*) filter (b.voted_up) positive_count from bd d left join pb b on b.appid = d.appid and b.band_no = d.band_no group by 1, 2, 3, 4"))
def band_stat(t: Tables) -> DataFrame:
    return agg.band_stat(t.playtime_versions())


@query(with_("p", "select count(*) latest_count, count(*) filter (playtime is null) missing_count, count(*) filter (playtime < 0) negative_count, count(*) filter (playtime >= 0) included_count from p"))
def band_quality(t: Tables) -> DataFrame:
    return agg.band_quality(t.playtime_versions())


@query(with_("pb t", "select b.appid, b.band_no, topic_id, count(*) filter (voted_up) positive_count, count(*) filter (not voted_up) negative_count from pb b join (select distinct * from t) x using (appid, recommendationid, updated_ts) where playtime >= 0 group by 1, 2, 3"))
def band_topic_stat(t: Tables) -> DataFrame:
    p = t.playtime_versions()
    return agg.band_topic_stat(p, t.topics(), agg.band_bounds(p))


@query(with_("pb", "select appid, recommendationid, playtime, band_no from pb"))
def assign_band(t: Tables) -> DataFrame:
    p = t.playtime_versions()
    return agg.assign_band(agg.latest_reviews(p), agg.band_bounds(p)).select("appid", "recommendationid", "playtime", "band_no")


PATCH_SQL = with_("r pt", """, w as (select gid, appid, epoch(cast(make_timestamp((published_ts + 32400) * 1000000) as date)) - 32400 d0 from pt),
x as (select w.gid, w.appid, case when updated_ts < d0 then 'before' else 'after' end period, r.voted_up, recommendationid, updated_ts, collected_ts
      from w join r on r.appid = w.appid and updated_ts >= d0 - 604800 and updated_ts < d0 + 604800
      qualify row_number() over (partition by w.gid, period, recommendationid order by updated_ts desc, collected_ts desc) = 1),
c as (select w.gid, w.appid, count(*) filter (period = 'before') bc, count(*) filter (period = 'before' and voted_up) bp, count(*) filter (period = 'after') ac, count(*) filter (period = 'after' and voted_up) ap from w left join x on x.gid = w.gid group by 1, 2),
q as (select *, 100.0::double * bp / nullif(bc, 0) b, 100.0::double * ap / nullif(ac, 0) a from c)
select gid, appid, bc before_count, bp before_positive, ac after_count, ap after_positive, round(b, 2) before_pct, round(a, 2) after_pct, round(a - b, 2) delta_pct, round(round(a, 2) - round(b, 2), 2) delta_pp from q""").replace(" , w as", ", w as")


@query(PATCH_SQL)
def patch_stat(t: Tables) -> DataFrame:
    out = agg.patch_stat(t.reviews(), t.patches(), COVERAGE_START, COVERAGE_END, RUN_AT)
    return out.withColumn("delta_pp", F.round("delta_pp", 2))


# ---- versions, checks, sinks as relations ----------------------------------------------


@query(with_("v1", "select appid, recommendationid, updated_ts, collected_ts, voted_up from v1"))
def lake_all(t: Tables) -> DataFrame:
    return versions.exact_versions(t.reviews()).select("appid", "recommendationid", "updated_ts", "collected_ts", "voted_up")


@query(with_("r", "select appid, recommendationid, updated_ts, collected_ts, voted_up from r qualify row_number() over (partition by appid, recommendationid order by updated_ts desc, collected_ts desc) = 1"))
def lake_latest(t: Tables) -> DataFrame:
    return versions.latest_reviews(t.reviews()).select("appid", "recommendationid", "updated_ts", "collected_ts", "voted_up")


@query(with_("v1", "select appid, recommendationid, updated_ts, collected_ts, voted_up from v1"))
def lake_bucketed_dedup(t: Tables) -> DataFrame:
    return versions.bucketed_versions(t.reviews(), 4).select("appid", "recommendationid", "updated_ts", "collected_ts", "voted_up")


@query(with_("r", "select recommendationid, count(distinct (voted_up, event_type)) variants from r group by 1 having count(distinct (voted_up, event_type)) > 1"))
def conflict_report(t: Tables) -> DataFrame:
    return checks.conflicts(t.reviews(), ["recommendationid"], ["voted_up", "event_type"])


@query("with x as (select quality, toxic, source, n_chars from documents left join labels using (doc_id)) select unnest(['quality', 'toxic', 'source', 'n_chars']) column_name, unnest([count(*) filter (quality is null), count(*) filter (toxic is null), count(*) filter (source is null), count(*) filter (n_chars is null)]) n_null, count(*) n_rows from x")
def null_report(t: Tables) -> DataFrame:
    return checks.null_report(t.raw("documents").join(t.raw("labels"), "doc_id", "left"), ["quality", "toxic", "source", "n_chars"])


def _dirty(t: Tables) -> DataFrame:
    """Reviews, some with what makes a version invalid."""
    k = F.col("event_id")
    return t.reviews().select("event_id", (F.col("appid") - F.when(k % 53 == 1, 100).otherwise(0)).alias("appid"), F.when(k % 59 != 2, F.col("recommendationid")).alias("recommendationid"), (F.col("created_ts") + F.when(k % 61 == 3, 10**9).otherwise(0)).alias("created_ts"), "updated_ts", (F.col("updated_ts") + F.when(k % 67 == 4, -5).otherwise(5)).alias("collected_ts"), F.when(k % 71 != 6, F.col("voted_up")).alias("voted_up"))


DIRTY_SQL = with_("r", ", dirty as (select event_id, appid - case when event_id % 53 = 1 then 100 else 0 end appid, case when event_id % 59 <> 2 then recommendationid end recommendationid, created_ts + case when event_id % 61 = 3 then 1000000000 else 0 end created_ts, updated_ts, updated_ts + case when event_id % 67 = 4 then -5 else 5 end collected_ts, case when event_id % 71 <> 6 then voted_up end voted_up from r)").replace(" , dirty", ", dirty")


@query(DIRTY_SQL + " select event_id from dirty where appid is null or recommendationid is null or created_ts is null or updated_ts is null or collected_ts is null or voted_up is null or appid <= 0 or recommendationid <= 0 or created_ts < 0 or updated_ts < created_ts or collected_ts < updated_ts")
def invalid_report(t: Tables) -> DataFrame:
    return _dirty(t).filter(checks.invalid_review()).select("event_id")


@query(with_("r", ", m as (select max(updated_ts) hi from r) select recommendationid, updated_ts, collected_ts, voted_up from r, m where updated_ts >= (hi + 32400) // 86400 * 86400 - 32400 - 13 * 86400 qualify row_number() over (partition by recommendationid order by updated_ts desc, collected_ts desc) = 1").replace(" , m as", ", m as"))
def recent_window(t: Tables) -> DataFrame:
    """The last 14 days up to the newest version's day."""
    r = t.reviews()
    newest = r.agg(times.kst_date(F.max("updated_ts")).alias("today"))
    recent = r.join(F.broadcast(newest), F.col("updated_ts") >= times.day_start(F.date_sub("today", 13)))  # one row
    return versions.latest(recent, ["recommendationid"], [F.desc("updated_ts"), F.desc("collected_ts")]).select("recommendationid", "updated_ts", "collected_ts", "voted_up")


@query(with_("r", "select recommendationid, updated_ts, collected_ts, event_id from r qualify row_number() over (partition by recommendationid order by updated_ts desc, collected_ts desc) = 1"))
def upsert_versions(t: Tables) -> DataFrame:
    r = t.reviews().select("recommendationid", "updated_ts", "collected_ts", "event_id")
    return versions.upsert(r.filter("event_id % 3 <> 0"), r.filter("event_id % 3 = 0"), ["recommendationid"], [F.desc("updated_ts"), F.desc("collected_ts")])


@query("select o_orderkey, o_custkey, case when o_orderkey % 4 = 0 then case when o_orderkey % 8 = 0 then o_orderstatus else 'new' end else o_orderstatus end status, case when o_orderkey % 4 = 0 then 0 else o_totalprice end price from orders")
def upsert_judged(t: Tables) -> DataFrame:
    """Update by key where a null judgement keeps the old one."""
    o = t.raw("orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = o.filter("o_orderkey % 4 = 0").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 8 != 0, "new").alias("status"), F.lit(0.0).alias("price"))
    return versions.merge_columns(o, new, ["o_orderkey"], {"status": "status"})


@query("select o_orderkey, o_custkey from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def insert_missing(t: Tables) -> DataFrame:
    o = t.raw("orders").select("o_orderkey", "o_custkey")
    return versions.insert_missing(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("with m as (select l_orderkey, l_linenumber from lineitem where l_orderkey % 5 = 0 and l_linenumber <= 2) select l_orderkey, l_linenumber, 'rule' origin from lineitem where l_orderkey not in (select l_orderkey from m) union all select l_orderkey, l_linenumber, 'model' from m")
def overlay_merge(t: Tables) -> DataFrame:
    """Model results replace all rule results of a key."""
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber")
    return versions.replace_keys(rows.withColumn("origin", F.lit("rule")), rows.filter("l_orderkey % 5 = 0 and l_linenumber <= 2").withColumn("origin", F.lit("model")), ["l_orderkey"])


@query(with_("pb", ", old as (select recommendationid, case when recommendationid % 7 = 0 then null when recommendationid % 11 = 0 then 1 else band_no end band_no from pb) select p.recommendationid, p.band_no from pb p join old o using (recommendationid) where p.band_no is distinct from o.band_no").replace(" , old", ", old"))
def band_changes(t: Tables) -> DataFrame:
    """Rows whose recomputed band differs from the stored one."""
    p = t.playtimes()
    new = agg.assign_band(p, agg.band_bounds(p)).select("recommendationid", "band_no")
    old = new.select("recommendationid", F.when(F.col("recommendationid") % 7 == 0, None).when(F.col("recommendationid") % 11 == 0, 1).otherwise(F.col("band_no")).alias("band_no"))
    return versions.changed(old, new, ["recommendationid"], ["band_no"])


@query("select l_orderkey, l_linenumber, case when o_orderstatus is null then l_returnflag else o_orderstatus end l_returnflag from lineitem left join (select * from orders where o_orderkey % 3 = 0) on o_orderkey = l_orderkey")
def column_patch(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    new = t.raw("orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_returnflag"))
    return versions.patch_columns(rows, new, ["l_orderkey"], ["l_returnflag"])


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def fk_semi_filter(t: Tables) -> DataFrame:
    keys = t.raw("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.raw("orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def fk_anti_report(t: Tables) -> DataFrame:
    """Customers without a pending order."""
    return t.raw("customer").join(t.raw("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(with_("r", ", x as (select appid, 'event_type' column_name, event_type as value from r union all select appid, 'voted_up', cast(voted_up as varchar) from r) select appid, column_name, value, count(*) n from x group by grouping sets ((appid, column_name, value), (column_name, value))").replace(" , x as", ", x as"))
def audit_profile(t: Tables) -> DataFrame:
    """How often each value occurs, per game and over all."""
    return agg.value_counts(t.reviews(), "appid", ["event_type", "voted_up"])


@query("select count(*) n_rows, count(distinct user_id) users, min(value) low, max(value) high, count(*) filter (event_type = 'signup') signups, count(distinct event_type) types from events")
def global_profile(t: Tables) -> DataFrame:
    return t.raw("events").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("users"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("event_type") == "signup").alias("signups"), F.countDistinct("event_type").alias("types"))


# ---- serving reads ---------------------------------------------------------------------


@query(with_("g", ", pg as (select * from g order by review_count desc nulls last, appid limit 21) select pg.appid, title, review_count, gid, published_ts from pg left join (select o_custkey, o_orderkey gid, cast(floor(epoch(o_orderdate)) as bigint) published_ts from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) x on o_custkey = pg.appid").replace(" , pg", ", pg"))
def games_page_first(t: Tables) -> DataFrame:
    """The page is cut first, then enriched."""
    page = serving.keyset(t.games(), "review_count", "appid", True, 20)
    return serving.latest_patch(page, t.timeline()).select("appid", "title", "review_count", "gid", "published_ts")


@query(with_("g", "select appid, title, positive_rate from g where positive_rate > 40 or (positive_rate = 40 and appid > 10) or positive_rate is null order by positive_rate nulls last, appid limit 31"))
def games_keyset_next(t: Tables) -> DataFrame:
    return serving.keyset(t.games(), "positive_rate", "appid", False, 30, (40.0, 10)).select("appid", "title", "positive_rate")


@query(PATCH_SQL.replace("select gid, appid, bc before_count", "select * from (select gid, appid, bc before_count") + ") order by abs(delta_pct) desc nulls last, gid limit 16")
def games_reaction_change(t: Tables) -> DataFrame:
    """Largest changes first: the sort key has to be computed before the page is cut."""
    return patch_stat(t).orderBy(F.abs("delta_pct").desc_nulls_last(), "gid").limit(16)


@query(with_("g tg", "select appid, title from g where appid in (select appid from tg where tag in ('1-URGENT', '2-HIGH', '5-LOW') group by 1 having count(distinct tag) = 3)"))
def games_all_tags(t: Tables) -> DataFrame:
    return serving.with_all_tags(t.games(), t.tags(), ["1-URGENT", "2-HIGH", "5-LOW"]).select("appid", "title")


@query("select p_partkey, p_name from part where contains(lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')), 'ar')")
def games_title_search(t: Tables) -> DataFrame:
    return t.raw("part").filter(F.contains(serving.title_key(F.col("p_name")), F.lit("ar"))).select("p_partkey", "p_name")


@query(with_("g", "select appid, title, developer, review_count, positive_rate from g where contains(lower(developer), 'build') and review_count between 3 and 20 and positive_rate between 20 and 80"))
def games_range_filters(t: Tables) -> DataFrame:
    return t.games().filter(serving.contains(F.col("developer"), "Build") & F.col("review_count").between(3, 20) & F.col("positive_rate").between(20.0, 80.0)).select("appid", "title", "developer", "review_count", "positive_rate")


@query(with_("g tg", "select g.appid, title, tags from g left join (select appid, string_agg(tag, ',' order by weight desc, tag) tags from tg group by 1) x on x.appid = g.appid"))
def game_detail_tags(t: Tables) -> DataFrame:
    tags = serving.ordered_tags(t.tags()).select("appid", F.array_join("tags", ",").alias("tags"))
    return t.games().join(tags, "appid", "left").select("appid", "title", "tags")


@query(with_("g tl", "select g.appid, gid, published_ts from g left join (select * from tl qualify row_number() over (partition by appid order by published_ts desc, gid desc) = 1) x on x.appid = g.appid"))
def latest_patch_per_game(t: Tables) -> DataFrame:
    return serving.latest_patch(t.games().select("appid"), t.timeline())


@query(with_("g", "select appid, nation in (select n_nationkey from nation where n_regionkey = 1) is_mine from g where nation is not null"))
def membership_flag(t: Tables) -> DataFrame:
    g = t.games().filter("nation is not null")
    mine = g.join(t.raw("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("nation")), "nation", "left_semi")
    return serving.flagged(g.select("appid"), mine)


@query(with_("p", "select recommendationid, votes_up from p where appid = 0 and (votes_up < 80 or (votes_up = 80 and recommendationid < 500)) order by votes_up desc, recommendationid desc limit 21"))
def reviews_helpful_page(t: Tables) -> DataFrame:
    return serving.helpful(t.playtimes().filter("appid = 0"), 21, (80, 500)).select("recommendationid", "votes_up")


@query(with_("p t", "select recommendationid, votes_up from p where recommendationid in (select recommendationid from t where topic_id in (2, 5)) order by votes_up desc, recommendationid desc limit 40"))
def reviews_by_topic(t: Tables) -> DataFrame:
    hits = t.topics().filter("topic_id in (2, 5)").select("recommendationid").distinct()
    return serving.helpful(t.playtimes().join(hits, "recommendationid", "left_semi"), 40).select("recommendationid", "votes_up")


@query(with_("p", "select appid, recommendationid, votes_up, rn from (select *, row_number() over (partition by appid order by votes_up desc, recommendationid desc) rn from p) where rn <= 4"))
def representative_reviews(t: Tables) -> DataFrame:
    w = Window.partitionBy("appid").orderBy(F.desc("votes_up"), F.desc("recommendationid"))
    return t.playtimes().withColumn("rn", F.row_number().over(w)).filter("rn <= 4").select("appid", "recommendationid", "votes_up", F.col("rn").cast("bigint").alias("rn"))


@query(with_("p", "select recommendationid, votes_up, count(*) over () total_count from p where language_code = 'en' order by votes_up desc, recommendationid desc limit 40"))
def selected_with_total(t: Tables) -> DataFrame:
    return serving.with_total(t.playtimes().filter("language_code = 'en'").select("recommendationid", "votes_up"), [F.desc("votes_up"), F.desc("recommendationid")], 40)


@query(with_("ds", ", lim as (select cast('2024-01-01' as date) a, cast('2024-02-15' as date) b), s as (select cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) stat_date from lim) select s.stat_date, review_count, negative_count from s left join (select * from ds where appid = 1) d on d.stat_date = s.stat_date").replace(" , lim", ", lim"))
def trend_gap_fill(t: Tables) -> DataFrame:
    days = agg.daily_stat(t.reviews()).filter("appid = 1")
    return serving.calendar(days, "2024-01-01", "2024-02-15").select("stat_date", "review_count", "negative_count")


@query(with_("ds", ", s as (select cast(coalesce(sum(review_count), 0) as bigint) reviews, cast(coalesce(sum(negative_count), 0) as bigint) negatives, cast(coalesce(sum(new_review_count), 0) as bigint) new_reviews, cast(coalesce(sum(new_positive_count), 0) as bigint) new_positives, cast(coalesce(sum(edited_review_count), 0) as bigint) edited_reviews, cast(coalesce(sum(edited_positive_count), 0) as bigint) edited_positives from ds where appid = 1) select *, (new_positives + edited_positives) / cast(nullif(reviews, 0) as double) positive_ratio, round(100.0::double * (new_positives + edited_positives) / nullif(reviews, 0), 1) positive_rate, round(100.0::double * new_positives / nullif(new_reviews, 0), 1) new_rate, round(100.0::double * edited_positives / nullif(edited_reviews, 0), 1) edited_rate from s").replace(" , s as", ", s as"))
def trend_totals(t: Tables) -> DataFrame:
    return serving.totals(agg.daily_stat(t.reviews()).filter("appid = 1"))


@query(with_("ds", "select appid, cast(date_trunc('month', stat_date) as date) as month, cast(sum(review_count) as bigint) reviews, cast(sum(negative_count) as bigint) negatives from ds group by rollup (appid, month)"))
def trend_rollup(t: Tables) -> DataFrame:
    d = agg.daily_stat(t.reviews()).withColumn("month", F.trunc("stat_date", "month"))
    return d.rollup("appid", "month").agg(F.sum("review_count").alias("reviews"), F.sum("negative_count").alias("negatives"))


@query(with_("tl", "select * from (select *, row_number() over (partition by appid order by published_ts, gid) ordinal, count(*) over (partition by appid) patch_count from tl) where published_ts >= 820454400 and published_ts < 883612800"))
def patch_ordinals(t: Tables) -> DataFrame:
    return serving.patch_ordinals(t.timeline(), 820454400, 883612800).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(with_("tl", ", x as (select *, (published_ts - lag(published_ts) over w) / 86400.0::double prev_days, (lead(published_ts) over w - published_ts) / 86400.0::double next_days from tl window w as (partition by appid order by published_ts, gid)) select appid, gid, round(prev_days, 6) prev_days, round(next_days, 6) next_days, round(avg(prev_days) over (partition by appid order by published_ts, gid rows between unbounded preceding and current row), 6) mean_days from x").replace(" , x as", ", x as"))
def patch_cycles(t: Tables) -> DataFrame:
    out = serving.patch_cycles(t.timeline())
    return out.select("appid", "gid", *(F.round(c, 6).alias(c) for c in ("prev_days", "next_days", "mean_days")))


@query(with_("p", ", c as (select case language_code when 'koreana' then 'korean' else language_code end language_code, count(*) review_count, count(*) filter (voted_up) positive_count from p group by 1) select language_code, case language_code when 'korean' then 'Korean' else language_code end as name, review_count, positive_count, round(100.0::double * review_count / sum(review_count) over (), 1) share, round(100.0::double * positive_count / review_count, 1) positive_rate, review_count >= 30 enough from c").replace(" , c as", ", c as"))
def language_share(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("korean", "Korean"), ("koreana", "Korean")], "language_code string, name string")
    return serving.language_share(t.playtimes(), names)


@query(with_("bd pb", ", j as (select d.appid, d.band_no, b.recommendationid, b.voted_up from bd d left join pb b on b.appid = d.appid and b.band_no = d.band_no) select appid, band_no, count(recommendationid) review_count, count(*) filter (voted_up) positive_count from j group by grouping sets ((appid, band_no), (appid))").replace(" , j as", ", j as"))
def playtime_band_counts(t: Tables) -> DataFrame:
    p = t.playtimes()
    bands = agg.band_bounds(p)
    return serving.band_counts(bands, agg.assign_band(p, bands))


GRID_SQL = with_("bd pb t", ", m as (select b.appid, b.band_no, x.topic_id, count(*) mentions from pb b join t x on x.recommendationid = b.recommendationid group by 1, 2, 3), grid as (select d.appid, d.band_no, k.topic_id, coalesce(m.mentions, 0) mentions from bd d cross join (values (1), (2), (3), (4), (5)) k(topic_id) left join m on m.appid = d.appid and m.band_no = d.band_no and m.topic_id = k.topic_id)").replace(" , m as", ", m as")


def _grid(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.playtimes()
    bands = agg.band_bounds(p)
    placed = agg.assign_band(p, bands)
    mentions = placed.join(t.topics().select("recommendationid", "topic_id"), "recommendationid")
    return serving.topic_grid(bands, t.topic_codes(), mentions), serving.band_counts(bands, placed).filter("band_no is not null")


@query(GRID_SQL + " select * from grid")
def playtime_topic_grid(t: Tables) -> DataFrame:
    return _grid(t)[0]


@query(GRID_SQL + ", c as (select appid, band_no, count(*) n from pb where band_no is not null group by 1, 2) select g.appid, g.topic_id, g.band_no, round(g.mentions / cast(c.n as double), 6) rate from grid g join c on c.appid = g.appid and c.band_no = g.band_no qualify row_number() over (partition by g.appid, g.topic_id order by g.mentions / cast(c.n as double) desc, g.band_no) = 1")
def topic_highest_band(t: Tables) -> DataFrame:
    return serving.highest_band(*_grid(t)).withColumn("rate", F.round("rate", 6))


@query(with_("bd", ", x as (select * from bd where not (appid = 3 and band_no = 2)), y as (select *, lag(playtime_to) over (partition by appid order by band_no) b from x) select appid, count(*) n_bands, count(*) filter ((band_no = 1 and playtime_from <> 0) or (band_no > 1 and b is distinct from playtime_from) or ((band_no = 4) <> (playtime_to is null))) n_wrong from y group by 1 having count(*) <> 4 or n_wrong > 0").replace(" , x as", ", x as"))
def band_boundary_check(t: Tables) -> DataFrame:
    return serving.broken_bands(agg.band_bounds(t.playtimes()).filter("not (appid = 3 and band_no = 2)"))


@query("with pg as (select o_orderkey plan_id, o_orderdate created_at from orders where o_orderdate < timestamp '1997-06-01' order by 2 desc, 1 desc limit 20) select plan_id, created_at, cast(left('plan ' || plan_id, 200) as varchar) preview, count(l_orderkey) slot_count, count(distinct case when l_returnflag <> 'N' then l_linestatus || l_returnflag end) confirmed_kinds from pg left join lineitem on l_orderkey = plan_id group by 1, 2")
def plan_page_slots(t: Tables) -> DataFrame:
    plans = t.raw("orders").filter("o_orderdate < timestamp_ntz'1997-06-01 00:00:00'").select(F.col("o_orderkey").alias("plan_id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("plan "), F.col("o_orderkey").cast("string")).alias("raw_text"))
    slots = t.raw("lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.col("l_returnflag") != "N").alias("confirmed"), F.concat("l_linestatus", "l_returnflag").alias("kind"))
    return serving.plan_page(plans, slots, 20)


# ---- search ----------------------------------------------------------------------------

KNN_SQL = with_("ch", ", q as (select id slot, vector qv from ch where id % 100 = 0), s as (select slot, c.id, c.gid, c.label, list_cosine_similarity(cast(c.vector as double[]), cast(q.qv as double[])) cosine from ch c, q {where}), k as (select *, row_number() over (partition by slot order by cosine desc, id) rank from s qualify rank <= 30)").replace(" , q as", ", q as")


def _queries(t: Tables) -> DataFrame:
    return t.chunks().filter("id % 100 = 0").select(F.col("id").alias("slot"), "vector")


@query(KNN_SQL.format(where="") + " select slot, id, round(cosine, 5) cosine from k where rank <= 10")
def case_knn(t: Tables) -> DataFrame:
    return search.nearest(t.chunks(), _queries(t), 10).select("slot", "id", F.round("cosine", 5).alias("cosine"))


def _filtered(t: Tables) -> DataFrame:
    """Filters before the neighbours: chunks with an 'add' change that is valid."""
    changes = t.chunks().select("id", F.when(F.col("label") % 2 == 0, "add").otherwise("modify").alias("change_type"), F.lit("up").alias("direction"), F.when(F.col("id") % 5 == 0, "invalid").otherwise("valid").alias("validation_status"))
    return search.nearest(search.with_qualifying_change(t.chunks(), changes, "add"), _queries(t), 30)


FILTERED = KNN_SQL.format(where="where c.label % 2 = 0 and c.id % 5 <> 0")


@query(FILTERED + " select slot, id, round(cosine, 5) cosine from k")
def case_knn_filtered(t: Tables) -> DataFrame:
    return _filtered(t).select("slot", "id", F.round("cosine", 5).alias("cosine"))


BEST = FILTERED + ", best as (select * from k qualify row_number() over (partition by gid order by cosine desc, id) = 1)"


@query(BEST + " select gid, id, round(cosine, 5) cosine from best")
def case_best_per_patch(t: Tables) -> DataFrame:
    return search.best_per_patch(_filtered(t)).select("gid", "id", F.round("cosine", 5).alias("cosine"))


@query(BEST + " select gid, case when d > 3 then 'improved' when d < -3 then 'worsened' else 'steady' end outcome, round(greatest(0, least(1, round(cosine, 4))) * 1000) / 10 similarity from (select *, cast(gid % 11 as double) - 5 d from best)")
def case_outcomes(t: Tables) -> DataFrame:
    best = search.best_per_patch(_filtered(t)).withColumn("delta_pct", (F.col("gid") % 11).cast("double") - 5).withColumn("cosine", F.round("cosine", 4))
    return search.outcomes(best).select("gid", "outcome", "similarity")


@query("""with c as (select l_orderkey, case l_orderkey % 3 when 0 then 'improved' when 1 then 'worsened' else 'steady' end outcome, list(distinct l_linestatus || l_returnflag) kinds, list(distinct l_returnflag) targets, list(distinct l_linestatus) directions from lineitem group by 1),
b as (select outcome, count(*) cases, avg(case when len(kinds) > 1 then 1.0::double else 0 end) multi_share from c group by 1 having count(*) >= 20),
mt as (select outcome, x from (select outcome, unnest(targets) x from c) group by 1, 2 qualify row_number() over (partition by outcome order by count(*) desc, x) = 1),
md as (select outcome, x from (select outcome, unnest(directions) x from c) group by 1, 2 qualify row_number() over (partition by outcome order by count(*) desc, x) = 1)
select b.outcome, cases, round(multi_share, 6) multi_share, mt.x modal_targets, md.x modal_directions, multi_share >= 0.5 mostly_multi from b left join mt on mt.outcome = b.outcome left join md on md.outcome = b.outcome""")
def case_patterns(t: Tables) -> DataFrame:
    name = F.element_at(F.array(F.lit("improved"), F.lit("worsened"), F.lit("steady")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    cases = t.raw("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_linestatus", "l_returnflag")).alias("kinds"), F.collect_set("l_returnflag").alias("targets"), F.collect_set("l_linestatus").alias("directions")).withColumn("outcome", name)
    return search.patterns(cases).withColumn("multi_share", F.round("multi_share", 6))


@query("select l_orderkey gid, l_linenumber change_seq, coalesce(n_name, 'unknown') target from lineitem left join nation on n_nationkey = l_suppkey % 30")
def change_codes_join(t: Tables) -> DataFrame:
    codes = t.raw("nation").select("n_nationkey", "n_name")
    codes = F.broadcast(codes) if codes.count() <= notices.CODE_ROWS else codes
    return t.raw("lineitem").join(codes, F.col("l_suppkey") % 30 == F.col("n_nationkey"), "left").select(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("change_seq"), F.coalesce("n_name", F.lit("unknown")).alias("target"))


# ---- trends ----------------------------------------------------------------------------


@query(with_("dy", """, n as (select *, row_number() over (partition by appid order by stat_date) rn, count(*) over (partition by appid) n, greatest(1, n // 3) k from dy),
f as (select appid, count(*) n_days, cast(sum(reviews) as bigint) reviews, cast(sum(positives) as bigint) positives, sum(positives) filter (rn <= k) / cast(nullif(sum(reviews) filter (rn <= k), 0) as double) head_ratio, sum(positives) filter (rn > n - k) / cast(nullif(sum(reviews) filter (rn > n - k), 0) as double) tail_ratio from n group by 1),
pk as (select appid, stat_date peak_date, reviews peak_reviews from dy qualify row_number() over (partition by appid order by reviews desc, stat_date) = 1),
lw as (select appid, stat_date lowest_date, positives / cast(reviews as double) lowest_ratio from dy where reviews >= 10 qualify row_number() over (partition by appid order by positives / cast(reviews as double), stat_date) = 1)
select f.appid, n_days, reviews, positives, round(head_ratio, 8) head_ratio, round(tail_ratio, 8) tail_ratio, peak_date, peak_reviews, lowest_date, round(lowest_ratio, 8) lowest_ratio from f left join pk on pk.appid = f.appid left join lw on lw.appid = f.appid""").replace(" , n as", ", n as"))
def trend_facts(t: Tables) -> DataFrame:
    out = trends.facts(t.days())
    return out.select("appid", "n_days", "reviews", "positives", F.round("head_ratio", 8).alias("head_ratio"), F.round("tail_ratio", 8).alias("tail_ratio"), "peak_date", "peak_reviews", "lowest_date", F.round("lowest_ratio", 8).alias("lowest_ratio"))


@query(with_("ef", "select gid, appid, patch_date, round(before, 8) before, round(after, 8) after, round(delta, 8) delta from ef"))
def patch_effect(t: Tables) -> DataFrame:
    out = trends.effect(t.days(), t.patch_days())
    return out.select("gid", "appid", "patch_date", *(F.round(c, 8).alias(c) for c in ("before", "after", "delta")))


@query(with_("ef mv", "select e.gid, e.appid, e.patch_date, min(case when ahead >= 0.9 * before then stat_date end) recovered_on, date_diff('day', e.patch_date, min(case when ahead >= 0.9 * before then stat_date end)) as days from ef e join mv on mv.appid = e.appid and stat_date >= patch_date where delta < 0 group by 1, 2, 3"))
def trend_recovery(t: Tables) -> DataFrame:
    d = t.days()
    return trends.recovery(d, trends.effect(d, t.patch_days()), 1).withColumn("days", F.col("days").cast("bigint")).drop("pct_of_before")


@query(with_("ef mv", ", x as (select e.*, stat_date, ahead, row_number() over (partition by e.gid order by stat_date) rn from ef e join mv on mv.appid = e.appid and stat_date >= patch_date where delta > 0 and ahead is not null) select gid, appid, patch_date, coalesce(min(case when ahead <= before then rn end) - 1, count(*)) days_held, round(max(ahead), 8) peak, count(*) filter (ahead <= before) = 0 to_the_end from x group by 1, 2, 3").replace(" , x as", ", x as"))
def trend_hold(t: Tables) -> DataFrame:
    d = t.days()
    out = trends.hold(d, trends.effect(d, t.patch_days()), 1)
    return out.select("gid", "appid", "patch_date", "days_held", F.round("peak_after", 8).alias("peak"), "to_the_end")


WHOLE = """, m as (select appid, stat_date, case when sum(reviews) over w >= 10 then sum(positives) over w / cast(sum(reviews) over w as double) end ahead from dy window w as (partition by appid order by stat_date rows between current row and 6 following)),
x as (select e.*, stat_date, ahead, ahead {fails} before is true hit from ef e join m on m.appid = e.appid and stat_date >= patch_date where delta {sign} 0 {known}), """
VIA = "coalesce((select string_agg(cast(d as varchar), ',' order by d) from (select distinct patch_date d, appid a from pd) k where k.a = z.appid and d > z.patch_date and d <= {until}), '') via"


@query(with_("ef", (WHOLE.format(fails=">= 0.9 *", sign="<", known="") + "z as (select gid, appid, patch_date, min(case when hit then stat_date end) recovered_on, least(round(100 * coalesce(arg_min(ahead, stat_date) filter (hit), max(ahead)) / any_value(before)), 999)::int pct_of_before from x group by 1, 2, 3) select gid, appid, patch_date, recovered_on, date_diff('day', patch_date, recovered_on) as days, pct_of_before, " + VIA.format(until="z.recovered_on") + " from z")).replace(" , m as", ", m as"))
def trend_recovery_whole(t: Tables) -> DataFrame:
    """trend_recovery without windows of under ten reviews, with the share of before and the patches between."""
    d, p = t.days(), t.patch_days()
    out = trends.with_via(trends.recovery(d, trends.effect(d, p)), p, "recovered_on").withColumn("days", F.col("days").cast("bigint"))
    return out.select("gid", "appid", "patch_date", "recovered_on", "days", "pct_of_before", F.array_join("via", ",").alias("via"))


@query(with_("ef", (WHOLE.format(fails="<=", sign=">", known="and ahead is not null") + "y as (select *, count(*) filter (hit) over (partition by gid order by stat_date) = 0 held from x), z as (select gid, appid, patch_date, count(*) filter (held) days_held, max(ahead) filter (held) peak, max(stat_date) filter (held) held_until, count(*) filter (hit) = 0 to_the_end from y group by 1, 2, 3) select gid, appid, patch_date, days_held, round(peak, 8) peak, held_until, to_the_end, " + VIA.format(until="z.held_until") + " from z")).replace(" , m as", ", m as"))
def trend_hold_whole(t: Tables) -> DataFrame:
    """trend_hold without windows of under ten reviews, with the peak while it held and the patches between."""
    d, p = t.days(), t.patch_days()
    out = trends.with_via(trends.hold(d, trends.effect(d, p)), p, "held_until").withColumn("peak", F.round("peak", 8))
    return out.select("gid", "appid", "patch_date", "days_held", "peak", "held_until", "to_the_end", F.array_join("via", ",").alias("via"))


@query(with_("dy pd", """, p as (select *, lead(patch_date) over (partition by appid order by patch_date, gid) nd from pd),
x as (select p.*, stat_date, reviews, stat_date >= patch_date and (nd is null or stat_date < nd) late from p join dy d on d.appid = p.appid and stat_date >= patch_date - 7 and stat_date < patch_date + 7),
b as (select gid, appid, patch_date, avg(reviews) filter (stat_date < patch_date) base, avg(reviews) filter (late) mean_after from x group by 1, 2, 3 having base > 0),
y as (select b.gid, reviews, base, row_number() over (partition by b.gid order by stat_date) rn from b join x on x.gid = b.gid and late),
z as (select gid, coalesce(min(case when reviews < 1.5 * base then rn end) - 1, count(*)) run_days from y group by 1)
select b.gid, appid, patch_date, round(base, 8) base, round(mean_after / base, 8) ratio, coalesce(run_days, 0) run_days, coalesce(mean_after / base >= 1.2, false) and coalesce(run_days, 0) >= 1 surged from b left join z on z.gid = b.gid""").replace(" , p as", ", p as"))
def trend_surge(t: Tables) -> DataFrame:
    out = trends.surge(t.days(), t.patch_days())
    return out.withColumn("base", F.round("base", 8)).withColumn("ratio", F.round("ratio", 8))


# ---- order-dependent and scalar --------------------------------------------------------


@query("select doc_id, source, row_number() over (partition by source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) order by doc_id) = 1 is_first from documents")
def dedup_sentences(t: Tables) -> DataFrame:
    return serving.first_occurrence(t.raw("documents").select("doc_id", "source", "text"), ["source"], "text", [F.asc("doc_id")]).select("doc_id", "source", "is_first")


@query("select o_orderkey, (row_number() over (order by o_orderpriority, o_orderdate desc, o_orderkey) - 1) % 4 shard from orders")
def priority_shards(t: Tables) -> DataFrame:
    return serving.shards(t.raw("orders"), [F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")], 4).select("o_orderkey", F.col("shard").cast("bigint").alias("shard"))


@query(with_("p", ", x as (select appid, recommendationid, row_number() over w n, sum(playtime) over (w rows between unbounded preceding and current row) s from p window w as (partition by appid order by votes_up desc, recommendationid)), y as (select *, min(case when s > 52000 then n end) over (partition by appid) o from x) select appid, recommendationid from y where o is null or n < o or n = 1").replace(" , x as", ", x as"))
def budget_prefix(t: Tables) -> DataFrame:
    return serving.budget_prefix(t.playtimes(), ["appid"], [F.desc("votes_up"), F.asc("recommendationid")], F.col("playtime"), 52_000).select("appid", "recommendationid")


@query("select p_partkey, p_name from part order by md5(p_partkey || ':42'), p_partkey limit 20")
def seeded_sample(t: Tables) -> DataFrame:
    return serving.seeded_sample(t.raw("part"), "p_partkey", 42, 20).select("p_partkey", "p_name")


@query("with x as (select o_custkey, list(distinct o_orderpriority) a from orders where o_orderstatus = 'F' group by 1), y as (select o_custkey, list(distinct o_orderpriority) b from orders where o_orderstatus <> 'F' group by 1) select o_custkey, array_to_string(list_sort(list_intersect(a, b)), ',') shared, array_to_string(list_sort(list_filter(a, lambda v: not list_contains(b, v))), ',') only_a, array_to_string(list_sort(list_filter(b, lambda v: not list_contains(a, v))), ',') only_b from x join y using (o_custkey)")
def set_parts(t: Tables) -> DataFrame:
    o = t.raw("orders")
    a = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"))
    b = o.filter("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("b"))
    parts = a.join(b, "o_custkey").select("o_custkey", *search.set_parts(F.col("a"), F.col("b")))
    return parts.select("o_custkey", *(F.array_join(c, ",").alias(c) for c in ("shared", "only_a", "only_b")))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 5) length, round(embedding[1] / sqrt(list_sum(list_transform(embedding[1:16], lambda x: cast(x as double) * x))), 5) first_of_16 from embeddings")
def vector_norms(t: Tables) -> DataFrame:
    v = F.col("embedding")
    return t.raw("embeddings").select("vec_id", F.round(vectors.norm(v), 5).alias("length"), F.round(vectors.truncated(v, 16)[0], 5).alias("first_of_16"))


@query(with_("r", "select event_id, cast(make_timestamp((updated_ts + 32400) * 1000000) as date) kst_day, strftime(make_timestamp((updated_ts + 32400) * 1000000), '%Y-%m-%d') dt, strftime(make_timestamp((updated_ts + 32400) * 1000000), '%H') hh, (updated_ts + 32400) // 86400 * 86400 - 32400 day_start from r"))
def time_rules(t: Tables) -> DataFrame:
    return t.reviews().select("event_id", times.kst_date("updated_ts").alias("kst_day"), times.partition_of("updated_ts").alias("dt"), times.hour_bucket("updated_ts").alias("hh"), times.day_start(times.kst_date("updated_ts")).alias("day_start"))


@query("select source, round(100.0::double * count(*) filter (quality = 1) / nullif(count(quality), 0), 2) pct, case when round(100.0::double * count(*) filter (quality = 1) / nullif(count(quality), 0) - 85, 4) > 3 then 'improved' when round(100.0::double * count(*) filter (quality = 1) / nullif(count(quality), 0) - 85, 4) < -3 then 'worsened' when count(quality) > 0 then 'steady' end outcome, case when count(distinct lang) = 1 then min(lang) else 'mixed' end lang from documents left join labels using (doc_id) group by 1")
def rates_and_buckets(t: Tables) -> DataFrame:
    g = t.raw("documents").join(t.raw("labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count("quality").alias("n"), F.collect_set("lang").alias("langs"))
    return g.select("source", rates.percent2(F.col("good"), F.col("n")).alias("pct"), rates.outcome(F.round(rates.percent(F.col("good"), F.col("n")) - 85, 4)).alias("outcome"), rates.single_or_mixed(F.col("langs")).alias("lang"))


# ---- text rules and models (not expressible in SQL unless noted) -----------------------


def _plain_sql() -> str:
    out = "coalesce(html, '')"
    for pattern, by in notices.MARKUP:
        by = by.replace("'", "''").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return f"select page_id, trim(regexp_replace({out}, '^\\n+|\\n+$', '', 'g')) body from pages"


@query(_plain_sql())
def plain_text(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", notices.plain_text(F.col("html")).alias("body"))


def _notices(t: Tables) -> DataFrame:
    """Conversations as notices: the turn's first words are the title, markers make some patches."""
    c = t.raw("conversations")
    kind = F.element_at(F.array(*map(F.lit, ("Patch 1.", "Update ", "Community update ", "Beta ", ""))), (F.pmod("conv_id", F.lit(5)) + 1).cast("int"))
    body = F.concat(F.lit("## Fixes\n- Fixed a crash when the map loads.\n- Increased sword damage from 10 to 12.\n"), F.coalesce("text", F.lit("")))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("gid"), F.concat(kind, F.left("text", F.lit(30))).alias("title"), F.when(F.pmod("turn", F.lit(2)) == 0, body).otherwise(F.col("text")).alias("contents"), F.when(F.pmod("conv_id", F.lit(7)) == 0, "patchnotes, other").alias("tags"))


NOTICES_SQL = """select concat_ws('-', conv_id, turn) gid, ['Patch 1.', 'Update ', 'Community update ', 'Beta ', ''][conv_id % 5 + 1] || left(text, 30) title,
case when turn % 2 = 0 then '## Fixes' || chr(10) || '- Fixed a crash when the map loads.' || chr(10) || '- Increased sword damage from 10 to 12.' || chr(10) || coalesce(text, '') else text end contents,
case when conv_id % 7 = 0 then 'patchnotes, other' end tags from conversations"""


@query(notices_sql.judged(NOTICES_SQL))
def notice_classify(t: Tables) -> DataFrame:
    return notices.judged(_notices(t)).select("gid", "judgement.*")


@query()
def notice_sections(t: Tables) -> DataFrame:
    return notices.notice_sections(_notices(t), ["gid"], "contents")


@query()
def chunk_notices(t: Tables) -> DataFrame:
    return notices.notice_chunks(_notices(t), ["gid"], "contents", 300)


@query()
def change_extract(t: Tables) -> DataFrame:
    return notices.notice_changes(notices.notice_sections(_notices(t), ["gid"], "contents"), ["gid"], "section", "heading")


@query()
def rule_slots(t: Tables) -> DataFrame:
    chunked = notices.notice_chunks(_notices(t), ["gid"], "contents", 60)
    return notices.with_slots(chunked, "chunk", "heading").filter("s is not null").select("gid", "seq", "s.*")


@query()
def grounding_check(t: Tables) -> DataFrame:
    """Change rows over each item: grounded ones, and one false in each field or in its direction."""
    b = t.raw("benchmark").select("item_id", F.concat(F.lit("Increased sword damage from 10 to 12 in ranked play. "), F.coalesce("text", F.lit(""))).alias("text"), F.substr("text", F.lit(6), F.lit(40)).alias("quote"))
    true = {"action": "increase", "target": "sword", "attribute": "damage", "values": "from 10 to 12", "conditions": "in ranked play", "sentence": "Increased sword damage from 10 to 12 in ranked play."}
    false = {"target": {"target": "crossbow"}, "attribute": {"attribute": "fire rate"}, "values": {"values": "from 10 to 15"}, "conditions": {"conditions": "on weekends"}, "direction": {"action": "decrease"}, "sentence": {"sentence": "Increased bow damage."}}
    cases = [("true", true), *((k, true | v) for k, v in false.items())]
    rows = [F.struct(F.lit(k).alias("case"), *(F.lit(v).alias(n) for n, v in c.items())) for k, c in cases]
    blank = {n: F.lit(None).cast("string") for n in true} | {"sentence": F.col("quote")}
    rows.append(F.struct(F.lit("quote").alias("case"), *(c.alias(n) for n, c in blank.items())))
    changes = b.withColumn("c", F.explode(F.array(*rows))).select("item_id", "text", "c.*", F.lit("Weapons").alias("context"))
    return notices.with_refusal(changes.withColumn("conditions", F.array_compact(F.array("conditions")))).select("item_id", "case", "grounded", "refusal")


@query(r"select conv_id, turn, regexp_matches(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]') cjk, regexp_matches(text, '(?i)\b(because|caused by|due to|led to)\b') causal, regexp_matches(text, '(?i)\b(should|recommend|must|advise)\b') advice, regexp_matches(text, '(?m)^\s*(?:[-*•]|\d+[.)])\s') list_form, not regexp_matches(trim(text), '[.!?]$') no_ending, len(list_intersect(list_filter(list_transform(string_split_regex(text, '[\n.!?]+'), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: length(x) >= 20), ['the river runs down from the hill'])) > 0 echo from conversations where text is not null")
def summary_guards(t: Tables) -> DataFrame:
    return t.raw("conversations").filter("text is not null").select("conv_id", "turn", *(c.alias(k) for k, c in notices.guards(F.col("text"), F.lit("The River runs down from the hill. Nothing else.")).items()))


@query()
def topic_classify(t: Tables) -> DataFrame:
    """Out-of-fold probability of 'toxic' and the threshold nearest its prevalence."""
    rows = t.raw("documents").select("doc_id", "text").join(t.raw("labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    return topics.pick_threshold(topics.out_of_fold(rows, "text", "label", "doc_id"), "label")


@query("select doc_id, octet_length(encode(text)) > 30 and lang in ('en', 'de') long_enough from documents")
def language_whitelist(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", ((F.octet_length("text") > 30) & F.col("lang").isin("en", "de")).alias("long_enough"))


@query("select conv_id, max(case when turn = 0 then role end) first_role, count(*) turns, string_agg(role, '>' order by turn) path from conversations group by 1")
def ordered_blocks(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    return c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("first_role"), F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("path"))


@query("select event_id, cast(json_extract_string(props, '$.page') as varchar) page, json_extract_string(props, '$.k') k from events")
def json_projection(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


@query("select p_partkey, array_to_string(regexp_extract_all(p_name || ' 12 of 3.5% and 7 in 9', '(\\d+(?:\\.\\d+)?%?)', 1)[1:3], ',') nums, case when p_size > 25 then p_brand || ' was raised' else p_brand || ' was lowered' end sentence from part")
def text_scalars(t: Tables) -> DataFrame:
    p = t.raw("part")
    way = F.when(F.col("p_size") > 25, "increase").otherwise("decrease")
    return p.select("p_partkey", F.array_join(texts.numbers(F.concat("p_name", F.lit(" 12 of 3.5% and 7 in 9"))), ",").alias("nums"), texts.change_sentence(F.lit("modify"), way, F.col("p_brand")).alias("sentence"))


@query()
def greedy_batches(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select("conv_id", "turn", "text")
    return texts.batches(rows, "conv_id", "turn", "text", 600, 3).select("conv_id", "turn", "batch")


@query("select o_orderkey, o_totalprice, round((o_totalprice - min(o_totalprice) over w) / nullif(max(o_totalprice) over w - min(o_totalprice) over w, 0), 9) scaled from orders window w as (partition by o_custkey) qualify count(*) over w > 1")
def min_max_scaled(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    o = t.raw("orders").withColumn("n", F.count("*").over(w)).filter("n > 1")
    return o.select("o_orderkey", "o_totalprice", F.round(rates.min_max(F.col("o_totalprice"), w), 9).alias("scaled"))


@query(SQL["min_max_scaled"])
def min_max_scaled_all(t: Tables) -> DataFrame:
    """The name that min_max_scaled had while it took a fiftieth of the customers; the same rows now."""
    return min_max_scaled(t)
