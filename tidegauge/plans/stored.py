"""Sources and sinks as relations: written in a shared folder, read back, and held to SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import notices, serving
from tidegauge.plans.fixtures import Tables, with_
from tidegauge.plans.queries import _notices, query
from tidegauge.sources import landing, sinks
from tidegauge.sources.shared import scratch
from tidegauge.streaming import ingest

REVIEW = "appid bigint, recommendationid bigint, created_ts bigint, updated_ts bigint, collected_ts bigint, voted_up boolean"


def _reviews(t: Tables) -> DataFrame:
    return t.reviews().select("appid", "recommendationid", "created_ts", "updated_ts", "collected_ts", "voted_up")


@query(with_("r", "select case when event_id % 10 <> 3 then recommendationid end recommendationid, appid, created_ts, updated_ts, voted_up, cast(event_id % 7 as int) votes_up, collected_ts from r"))
def landed_reviews(t: Tables) -> DataFrame:
    """Landing pages of JSON, some with an id that isn't a number, in the lake's shape."""
    path = scratch(t.spark)
    r = t.reviews()
    ident = F.when(F.col("event_id") % 10 == 3, "none").otherwise(F.col("recommendationid").cast("string"))
    page = F.struct(ident.alias("recommendationid"), F.col("appid").cast("bigint").alias("appid"), F.col("created_ts").alias("timestamp_created"), F.col("updated_ts").alias("timestamp_updated"), "voted_up", (F.col("event_id") % 7).alias("votes_up"), "collected_ts")
    r.select(F.to_json(page).alias("value"), (F.col("event_id") % 3).alias("dt")).write.partitionBy("dt").option("compression", "gzip").text(path)
    return landing.landed_reviews(t.spark, path).select("recommendationid", "appid", "created_ts", "updated_ts", "voted_up", "votes_up", "collected_ts")


@query("select cast(o_orderkey as varchar) gid, o_orderpriority title, o_orderstatus || ',x' tags, o_custkey published_ts from orders")
def landed_notices(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    note = F.struct(F.col("o_orderkey").cast("string").alias("gid"), F.col("o_orderpriority").alias("title"), F.array("o_orderstatus", F.lit("x")).alias("tags"), F.col("o_custkey").alias("date"))
    t.raw("orders").select(F.to_json(note).alias("value")).write.text(path)
    return landing.landed_notices(t.spark, path).select("gid", "title", "tags", "published_ts")


@query(with_("r", "select appid, recommendationid, updated_ts, collected_ts from r"))
def lake_scan(t: Tables) -> DataFrame:
    """Base and delta of a lake as one table; a path that isn't there is left out."""
    path, r = scratch(t.spark), _reviews(t)
    r.filter("collected_ts % 4 <> 0").write.parquet(f"{path}/base")
    r.filter("collected_ts % 4 = 0").write.parquet(f"{path}/delta/dt=2024-01-01")
    missing = landing.existing(t.spark, [f"{path}/base", f"{path}/none"])
    if missing != [f"{path}/base"] or landing.pending(landing.partitions(t.spark, f"{path}/delta"), [], "2024-01-02") != ["2024-01-01"]:
        raise ValueError("partitions")
    return landing.lake(t.spark, f"{path}/base", f"{path}/delta", REVIEW).select("appid", "recommendationid", "updated_ts", "collected_ts")


@query(with_("v1", "select appid, recommendationid, updated_ts, collected_ts, voted_up from v1"))
def lake_compacted(t: Tables) -> DataFrame:
    """A lake after compaction: base and delta in buckets, without exact repeats."""
    path, r = scratch(t.spark), _reviews(t)
    r.filter("collected_ts % 4 <> 0").write.parquet(f"{path}/base")
    r.filter("collected_ts % 4 = 0 or collected_ts % 5 = 0").write.parquet(f"{path}/delta")
    sinks.compact(t.spark, f"{path}/base", f"{path}/delta", REVIEW)
    return landing.lake(t.spark, f"{path}/base", f"{path}/delta", REVIEW).select("appid", "recommendationid", "updated_ts", "collected_ts", "voted_up")


@query("select o_orderkey, o_custkey from orders where o_orderkey % 2 = 1")
def partition_overwrite(t: Tables) -> DataFrame:
    """One date's partition, written twice: the second replaces the first."""
    path, o = scratch(t.spark), t.raw("orders").select("o_orderkey", "o_custkey")
    sinks.write_partition(o, path, "2024-01-01", 10)
    return t.spark.read.parquet(sinks.write_partition(o.filter("o_orderkey % 2 = 1"), path, "2024-01-01", 500_000))


@query("select count(*) stored, count(*) found from orders")
def replaced_table(t: Tables) -> DataFrame:
    """A table swapped in whole; what is stored is what was written."""
    path, o = scratch(t.spark), t.raw("orders").select("o_orderkey")
    sinks.replace_table(o.limit(5), path)
    n = sinks.replace_table(o, path)
    return landing.finished(t.spark, path).agg(F.lit(n).cast("bigint").alias("stored"), F.count("*").alias("found"))


@query(with_("r", "select recommendationid, updated_ts, collected_ts, voted_up from r qualify row_number() over (partition by recommendationid order by updated_ts desc, collected_ts desc) = 1"))
def streamed_upsert(t: Tables) -> DataFrame:
    """Landed files streamed into a versioned table of latest versions, in three batches, one replayed."""
    path, r = scratch(t.spark), _reviews(t)
    merge = ingest.upsert_batches(f"{path}/table", ["recommendationid"], 4)
    for k in (2, 0, 1):
        r.filter(f"collected_ts % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{path}/in")
        ingest.run_available(ingest.stream(t.spark, f"{path}/in", REVIEW), f"{path}/mark", merge)
    merge(r.filter("collected_ts % 3 = 0"), 9)
    sinks.vacuum(t.spark, f"{path}/table")
    return sinks.read_table(t.spark, f"{path}/table", REVIEW).select("recommendationid", "updated_ts", "collected_ts", "voted_up")


@query("select o_orderkey, cast((row_number() over (order by o_orderpriority, o_orderkey) - 1) % 3 as int) shard from orders")
def sharded_lines(t: Tables) -> DataFrame:
    """JSON lines in shards dealt by priority, read back with their shard."""
    path = scratch(t.spark)
    dealt = serving.shards(t.raw("orders").select("o_orderkey", "o_orderpriority"), [F.asc("o_orderpriority"), F.asc("o_orderkey")], 3)
    sinks.write_shards(dealt.select("o_orderkey", "shard"), path)
    return landing.json_shards(t.spark, path, "o_orderkey bigint")


@query("select p_partkey::varchar as name, p_name title, p_brand || ' ü' body, p_type tags from part")
def audit_rows(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    row = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.base64(F.col("p_name").cast("binary")), F.base64(F.concat("p_brand", F.lit(" ü")).cast("binary")), "p_type")
    t.raw("part").select(row.alias("value")).write.text(path)
    return landing.audit_rows(t.spark, path)


@query("select c_custkey appid, trim(c_name) title, case when c_custkey % 2 = 0 then c_mktsegment || ', B' else null end developer from customer where c_custkey % 9 <> 0 and c_acctbal > 0 order by 1")
def catalog_targets(t: Tables) -> DataFrame:
    """Catalogue entries with a name, of games with reviews."""
    raw = t.raw("customer").select(F.col("c_custkey").alias("appid"), F.when(F.col("c_custkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit(" B "))).otherwise(F.array(F.lit(" "))).alias("developers"), F.lit(0).alias("release_ts"), F.greatest(F.lit(0), F.ceil("c_acctbal")).alias("review_count"))
    return landing.targets(landing.catalog(raw)).select("appid", "title", "developer")


@query("select cast(o_orderkey as varchar) o_orderkey, cast(round(o_totalprice) as bigint) o_totalprice, try_cast(left(o_orderpriority, 1) as int) level from orders")
def typed_scan(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    t.raw("orders").select("o_orderkey", F.round("o_totalprice").alias("o_totalprice"), F.left("o_orderpriority", F.lit(1)).alias("level")).write.parquet(path)
    return landing.typed_scan(t.spark, path, {"o_orderkey": "string", "o_totalprice": "bigint", "level": "int"})


@query("select distinct o_custkey, case when o_custkey % 3 = 0 then null else o_custkey end as number from orders")
def converted_rows(t: Tables) -> DataFrame:
    raw = t.raw("orders").select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, "n/a").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("number"))
    return landing.converted(raw, ["o_custkey"], ["number"])


@query("select o_orderkey from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 <> 0")
def not_done(t: Tables) -> DataFrame:
    """Work whose key, model and input aren't in the done set, which holds repeats."""
    work = t.raw("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"), F.lit("m").alias("model"), F.col("o_orderstatus").alias("input_hash"))
    done = work.filter("o_orderkey % 3 = 0 and o_orderkey % 2 = 0")
    return ingest.not_done(work, done.unionByName(done)).select("o_orderkey")


@query(with_("r", ", pages as (select appid, recommendationid, event_id, updated_ts, cast(ceil(row_number() over (partition by appid order by updated_ts desc, event_id) / 20.0) as int) page from r), o as (select appid, page, min(updated_ts) oldest from pages group by 1, 2), s as (select appid, min(page) last_page from o where oldest < (select max(updated_ts) from r) - 864000 group by 1) select event_id from pages left join s using (appid) where last_page is null or page <= last_page").replace(" , pages as", ", pages as"))
def until_known(t: Tables) -> DataFrame:
    """Collected pages of each game down to the first that reaches known versions."""
    from pyspark.sql.window import Window

    r = t.reviews()
    pages = r.withColumn("page", F.ceil(F.row_number().over(Window.partitionBy("appid").orderBy(F.desc("updated_ts"), F.asc("event_id"))) / F.lit(20.0)).cast("int"))
    runs = r.agg(F.max("updated_ts").alias("started_ts")).withColumn("status", F.lit("COMPLETED"))
    return ingest.until_known(pages, ingest.watermark(runs, 864_000)).select("event_id")


def _slots_sql() -> str:
    at = lambda p: f"case when regexp_matches(line, '{p}') then length(regexp_extract(line, '(?is)^(.*?)(?:{p[4:]})', 1)) + 1 end"
    q = lambda p: p.replace("'", "''")
    cues = ", ".join(f"{{'at': {at(q(p))}, 'd': '{d}'}}" for d, p in notices.DIRECTIONS.items())
    counts = ", ".join(f"{{'n': len(regexp_extract_all(line, '{q(p)}')), 'k': {-k}, 't': '{t}'}}" for k, (t, p) in enumerate(notices.TARGETS.items()))
    number = lambda g: f"try_cast(replace(regexp_extract(line, '{q(notices.FROM_TO)}', {g}), ',', '') as double)"
    return rf"""with n as (select concat_ws('-', conv_id, turn) gid, case when turn % 2 = 0 then '## Fixes' || chr(10) || '- Fixed a crash when the map loads.' || chr(10) || '- Increased sword damage from 10 to 12.' || chr(10) || coalesce(text, '') else text end body from conversations),
l as (select gid, unnest(string_split(body, chr(10))) line, generate_subscripts(string_split(body, chr(10)), 1) - 1 seq from n),
f as (select gid, seq, line, list_sort(list_filter([{cues}], lambda c: c['at'] is not null))[1]['d'] cue, list_reverse_sort([{counts}])[1] best, {number(1)} a, {number(2)} b, regexp_matches(line, '(?i)\b(fixed|fix|resolved|corrected|addressed)\b') fix, regexp_matches(line, '(?i)\bdeprecat(ed|ion)\b') gone, len(list_filter(string_split_regex(line, '\s+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) >= 5 and not ends_with(rtrim(line), ':') states from l),
g as (select *, coalesce(cue, case when a < b then 'UP' when a > b then 'DOWN' when a = b then 'MODIFY' end) as label from f)
select gid, cast(seq as int) seq, case when label = 'ADD' then 'add' when label = 'REMOVE' and gone then 'deprecate' when label = 'REMOVE' then 'remove' when label = 'MODIFY' and fix then 'fix' else 'modify' end change_type, case when label in ('ADD', 'REMOVE') then 'none' when label = 'UP' then 'increase' when label = 'DOWN' then 'decrease' when fix then 'not_applicable' when b > a then 'increase' when b < a then 'decrease' when a = b then 'none' else 'unknown' end direction, case when best['n'] > 0 then best['t'] else 'unknown' end target_type from g where states and label is not null"""


@query(_slots_sql())
def sentence_slots(t: Tables) -> DataFrame:
    """Slots of every line of the notices."""
    lines = _notices(t).select("gid", F.posexplode(F.split("contents", "\n")).alias("seq", "line"), F.lit("").alias("context"))
    return notices.with_slots(lines, "line", "context").filter("s is not null").select("gid", "seq", "s.*")
