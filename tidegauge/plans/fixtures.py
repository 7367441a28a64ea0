"""Domain relations derived from the driver's tables: in Spark, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.times import ntz_seconds

RUN_AT, COVERAGE_START, COVERAGE_END = 4_000_000_000, 0, 4_000_000_000


class Tables:
    """The driver's tables and what is derived from them, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def reviews(self) -> DataFrame:
        """Review versions from events."""
        e = self.raw("events").select((F.col("user_id") % 12).alias("appid"), F.col("user_id").alias("recommendationid"), ntz_seconds("ts").alias("updated_ts"), F.col("event_id").alias("collected_ts"), (F.col("value") < 60).alias("voted_up"), "event_type", "event_id", "value")
        return e.withColumn("created_ts", F.min("updated_ts").over(Window.partitionBy("recommendationid")))

    def patches(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'signup'").select(F.col("event_id").alias("gid"), (F.col("user_id") % 12).alias("appid"), ntz_seconds("ts").alias("published_ts"))

    def playtime_versions(self) -> DataFrame:
        """Versions of reviews with playtime and language, one to three each, from documents and labels.

        The oldest of several arrives last; some of the latest lack a playtime or have a wrong one.
        """
        d, q = self.raw("documents"), self.raw("labels").select("doc_id", "quality")
        joined = d.join(q, "doc_id", "left").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
        ts = F.lit(1_700_000_000) + F.col("doc_id") * 60
        playtime = F.when(F.col("k") == F.col("doc_id") % 3, F.when(F.col("doc_id") % 37 == 2, F.lit(None)).when(F.col("doc_id") % 41 == 4, -1).otherwise(F.col("n_chars"))).otherwise(F.col("n_chars") + 1000 * (F.col("k") + 1))
        return joined.select(
            F.substr("source", F.lit(4)).cast("bigint").alias("appid"), F.col("doc_id").alias("recommendationid"), playtime.cast("int").alias("playtime"),
            F.when(F.col("doc_id") % 23 == 5, "koreana").otherwise(F.when(F.col("k") < F.col("doc_id") % 3, "unknown").otherwise(F.col("lang"))).alias("language_code"),
            ((F.coalesce("quality", F.lit(0)) + F.col("doc_id") % 3 - F.col("k")) % 2 == 1).alias("voted_up"), (ts + F.col("k") * 7200).alias("updated_ts"), ts.alias("created_ts"),
            (ts + F.when(F.col("k") == 0, 100_000).otherwise(F.col("k") * 7200 + 10)).alias("collected_ts"), (F.col("n_chars") % 97).alias("votes_up"),
        )

    def playtimes(self) -> DataFrame:
        """The latest version of each of those reviews."""
        from tidegauge.operators.versions import latest_reviews

        return latest_reviews(self.playtime_versions())

    def topics(self) -> DataFrame:
        """Topic assignments of those reviews."""
        d, q = self.raw("documents"), self.raw("labels")
        has = F.filter(F.array(F.when(F.col("quality") == 1, 1), F.when(F.col("toxic") == 1, 2), F.when(F.contains("text", F.lit("the")), 3), F.when(F.contains("text", F.lit("en")), 4), F.when(F.col("n_chars") > 2000, 5)), lambda x: x.isNotNull())
        return d.join(q, "doc_id", "left").select(F.substr("source", F.lit(4)).cast("bigint").alias("appid"), F.col("doc_id").alias("recommendationid"), (F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("updated_ts"), F.explode(has).alias("topic_id"))

    def topic_codes(self) -> DataFrame:
        return self.spark.range(1, 6).select(F.col("id").cast("int").alias("topic_id"))

    def games(self) -> DataFrame:
        """Games from customer, with review figures from their orders."""
        o = self.raw("orders").groupBy(F.col("o_custkey").alias("appid")).agg(F.count("*").alias("review_count"), F.count_if(F.col("o_orderstatus") == "F").alias("good"))
        return self.raw("customer").select(F.col("c_custkey").alias("appid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("developer"), F.col("c_acctbal").alias("price"), F.col("c_nationkey").alias("nation")).join(o, "appid", "left").select("appid", "title", "developer", "price", "nation", F.coalesce("review_count", F.lit(0)).alias("review_count"), F.when(F.col("review_count") > 0, F.round(100.0 * F.col("good") / F.col("review_count"), 2)).alias("positive_rate"))

    def tags(self) -> DataFrame:
        return self.raw("orders").groupBy(F.col("o_custkey").alias("appid"), F.col("o_orderpriority").alias("tag")).agg(F.count("*").alias("weight"))

    def timeline(self) -> DataFrame:
        """Patches of those games from their orders."""
        return self.raw("orders").select(F.col("o_custkey").alias("appid"), F.col("o_orderkey").alias("gid"), ntz_seconds("o_orderdate").alias("published_ts"))

    def days(self) -> DataFrame:
        from tidegauge.operators.aggregates import daily_stat

        d = daily_stat(self.reviews())
        return d.select("appid", "stat_date", F.col("review_count").alias("reviews"), (F.col("new_positive_count") + F.col("edited_positive_count")).alias("positives"))

    def patch_days(self) -> DataFrame:
        from tidegauge.functions.times import kst_date

        return self.patches().select("gid", "appid", kst_date("published_ts").alias("patch_date"))

    def chunks(self) -> DataFrame:
        """Chunk vectors with their patch and change from embeddings."""
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100).alias("gid"), "label", F.col("embedding").alias("vector"))


#: Common table expressions of the same relations.
SQL = {
    "r": "select user_id % 12 appid, user_id recommendationid, cast(floor(epoch(ts)) as bigint) updated_ts, event_id collected_ts, value < 60 voted_up, event_type, event_id, value, min(cast(floor(epoch(ts)) as bigint)) over (partition by user_id) created_ts from events",
    "pt": "select event_id gid, user_id % 12 appid, cast(floor(epoch(ts)) as bigint) published_ts from events where event_type = 'signup'",
    "pv": "select cast(substr(source, 4) as bigint) appid, doc_id recommendationid, cast(case when k < doc_id % 3 then n_chars + 1000 * (k + 1) when doc_id % 37 = 2 then null when doc_id % 41 = 4 then -1 else n_chars end as int) playtime, case when doc_id % 23 = 5 then 'koreana' when k < doc_id % 3 then 'unknown' else lang end language_code, (coalesce(quality, 0) + doc_id % 3 - k) % 2 = 1 voted_up, 1700000000 + doc_id * 60 + k * 7200 updated_ts, 1700000000 + doc_id * 60 created_ts, 1700000000 + doc_id * 60 + case when k = 0 then 100000 else k * 7200 + 10 end collected_ts, n_chars % 97 votes_up from documents left join (select doc_id, quality from labels) using (doc_id), (values (0), (1), (2)) ks(k) where k <= doc_id % 3",
    "p": "select * from pv qualify row_number() over (partition by appid, recommendationid order by updated_ts desc, collected_ts desc) = 1",
    "t": "select cast(substr(source, 4) as bigint) appid, doc_id recommendationid, 1700000000 + doc_id * 60 updated_ts, topic_id from documents left join labels using (doc_id), (values (1), (2), (3), (4), (5)) k(topic_id) where case topic_id when 1 then quality = 1 when 2 then toxic = 1 when 3 then contains(text, 'the') when 4 then contains(text, 'en') else n_chars > 2000 end",
    "g": "select c_custkey appid, c_name title, c_mktsegment developer, c_acctbal price, c_nationkey nation, coalesce(review_count, 0) review_count, case when review_count > 0 then round(100.0 * cast(good as double) / review_count, 2) end positive_rate from customer left join (select o_custkey, count(*) review_count, count(*) filter (o_orderstatus = 'F') good from orders group by 1) o on o_custkey = c_custkey",
    "tg": "select o_custkey appid, o_orderpriority tag, count(*) weight from orders group by 1, 2",
    "tl": "select o_custkey appid, o_orderkey gid, cast(floor(epoch(o_orderdate)) as bigint) published_ts from orders",
    "v1": "select * from r qualify row_number() over (partition by recommendationid, updated_ts order by collected_ts desc) = 1",
    "v2": "select *, cast(make_timestamp((updated_ts + 32400) * 1000000) as date) stat_date, cast(make_timestamp((created_ts + 32400) * 1000000) as date) first_date from v1 qualify row_number() over (partition by appid, recommendationid, stat_date order by updated_ts desc, collected_ts desc) = 1",
    "ds": "select appid, stat_date, count(*) review_count, count(*) filter (not voted_up) negative_count, count(*) filter (first_date = stat_date) new_review_count, count(*) filter (first_date = stat_date and voted_up) new_positive_count, count(*) filter (first_date <> stat_date) edited_review_count, count(*) filter (first_date <> stat_date and voted_up) edited_positive_count from v2 group by 1, 2",
    "dy": "select appid, stat_date, review_count reviews, new_positive_count + edited_positive_count positives from ds",
    "pd": "select gid, appid, cast(make_timestamp((published_ts + 32400) * 1000000) as date) patch_date from pt",
    "bb": "select appid, quantile_disc(playtime, 0.25) q1, quantile_disc(playtime, 0.5) q2, quantile_disc(playtime, 0.75) q3 from p where playtime >= 0 group by 1",
    "bd": "select appid, 1 band_no, 0 playtime_from, q1 playtime_to from bb union all select appid, 2, q1, q2 from bb union all select appid, 3, q2, q3 from bb union all select appid, 4, q3, null from bb",
    "pb": "select p.*, b.band_no from p left join bd b on b.appid = p.appid and p.playtime >= b.playtime_from and (b.playtime_to is null or p.playtime < b.playtime_to)",
    "ch": "select vec_id id, vec_id % 100 gid, label, embedding vector from embeddings",
    "ef": "select gid, appid, patch_date, b before, a after, a - b delta from (select p.gid, p.appid, p.patch_date, sum(positives) filter (d.stat_date < patch_date) / nullif(cast(sum(reviews) filter (d.stat_date < patch_date) as double), 0) b, sum(positives) filter (d.stat_date >= patch_date) / nullif(cast(sum(reviews) filter (d.stat_date >= patch_date) as double), 0) a from pd p join dy d on d.appid = p.appid and d.stat_date >= p.patch_date - 7 and d.stat_date < p.patch_date + 7 group by 1, 2, 3)",
    "mv": "select *, sum(positives) over w / nullif(cast(sum(reviews) over w as double), 0) ahead from dy window w as (partition by appid order by stat_date rows between current row and 6 following)",
}
NEEDS = {"p": "pv", "v1": "r", "v2": "r v1", "ds": "r v1 v2", "dy": "r v1 v2 ds", "pd": "pt", "bb": "pv p", "bd": "pv p bb", "pb": "pv p bb bd", "ef": "r v1 v2 ds dy pt pd", "mv": "r v1 v2 ds dy"}


def with_(names: str, query: str) -> str:
    """A query over the named expressions and those they need."""
    wanted: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, "").split(), n]:
            if x not in wanted:
                wanted.append(x)
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in wanted) + " " + query
