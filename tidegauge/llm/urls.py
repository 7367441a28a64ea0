"""Operator 5: URL filters with redirect equivalence.

Rules decide URLs by host suffix and path prefix, the longest rule first. URLs that are
aliases of one another, through canonical links, meta refreshes or a table of redirects,
form components; a block decided by a rule anywhere in a component blocks the aliases that
no rule decides, unless the component holds a URL that a rule explicitly allows: an allow
takes precedence over propagated blocks. A URL's own rule always wins over its component.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule
and no aliases, and is allowed; null html has no links; repeated rows are judged alike,
each on its own row; extra columns are ignored; an empty table gives an empty result. A
relative link resolves against its page; a fragment is no part of an alias's name. All
canonical links and refreshes of a page count, but none in comments, scripts or styles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.components import connected_components
from tidegauge.llm.shared import cut, table

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rules become one expression; longer lists would outgrow generated code.
MAX_RULES = 300
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


def after_scheme(url: F.Column) -> F.Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    rest = F.regexp_replace(after_scheme(url), r"^[^/?#]*", "")
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))


def node_of(url: F.Column) -> F.Column:
    """A URL's name among aliases: host, path and query; null if it has no ``://``."""
    tail = F.regexp_replace(after_scheme(url), r"^[^/?#]*", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.regexp_extract(tail, r"^[^#]*", 0)))


def resolved(links: DataFrame) -> DataFrame:
    """``links`` (page, link, both URLs or null) with ``target``: the absolute URL of the link."""
    parts = links.select("page", "link", F.regexp_extract("page", r"^(?s)(.*?)://", 1).alias("scheme"), host_of(F.col("page")).alias("host"), path_of(F.col("page")).alias("path"))
    parts = parts.withColumn("base", F.concat("scheme", F.lit("://"), "host")).withColumn("folder", F.regexp_replace("path", r"[^/]*$", ""))
    link = F.col("link")
    target = (
        F.when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat("scheme", F.lit(":"), link))
        .when(link.startswith("/"), F.concat("base", link))
        .when(link.startswith("?"), F.concat("base", "path", link))
        .when(link.startswith("#"), F.col("page"))
        .otherwise(F.concat("base", F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")), link))
    )
    return parts.select("page", target.alias("target"))


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): names of URLs joined by a canonical link or a meta refresh."""
    url, html = F.col(url_col), F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), HIDDEN, "")
    links = F.array_distinct(F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (CANONICAL, REFRESH))))
    found = pages.select(url.alias("page"), F.explode(F.filter(links, lambda x: x != "")).alias("link")).filter(F.instr("page", "://") > 0)
    return resolved(found.withColumn("link", F.regexp_replace("link", "&amp;", "&"))).select(node_of(F.col("page")).alias("a"), node_of(F.col("target")).alias("b"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict of each row. redirects: two columns of URLs, if any."""
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges = edges.unionByName(redirects.select(node_of(F.col(a)).alias("a"), node_of(F.col(b)).alias("b")))
    edges = cut(edges, "aliases").filter("a is not null and b is not null and a <> b").distinct()
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"), node_of(F.col(url_col)).alias("node"))
    judged = parsed.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        return judged.select(id_col, "host", "path", "own.rule", F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    nodes = connected_components(edges)
    name = F.concat(F.lit("x://"), F.col("node"))
    by_rule = nodes.withColumn("host", host_of(name)).withColumn("path", path_of(name)).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    decided = by_rule.groupBy("component").agg(F.max((F.col("own.verdict") == "allow").cast("int")).alias("allow"), F.max((F.col("own.verdict") == "block").cast("int")).alias("block")).filter("block = 1 and coalesce(allow, 0) = 0")
    blocked = nodes.join(decided, "component").select("node", F.lit("block").alias("propagated"))
    return judged.join(blocked, "node", "left").select(id_col, "host", "path", "own.rule", F.coalesce("own.verdict", "propagated", F.lit("allow")).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _op5_sql() -> str:
    def parsed(url: str) -> str:
        rest = f"case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end"
        host = f"regexp_extract(coalesce({rest}, ''), '^[^/?#]*')"
        return f"translate({host}, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(coalesce({rest}, ''), length({host}) + 1), '^[^?#]*') as path, case when instr({url}, '://') > 0 then translate({host}, '{UPPER}', '{LOWER}') || regexp_extract(substr({rest}, length({host}) + 1), '^[^#]*') end as node"

    rules = " union all ".join(f"select '{v}' verdict, '{h}' rhost, '{p}' rpath" for v, h, p in RULES)
    best = "(select {0} from rules where (x.host = rhost or ends_with(x.host, '.' || rhost)) and starts_with(x.path, rpath) order by length(rhost || rpath) desc, length(rhost) desc, verdict limit 1)"
    return f"""
with recursive rules as ({rules}),
shown as (select url page, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') html from pages where instr(url, '://') > 0),
links as (
    select page, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?\\s*canonical\\b[^>]*\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
        || regexp_extract_all(html, '(?is)<link\\b[^>]*\\bhref\\s*=\\s*["'']?([^"''\\s>]+)[^>]*\\brel\\s*=\\s*["'']?\\s*canonical\\b', 1)
        || regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b[^>]*\\bcontent\\s*=\\s*["'']?[^"''>]*?\\burl\\s*=\\s*([^"''\\s>]+)', 1)
        || regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bcontent\\s*=\\s*["'']?[^"''>]*?\\burl\\s*=\\s*([^"''\\s>]+)[^>]*\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b', 1)) link from shown
),
ends as (select page, case when instr(replace(link, '&amp;', '&'), '://') > 0 then replace(link, '&amp;', '&')
        when starts_with(link, '//') then regexp_extract(page, '^(.*?)://', 1) || ':' || link
        when starts_with(link, '/') then regexp_extract(page, '^(.*?://[^/?#]*)', 1) || link
        else regexp_extract(page, '^(.*?://[^/?#]*(/[^?#]*/)?)', 1) || link end link from links where link <> ''),
pairs as (select p.node a, l.node b from (select page, link, {parsed('page')} from ends) p
          join (select page, link, {parsed('link')} from ends) l on p.page = l.page and p.link = l.link where p.node <> l.node),
edges as (select a, b from pairs union select b, a from pairs),
reach as (select a, a b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
named as (select distinct x.node, {best.format('verdict')} verdict from (select a node, {parsed("('x://' || a)").replace(' as node', ' as ignored')} from edges) x),
state as (select r.a node, bool_or(n.verdict = 'allow') allowed, bool_or(n.verdict = 'block') blocked from reach r join named n on n.node = r.b group by 1),
x as (select page_id, {parsed('url')} from pages)
select x.page_id, x.host, x.path, {best.format('rhost || rpath')} as rule,
       coalesce({best.format('verdict')}, case when s.blocked and not coalesce(s.allowed, false) then 'block' end, 'allow') as verdict
from x left join state s on s.node = x.node
"""


OP5_SQL = _op5_sql()
