"""URL filtering by a temporal list join.

A list is a log of dated entries (pattern, action 'add' or 'drop', day). Per pattern the entries become validity
intervals [added, dropped), open at the end where nothing drops them; repeated adds and drops change nothing. A
capture matches a pattern if it is the capture's host, a parent domain of it, or such a domain with a leading
part of the path, and the as-of join keeps those whose interval holds the capture's fetch time. The join runs on
equal keys: a capture is exploded into its possible patterns, as many as it has labels and path parts (of these as
many as the list's deepest entry has), those that a filter of the list's patterns rules out go before any shuffle,
and the newest entry at or before the fetch time decides.

Null or hostless urls and null fetch times match nothing and are kept; repeated rows give equal results;
entries with null fields are ignored; adds and drops of one instant count as a drop. Extra columns are ignored;
empty lists keep everything and empty tables give no rows. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.common import member_filter, stored, table


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to): when each pattern is on the list; valid_to null: still."""
    changes = entries.where("pattern is not null and action in ('add', 'drop') and at is not null").groupBy(F.lower("pattern").alias("pattern"), "at").agg(F.min(F.col("action") == "add").alias("on"))
    by_time = Window.partitionBy("pattern").orderBy("at")
    turns = changes.withColumn("was", F.coalesce(F.lag("on").over(by_time), F.lit(False))).where("on <> was")
    return turns.withColumn("valid_to", F.lead("at").over(by_time)).where("on").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def patterns_of(url: Column, depth: int) -> Column:
    """All patterns that would match a url: parent domains, alone and with up to ``depth`` leading path parts."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(depth))), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), "/"))))
    return F.when(host_of(url) != "", F.array_distinct(F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, blocked, pattern, valid_from) of every capture; pattern: the longest active one."""
    listed = stored(intervals(entries), "url-intervals")
    depth = listed.agg(F.max(F.size(F.split("pattern", "/")))).first()[0] or 1
    known = member_filter(listed.select("pattern"))
    rows = captures.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "fetched_at")
    # keys that no capture can lack: urls are matched once for each (url, time), and the rows joined back
    asked = rows.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    asked = asked.select("url", "fetched_at", F.explode(patterns_of(F.col("url"), depth - 1)).alias("pattern")).where(known(F.col("pattern")))
    hits = asked.join(listed, "pattern").where((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    best = hits.groupBy("url", "fetched_at").agg(F.max(F.struct(F.length("pattern"), F.col("pattern"), F.col("valid_from"))).alias("m")).select("url", "fetched_at", "m.pattern", "m.valid_from")
    return rows.join(best, ["url", "fetched_at"], "left").select("page_id", "url", "fetched_at", F.col("pattern").isNotNull().alias("blocked"), "pattern", "valid_from")


#: The tables have neither a list nor fetch times, so both follow from the rows by rule: a third of the sites (hosts
#: without a leading www, m or blog) go on the list, each on a day of its own; half of those go off 60 days later, and
#: half of these come back after 60 more. Capture days run over 500 days by page_id.
def list_entries(pages: DataFrame) -> DataFrame:
    site = F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.", "")
    k = F.pmod(F.conv(F.substring(F.md5(F.col("site").cast("binary")), 1, 6), 16, 10).cast("bigint"), F.lit(360)).cast("int")
    sites = pages.select(site.alias("site")).where("site <> ''").distinct().select("site", k.alias("k"))
    entry = lambda every, action, later: sites.where(F.col("k") % every == 0).select(F.col("site").alias("pattern"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") + later).cast("timestamp_ntz").alias("at"))
    return entry(3, "add", 0).unionByName(entry(6, "drop", 60)).unionByName(entry(12, "add", 120))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("cast(date_add(date'2024-01-01', cast(pmod(page_id, 500) as int)) as timestamp_ntz)").alias("fetched_at"))
    out = filter_urls(captures, list_entries(pages))
    return out.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "blocked", "pattern", F.date_format("valid_from", "yyyy-MM-dd").alias("active_since"))


SQL = r"""
with captures as (
  select page_id, url, date '2024-01-01' + cast(((page_id % 500) + 500) % 500 as integer) as d,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') as host
  from pages),
sites as (
  select distinct regexp_replace(host, '^(www|m|blog)\.', '') as site from captures),
days as (
  select site, cast(cast('0x' || substr(md5(site), 1, 6) as bigint) % 360 as integer) as k from sites where site <> ''),
spells as (
  select site, date '2024-01-01' + k as a, case when k % 6 = 0 then date '2024-01-01' + (k + 60) end as b from days where k % 3 = 0
  union all
  select site, date '2024-01-01' + (k + 120), null from days where k % 12 = 0),
hits as (
  select c.page_id, c.d, s.site, s.a, row_number() over (partition by c.page_id order by length(s.site) desc, s.site desc, s.a desc) as r
  from captures c join spells s on (c.host = s.site or ends_with(c.host, '.' || s.site)) and s.a <= c.d and (s.b is null or c.d < s.b))
select c.page_id, c.url, strftime(c.d, '%Y-%m-%d') as fetched_on, h.site is not null as blocked, h.site as pattern, strftime(h.a, '%Y-%m-%d') as active_since
from captures c left join hits h on h.page_id = c.page_id and h.r = 1
"""
