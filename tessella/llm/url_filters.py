"""URL filters over dated lists: every capture meets the entries active when it was fetched.

A list is a log of dated additions and removals. It becomes validity intervals, and an
as-of join on host suffixes and path prefixes finds the entries in force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_ROWS, MOST_TOPS = 200_000, 5_000
#: entry (a host, which holds for its subdomains, or host/path prefix), list, action, date.
ENTRIES = [
    ("casino-win.example.com", "gambling", "add", "2024-01-15"),
    ("casino-win.example.com", "gambling", "remove", "2024-05-01"),
    ("casino-win.example.com", "gambling", "add", "2024-09-10"),
    ("free-bets.example.com", "gambling", "add", "2024-02-01"),
    ("cheap-pills.example.com", "pharmacy", "add", "2023-11-30"),
    ("cheap-pills.example.com", "spam", "add", "2024-03-20"),
    ("cheap-pills.example.com", "spam", "remove", "2024-08-01"),
    ("ads-track.example.com", "advertising", "add", "2024-01-01"),
    ("ads-track.example.com", "advertising", "remove", "2024-12-01"),
    ("m.ads-track.example.com", "tracking", "add", "2024-06-15"),
    ("blog.tionsh.example.net", "spam", "add", "2024-07-01"),
    ("blog.tionsh.example.net", "spam", "remove", "2024-07-15"),
    ("tiontion.example.net/de", "regional", "add", "2024-04-01"),
    ("thther.example.org/fr", "regional", "add", "2024-10-01"),
]


def _located(url: Column) -> Column:
    """The URL from its host on, after ``//``; '' if it names none. A scheme isn't needed: ``//host/x`` and ``host.tld/x`` will do."""
    given = url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    bare = url.rlike(r"^[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+(?:[/?#]|:[0-9]|$)")
    return F.when(given, F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//.*)", 1)).when(bare, F.concat(F.lit("//"), url)).otherwise("")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dots; '' if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(_located(url), r"^//(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    """The path without query, fragment and slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(_located(url), r"^//[^/?#]*([^?#]*)", 1), "^/+|/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list, since, until) from (entry, list, action, dated); open intervals end in null.

    Of several actions on one day, a removal wins. Rows with a null, or with no date in dated, are void.
    """
    daily = entries.where("entry is not null and list is not null and try_cast(dated AS date) is not null and action in ('add', 'remove')").groupBy(
        F.lower(F.rtrim(F.trim("entry"), F.lit("/"))).alias("key"), "list", F.col("dated").try_cast("date").alias("since")).agg((F.max("action") == "add").alias("adds"))
    nxt = F.lead("since").over(W.partitionBy("key", "list").orderBy("since"))  # a row a day at most
    return daily.withColumn("until", nxt).where("adds").select("key", "list", "since", "until")


def keys_of(host: Column, path: Column) -> Column:
    """All suffixes of the host, and the host followed by each prefix of the path's segments."""
    parts, steps = F.split(host, r"\."), F.split(path, "/+")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, F.when(path == "", F.array().cast("array<string>")).otherwise(prefixes))))


def filter_urls(captures: DataFrame, entries: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of captures (page_id, url, fetched_at): these, host, lists (of the active entries, sorted), blocked.

    A capture without a readable host, or with a null url or fetch time, meets no entry.
    """
    active = intervals(entries)
    own = captures.select("page_id", "url", "fetched_at", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    few = active.limit(broadcast_rows + 1).count() <= broadcast_rows
    probes = own.select("page_id", "url", "fetched_at", F.explode(keys_of(F.col("host"), F.coalesce(path_of(F.col("url")), F.lit("")))).alias("key"))
    if not few:  # the commonest keys, top-level domains, meet the entries only if one of these is listed itself
        tops = [r["key"] for r in active.where("not contains(key, '.')").select("key").distinct().limit(MOST_TOPS + 1).collect()]
        if len(tops) <= MOST_TOPS:
            probes = probes.where(F.col("key").contains(".") | F.col("key").isin(tops))
    day = F.to_date("fetched_at")
    met = probes.join(F.broadcast(active) if few else active, "key").where((F.col("since") <= day) & (F.col("until").isNull() | (day < F.col("until"))))
    met = met.groupBy("page_id", "url", "fetched_at").agg(F.array_sort(F.collect_set("list")).alias("lists")).select(
        F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetched_at").alias("t"), "lists")
    same = own["page_id"].eqNullSafe(met["p"]) & own["url"].eqNullSafe(met["u"]) & own["fetched_at"].eqNullSafe(met["t"])
    return own.join(met, same, "left").select(
        "page_id", "url", "fetched_at", "host", F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.col("lists").isNotNull().alias("blocked"))


def sample_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "entry string, list string, action string, dated string")
