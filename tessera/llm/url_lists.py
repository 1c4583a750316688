"""URL filters that change over time.

A list is a history of dated entries: a domain is added to it or removed from it. Entries become validity intervals, from
an addition to the next entry of the same domain on the same list; a capture matches the intervals of its host and of the
host's parent domains that hold its fetch date, which is the entry in force as of that date. Intervals are dealt to
periods of PERIOD_DAYS days within the dates of the captures, and the join is on domain and period, so a domain with a long history is compared
with a capture in its own period only. A popular host makes that join skewed on the captures' side, which the skew join splits.

Only DataFrame functions are used.

Defined cases: a null URL, or one without a host, has no host and matches nothing; a null fetch date matches nothing; an entry with a null
date, domain or action is ignored; of entries of one list, domain and date a removal wins; repeated entries count once; rows
that are equal in id, URL and fetch date are one capture; without entries no capture is listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a period.
PERIOD_DAYS = 64


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":[0-9]*$", ""), r"\.$", ""))
    return F.when(F.length(host) > 0, host)


def domains_of(host: Column) -> Column:
    """The host and its parent domains, the longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until) from entries (list, domain, day, action), action ``add`` or ``remove``; until is null while an entry
    is in force. Days are dates."""
    rows = entries.where("list is not null and domain is not null and day is not null and action in ('add', 'remove')")
    days = rows.groupBy("list", F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    return days.select("list", "domain", F.col("day").alias("since"), following.alias("until"), "action").where("action = 'add'").drop("action")


def listed_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """(page_id, url, host, fetched, listed, lists, domain, since) of each capture: whether an entry was in force at its fetch date, the sorted
    lists with such an entry, and of these entries the longest domain and the earliest day since when one held."""
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("fetched"))
    # two numbers: the dates between which an entry can matter
    first_day, last_day = rows.agg(F.unix_date(F.min("fetched")), F.unix_date(F.max("fetched"))).first()
    period = lambda day: F.floor(day / PERIOD_DAYS).cast("int")
    lowest, highest = F.lit(first_day).cast("int"), F.lit(last_day).cast("int")
    first = period(F.greatest(F.unix_date("since"), lowest))
    last = period(F.least(F.coalesce(F.unix_date("until"), highest), highest))
    reached = (F.unix_date("since") <= highest) & (F.col("until").isNull() | (F.unix_date("until") > lowest))
    dealt = validity_intervals(entries).where(reached).withColumn("period", F.explode(F.sequence(first, last)))
    keys = rows.where("host is not null and fetched is not null").withColumn("period", period(F.unix_date("fetched"))).select("page_id", "url", "fetched", "period", F.explode(domains_of(F.col("host"))).alias("domain"))
    hits = keys.join(dealt, ["domain", "period"]).where("since <= fetched and (until is null or fetched < until)")
    hits = hits.select("page_id", "url", "fetched", F.struct("list", "domain", "since").alias("hit"))
    # each capture once, with its hits
    every = rows.select("page_id", "url", "fetched", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    found = every.unionByName(hits).groupBy("page_id", "url", "fetched").agg(F.array_sort(F.collect_set("hit.list")).alias("lists"), F.max(F.struct(F.length("hit.domain"), F.col("hit.domain").alias("domain"))).alias("longest"), F.min("hit.since").alias("since"))
    return found.select("page_id", "url", host_of(F.col("url")).alias("host"), "fetched", (F.size("lists") > 0).alias("listed"), "lists", F.col("longest.domain").alias("domain"), "since")
