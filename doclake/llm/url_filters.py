"""URL filters over time: dated list entries become validity intervals, captures meet those valid when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to): the times in which an entry is on a list; ``valid_to`` is exclusive, null: still on it.

    ``entries``: list, kind (`host` or `url`), pattern, action (`add` or `remove`), day (any ordered type). Of entries with
    the same list, kind, pattern and day a removal wins. Repeated adds prolong nothing and removals of what is not on the
    list do nothing. Entries with a null or another action are ignored. Days of a pattern are combined before they are
    shuffled.
    """
    key = ["list", "kind", "pattern"]
    known = entries.where(F.col("action").isin("add", "remove"))
    for c in (*key, "day"):
        known = known.where(F.col(c).isNotNull())
    days = known.groupBy(*key, "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy(*key).orderBy("day")
    changes = days.withColumn("was", F.coalesce(F.lag("action").over(order), F.lit("remove"))).where("action != was")
    return changes.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'").select(
        *key, F.col("day").alias("valid_from"), "valid_to")


def url_host(url: Column) -> Column:
    """Host in lower case without port and user; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def url_keys(url: Column) -> Column:
    """What list entries can name of a URL: (`host`, the host and each parent domain of two labels or more), (`url`, host and path)."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(
        F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(
        F.concat(hosts, F.array(F.struct(F.lit("url").alias("kind"), F.concat(host, path).alias("pattern")))))


def filter_captures(captures: DataFrame, url: str, fetched: str, intervals: DataFrame, block: str = "block", allow: str = "allow") -> DataFrame:
    """``captures`` with the columns verdict, matched_list, matched_pattern, listed_from, n_active added.

    An as-of join: of all entries of the lists ``block`` and ``allow`` that are valid at ``fetched`` and name the URL, its
    host or a parent domain, the longest pattern decides; on a tie `url` goes before `host` and ``allow`` before ``block``.
    Without one, or with a null or unreadable URL or a null time, the verdict is `pass`. Every row of ``captures`` stays
    once, repeated rows too; columns of those five names are replaced.

    Different (URL, time) pairs are evaluated once. Joins are plain equi-joins with ranges inside a key, so that the
    adaptive join can split the rows of one frequent host; no key of ``intervals`` holds more rows than it had changes.
    """
    new = ["verdict", "matched_list", "matched_pattern", "listed_from", "n_active"]
    captures = captures.drop(*new)
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).where("_url is not null and _at is not null").distinct()
    keys = asked.select("_url", "_at", F.explode(url_keys(F.col("_url"))).alias("k")).select("_url", "_at", "k.kind", "k.pattern")
    active = intervals.where(F.col("list").isin(block, allow))
    met = keys.join(active, ["kind", "pattern"]).where("_at >= valid_from and (valid_to is null or _at < valid_to)")
    rank = F.struct(F.length("pattern").alias("len"), (F.col("kind") == "url").alias("url"), (F.col("list") == allow).alias("allow"),
                    F.col("list").alias("list"), F.col("pattern").alias("pattern"), F.col("valid_from").alias("valid_from"))
    decided = met.groupBy("_url", "_at").agg(F.max(rank).alias("r"), F.count("*").alias("n"))
    decided = decided.select("_url", "_at", F.col("r.list").alias("matched_list"), F.col("r.pattern").alias("matched_pattern"), F.col("r.valid_from").alias("listed_from"), F.col("n").alias("n_active"))
    out = captures.join(decided, (F.col(url) == F.col("_url")) & (F.col(fetched) == F.col("_at")), "left").drop("_url", "_at")
    return out.withColumn("n_active", F.coalesce("n_active", F.lit(0))).withColumn("verdict", F.coalesce("matched_list", F.lit("pass")))
