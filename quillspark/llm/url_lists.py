"""URL filters by temporal list join.

Dated additions and removals of list entries become validity intervals; every capture is judged by
the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Scratch
from .buckets import sieve, sifted

#: Captures of one key that meet its entries in one part.
HOT = 100_000


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; empty if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """The path without query and fragment, no slash at its ends."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.coalesce(F.regexp_replace(path, r"^/+|/+$", ""), F.lit(""))


def validity(changes: DataFrame) -> DataFrame:
    """(list, action, kind, entry, at) to (list, kind, entry, since, until): from each addition to the
    next change of the same entry, or for good (until null). At one time a removal undoes an addition;
    rows with a null are left out; a repeated addition changes nothing."""
    rows = changes.dropna().where(F.col("action").isin("add", "remove"))
    rows = rows.groupBy("list", "kind", F.lower("entry").alias("entry"), "at").agg(F.max("action").alias("action"))
    line = Window.partitionBy("list", "kind", "entry").orderBy("at")
    rows = rows.withColumn("until", F.lead("at").over(line)).where("action = 'add'")
    return rows.select("list", "kind", "entry", F.col("at").alias("since"), "until")


def capture_keys(host: Column, path: Column, deepest: int) -> Column:
    """All (kind, entry) keys that could list a url: its host, its host's suffixes, and its host with
    each leading part of its path, as deep as the deepest entry."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("entry")))
    hosts = F.array(F.struct(F.lit("host").alias("kind"), host.alias("entry")))
    steps = F.split(path, "/")
    depth = F.least(F.size(steps), F.lit(deepest))
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("entry")))
    prefixes = F.when((path != "") & (depth > 0), prefixes).otherwise(F.filter(hosts, lambda x: F.lit(False)))
    return F.when(host == "", F.filter(hosts, lambda x: F.lit(False))).otherwise(F.concat(hosts, domains, prefixes))


def judge(
    spark: SparkSession, captures: DataFrame, changes: DataFrame, allow: str = "allow", id_col: str = "page_id",
    url_col: str = "url", time_col: str = "fetched_at", hot: int = HOT,
) -> DataFrame:
    """One row per capture: (id_col, url_col, time_col, blocked, n_entries, entry, lists).

    An entry is active from its addition up to, not including, its next change. n_entries counts the
    active entries that match, lists names their lists in order (empty: none), entry is the longest of
    them. blocked: some list other than ``allow`` has a match longer than any of ``allow``'s.
    kinds: "host" (that host), "domain" (it and hosts below it), "prefix" (host and leading path
    steps). Null, relative and host-less urls and null times match nothing. Rows that repeat are
    captures of their own. Empty captures give an empty result, empty lists block nothing, other
    columns are ignored.

    A capture gives a handful of keys, whatever the lists' size. A sieve of the lists' keys lets through
    where they lie those that may be listed; only they travel. Keys of more than ``hot`` captures are
    dealt by row to as many parts as the hottest needs, and their entries, with what the sieve of hot
    keys takes for hot besides, go to each part.
    """
    scratch = Scratch(spark, "urls")
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at"))
    rows = scratch.keep(rows.withColumn("_row", F.monotonically_increasing_id()))
    active = scratch.keep(validity(changes))
    deepest = active.where("kind = 'prefix'").agg(F.max(F.size(F.split("entry", "/")) - 1)).first()[0] or 0
    keys = rows.where("_at is not null").select("_row", "_at", F.explode(capture_keys(url_host(F.col("_url")), url_path(F.col("_url")), deepest)).alias("k"))
    key = F.xxhash64("kind", "entry").alias("_key")
    active = scratch.keep(active.select("*", key))
    listed = sieve(active.select(F.col("_key").alias("id")).distinct(), scratch)
    keys = scratch.keep(sifted(keys.select("_row", "_at", "k.kind", "k.entry").select("*", key), "_key", listed)[0])
    sizes = scratch.keep(keys.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > hot))
    parts = -(-(sizes.agg(F.max("n")).first()[0] or 1) // hot)
    many = sieve(sizes.select(F.col("_key").alias("id")), scratch)

    def dealt(frame: DataFrame, part: Column) -> DataFrame:
        spread, rest = sifted(frame, "_key", many)
        return spread.withColumn("_part", part).unionAll(rest.withColumn("_part", F.lit(0)))

    mine = dealt(keys, F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    theirs = dealt(active, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("_key")
    hits = mine.join(theirs, ["kind", "entry", "_part"]).where("since <= _at and (until is null or _at < until)")
    best = lambda mine: F.max(F.when(mine, F.struct(F.length("entry").alias("n"), F.col("entry"))))
    judged = hits.groupBy("_row").agg(
        F.count("*").alias("n_entries"), F.max(F.struct(F.length("entry"), "entry")).getField("entry").alias("entry"),
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.coalesce(best(F.col("list") != allow).getField("n"), F.lit(0)).alias("bad"),
        F.coalesce(best(F.col("list") == allow).getField("n"), F.lit(0)).alias("good"),
    )
    judged = scratch.keep(judged)
    return rows.join(judged, "_row", "left").select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_at").alias(time_col),
        F.coalesce(F.col("bad") > F.col("good"), F.lit(False)).alias("blocked"),
        F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), "entry", F.coalesce("lists", F.lit("")).alias("lists"),
    )
