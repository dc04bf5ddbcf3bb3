"""Temporal URL lists with DataFrame operations only.

Dated list entries become validity intervals for each key, and every capture is judged by
the entries that were active when it was fetched. A key is a domain (it also covers its
subdomains) or a host with leading path segments; the longest active key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals up to this number are broadcast (about 100 bytes each); more are joined by a
#: salted shuffle.
BROADCAST_INTERVALS = 200_000
#: Copies of each interval in the shuffled join: a hot host is dealt over so many tasks, which
#: adaptive execution can split further.
SALTS = 64
#: On one day the stricter action of a key counts.
STRICTNESS = {"block": 3, "allow": 2, "remove": 1}

# The dated example list (key, first day, action).
EXAMPLE_ENTRIES = [
    ("spam-farm.example.org", "2024-01-15", "block"),
    ("spam-farm.example.org", "2024-06-01", "remove"),
    ("spam-farm.example.org", "2024-09-01", "block"),
    ("tionsh.example.net", "2024-03-01", "block"),
    ("blog.tionsh.example.net", "2024-03-01", "allow"),
    ("tionsh.example.net", "2024-10-10", "remove"),
    ("example.com/de", "2024-02-01", "block"),
    ("tionble.example.com", "2024-04-01", "block"),
    ("tionble.example.com", "2024-04-01", "remove"),
    ("blog.tionble.example.com/en", "2024-05-05", "allow"),
    ("thther.example.org", "2024-07-01", "block"),
    ("thther.example.org", "2024-08-01", "allow"),
    ("m.thther.example.org", "2024-08-15", "block"),
    ("ththre.example.com", "2023-01-01", "block"),
    ("ththon.example.com", "2025-01-01", "block"),
]


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and root dot; empty where there is none."""
    return F.coalesce(F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit(".")), F.lit(""))


def normal_key(key: Column) -> Column:
    """A list key as URLs are probed with: the host in lower case without root dot, the path (in
    which case counts) without empty segments."""
    host = F.rtrim(F.lower(F.substring_index(key, "/", 1)), F.lit("."))
    return F.array_join(F.concat(F.array(host), segments_of(F.regexp_extract(key, r"^[^/]*(/.*)?$", 1))), "/")


def segments_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def keys_of(host: Column, url: Column, labels: int, depth: int) -> Column:
    """Every key that covers a URL: host suffixes of up to ``labels`` labels, and those with up to
    ``depth`` leading path segments. Longer keys are in no list whose keys are no longer."""
    parts = F.split(host, r"\.")
    first = F.greatest(F.size(parts) - labels + 1, F.lit(1))
    suffixes = F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    path = F.slice(segments_of(F.regexp_extract(url, r"^[^:]*://[^/?#]*(/[^?#]*)?", 1)), F.lit(1), F.lit(depth)) if depth else F.array().cast("array<string>")
    ends = F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.when(i == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/"))))
    return F.when(host != "", F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(ends, lambda p: F.concat(s, p))))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (key, effective, action) as intervals [valid_from, valid_to) of each key,
    valid_to null while it lasts. Entries without key, day or known action are dropped by
    definition; case counts in paths, not in hosts; on one day the strictest action of a key counts; ``remove`` ends an interval.
    """
    rank = F.coalesce(*[F.when(F.lower("action") == a, s) for a, s in STRICTNESS.items()])
    days = (
        entries.select(normal_key(F.col("key")).alias("key"), F.col("effective").cast("date").alias("valid_from"), rank.alias("rank"))
        .where("key is not null and valid_from is not null and rank is not null")
        .groupBy("key", "valid_from")
        .agg(F.max("rank").alias("rank"))
    )
    until = F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from"))
    return days.withColumn("valid_to", until).where("rank > 1").select("key", "valid_from", "valid_to", F.when(F.col("rank") == 3, "block").otherwise("allow").alias("action"))


def judge_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_on", broadcast_limit: int = BROADCAST_INTERVALS) -> DataFrame:
    """``captures`` with verdict (block, allow or none), matched_key, valid_from, valid_to and
    host: the as-of evaluation of every capture.

    A verdict depends on URL and day alone, so it is found once for each distinct pair; a
    hot host costs nothing more, its distinct pairs are salted over tasks in the shuffled join.
    Captures without URL, host or day have the verdict ``none`` and take no part in a join; all
    rows and columns stay; columns of the names added are replaced. Of a hostile URL only as many
    labels and segments are tried as the longest keys of the list have.
    """
    added = ["verdict", "matched_key", "valid_from", "valid_to", "host"]
    own = [c for c in captures.columns if c not in added]
    url, day, m = (next(n for k in range(1, len(own) + 2) if (n := name + "_" * k) not in own) for name in ("url", "day", "match"))
    base = captures.withColumn(day, F.col(f"`{time_col}`").cast("date")).withColumn(url, F.col(f"`{url_col}`"))
    judged = F.col(url).isNotNull() & F.col(day).isNotNull()
    known = base.where(judged)
    intervals = validity_intervals(entries)
    bounds = intervals.agg(F.count("*").alias("n"), F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"), F.max(F.size(F.split("key", "/")) - 1).alias("depth")).first()
    pairs = known.select(F.col(url).alias("url"), F.col(day).alias("day")).distinct()
    probes = pairs.select("url", "day", F.explode(keys_of(host_of(F.col("url")), F.col("url"), bounds["labels"] or 1, bounds["depth"] or 0)).alias("key"))
    active = "valid_from <= day and (valid_to is null or day < valid_to)"
    if bounds["n"] <= broadcast_limit:
        hits = probes.join(F.broadcast(intervals), "key").where(active)
    else:
        salted = intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = probes.withColumn("salt", F.pmod(F.xxhash64("url", "day"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).where(active)
    found = hits.groupBy("url", "day").agg(F.max_by(F.struct("action", "key", "valid_from", "valid_to"), F.struct(F.length("key"), F.col("key"))).alias(m)).toDF(url, day, m)
    joined = known.join(found, [url, day], "left")
    rest = base.where(~judged).withColumn(m, F.lit(None).cast(found.schema[m].dataType))
    told = [
        F.coalesce(f"{m}.action", F.lit("none")).alias("verdict"),
        F.col(f"{m}.key").alias("matched_key"),
        F.col(f"{m}.valid_from").alias("valid_from"),
        F.col(f"{m}.valid_to").alias("valid_to"),
        host_of(F.col(url)).alias("host"),
    ]
    columns = [F.col(f"`{c}`") for c in own]
    return joined.select(*columns, *told).unionByName(rest.select(*columns, *told))
