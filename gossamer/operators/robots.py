"""robots.txt rules and the links they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rules(sites: DataFrame) -> DataFrame:
    """(host, allowed_all, disallow) of `sites` (host, robots_txt): one row a host.

    A missing file allows everything. Of the section that begins with the first `user-agent: *`,
    to the next user-agent, every `Disallow:` gives the prefix that follows it; case matters
    there. A file without one makes the host unsafe: no allowed_all and no prefix. A section
    that doesn't exist is the start of the file. A repeated host keeps the union of its rules.
    """
    low = F.lower(F.col("robots_txt"))
    at = F.greatest(F.locate("user-agent: *", low), F.lit(1))
    tail = F.substring(F.col("robots_txt"), at, F.length("robots_txt"))
    after = F.locate("user-agent:", F.lower(tail), 13)
    section = F.when(after > 0, F.substring(tail, F.lit(1), after - 1)).otherwise(tail)
    found = F.regexp_extract_all(section, F.lit(r"Disallow:[ \t]*([^ \t\r\n]+)"), F.lit(1))
    each = sites.where("host IS NOT NULL").select(F.lower("host").alias("host"), F.col("robots_txt").isNull().alias("allowed_all"), F.coalesce(found, F.array().cast("array<string>")).alias("disallow"))
    return each.groupBy("host").agg(F.max("allowed_all").alias("allowed_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("disallow")))).alias("disallow"))


def safe(urls: DataFrame, sites: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Rows of `urls` whose host has rules and whose path begins with no forbidden prefix; other hosts are dropped.

    The rules are one row a host; Spark broadcasts them only while their size allows it.
    """
    r = rules(sites).where(F.col("allowed_all") | (F.size("disallow") > 0)).select(F.col("host").alias("__host"), "disallow")
    joined = urls.join(r, F.col(host) == F.col("__host"))
    return joined.where(~F.exists("disallow", lambda p: F.startswith(F.col(path), p))).drop("__host", "disallow")
