"""Best-first crawl over a snapshot of pages, a batch of the frontier at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html, urls
from ..shared import cut
from . import links, robots


def crawl(start: str, query: str, snapshot: DataFrame, sites: DataFrame | None = None, max_pages: int = 50, batch: int = 1) -> DataFrame:
    """(round, unique_url, abs_url, page_id, score) of the pages visited from `start`.

    snapshot: (page_id, abs_url, content); the page of a URL is the one with the smallest
    page_id of its unique URL, and one that only refreshes to another URL leads there with its
    score. A round takes the `batch` best of the frontier (score, then abs_url), marks them seen,
    drops those that robots rules of `sites` (host, robots_txt) forbid, looks the rest up, and
    adds their links' scores to the frontier. batch 1 is strictly best first; a URL scored again
    adds up. It ends at max_pages or an empty frontier, however many links lead nowhere in between.
    Of the snapshot a round reads the contents of its own pages only. Each round's tables end
    their lineage.
    """
    spark = snapshot.sparkSession
    known = snapshot.select("page_id", urls.unique(F.col("abs_url")).alias("unique_url")).where("unique_url IS NOT NULL").groupBy("unique_url").agg(F.min("page_id").alias("page_id"))
    known = cut(known, "snapshot")
    frontier = spark.createDataFrame([(start, 0)], "abs_url string, score long").select("abs_url", urls.unique(F.col("abs_url")).alias("unique_url"), "score")
    visited = spark.createDataFrame([], T._parse_datatype_string("round int, unique_url string, abs_url string, page_id long, score long"))
    seen = spark.createDataFrame([], "unique_url string")
    count = no = 0
    while count < max_pages:
        no += 1
        best = frontier.orderBy(F.desc("score"), "abs_url").limit(min(batch, max_pages - count)).dropDuplicates(["unique_url"])
        best = cut(best, "best")
        if best.isEmpty():
            break
        seen = cut(seen.unionByName(best.select("unique_url")), "seen")
        open_ = best if sites is None else robots.safe(best.select("*", urls.host(F.col("abs_url")).alias("host"), urls.path(F.col("abs_url")).alias("path")), sites).drop("host", "path")
        found = open_.join(known, "unique_url")
        # as many rows as the batch has; their contents are the only ones that are read
        pages = cut(snapshot.select("page_id", "content").join(F.broadcast(found), "page_id").dropDuplicates(["page_id"]), "pages")
        to = urls.resolved(html.refresh_target(F.col("content")), F.col("abs_url"))
        led = pages.select(to.alias("abs_url"), "score").where("abs_url <> ''").select("abs_url", urls.unique(F.col("abs_url")).alias("unique_url"), "score")
        pages = pages.where(html.refresh_target(F.col("content")).isNull())
        new = cut(pages.select(F.lit(no).alias("round"), "unique_url", "abs_url", "page_id", "score"), "visited")
        count += new.count()
        visited = visited.unionByName(new)
        linked = links.extracted(pages.select("page_id", "abs_url", "content"))
        linked = links.scored(pages, linked, query).select("abs_url", "unique_url", F.col("score").cast("long"))
        both = frontier.select("abs_url", "unique_url", "score").unionByName(linked).unionByName(led).join(seen, "unique_url", "left_anti")
        frontier = cut(both.groupBy("abs_url", "unique_url").agg(F.sum("score").alias("score")), "frontier")
    return visited


def last_good_page(visited: DataFrame, out_links: DataFrame) -> DataFrame:
    """(abs_url) of the page visited last that has a link: where the next crawl goes on. visited: (abs_url, seq, page_id); out_links: (page_id)."""
    return visited.join(out_links.select("page_id").distinct(), "page_id", "left_semi").agg(F.max_by("abs_url", "seq").alias("abs_url"))
