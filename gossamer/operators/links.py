"""The link table of pages and the scores by which a focused crawl orders it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html, text, urls

#: Links of a page beyond so many are left out, counted before any other test.
LINK_CAP = 200
#: Words to either side of an anchor that count as near.
DISTANCE = 5


#: Places of a page whose links are gathered in one row.
TOGETHER = 256


def together(pos: Column) -> Column:
    return F.floor(F.coalesce(pos, F.lit(0)) / TOGETHER)


def extracted(pages: DataFrame, cap: int = LINK_CAP) -> DataFrame:
    """(page_id, pos, href, anchor, abs_url, unique_url) of `pages` (page_id, abs_url, content).

    Only links that resolve to a valid URL; of a page's links with the same unique_url and
    length of abs_url the first stays. Pages delivered twice count once.
    """
    once = pages.select("page_id", "abs_url", "content").dropDuplicates(["page_id"])
    each = once.select("page_id", F.col("abs_url").alias("page_url"), F.posexplode(F.slice(html.links(F.col("content")), 1, cap)).alias("pos", "link"))
    each = each.select("page_id", "pos", "link.href", "link.anchor", urls.resolved(F.col("link.href"), F.col("page_url")).alias("abs_url")).where(urls.valid(F.col("abs_url")))
    each = each.withColumn("unique_url", urls.unique(F.col("abs_url")))
    first = W.partitionBy("page_id", "unique_url", F.length("abs_url")).orderBy("pos")
    return each.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def with_score(rows: DataFrame, query: str) -> DataFrame:
    """rows (href, anchor, tokens, ...) with the relevance of each link for a query of words.

    tokens are the plain words of the link's page. 50 for each query word in the anchor; else
    40 if one is in the href; else 4 for each distinct word within DISTANCE of the anchor and 1
    for each other one on the page. Places beyond the page's ends count as its first and last
    word; an anchor that isn't found lies before the first word. Null words are none.
    """
    if not query:
        return rows.withColumn("score", F.lit(0))
    asked = query.split(" ")
    low_anchor, low_href = F.lower(F.coalesce("anchor", F.lit(""))), F.lower(F.coalesce("href", F.lit("")))
    in_anchor = sum((F.contains(low_anchor, F.lit(w.lower())).cast("int") for w in asked), F.lit(0))
    in_href = F.lit(False)
    for w in asked:
        in_href = in_href | F.contains(low_href, F.lit(w))
    tokens, phrase = F.col("tokens"), F.col("__phrase")
    # each step is a column of its own, so nothing is computed anew for every word of a page
    rows = rows.withColumn("__sure", F.when(in_anchor > 0, 50 * in_anchor).when(in_href, 40))
    rows = rows.withColumn("__phrase", F.split(text.plain(F.coalesce("anchor", F.lit(""))), " "))
    rows = rows.withColumn("__begin", F.when(F.col("__sure").isNull(), text.phrase_index(tokens, phrase)))
    rows = rows.withColumn("__end", F.col("__begin") + F.size(phrase) - 1)
    places = [F.greatest(F.col("__begin") - i, F.lit(0)) for i in range(1, DISTANCE + 1)] + [F.least(F.col("__end") + i, F.size(tokens) - 1) for i in range(1, DISTANCE + 1)]
    rows = rows.withColumn("__near", F.when(F.col("__sure").isNull(), F.array(*(F.get(tokens, p) for p in places))))
    words = list(dict.fromkeys(asked))
    close, here = (sum((F.coalesce(F.array_contains(c, w), F.lit(False)).cast("int") for w in words), F.lit(0)) for c in ("__near", "tokens"))
    return rows.withColumn("score", F.coalesce("__sure", 3 * close + here).cast("int")).drop("__sure", "__phrase", "__begin", "__end", "__near")


def scored(pages: DataFrame, links: DataFrame, query: str) -> DataFrame:
    """Links (page_id, pos, href, anchor, ...) with their score; a page is split into words once.

    The links of a page are gathered before they meet its words, TOGETHER places at a time, so
    its words aren't copied to each link, and a page of very many links makes many rows;
    columns of pages (page_id, content) but these are not read.
    """
    words = pages.select("page_id", "content").dropDuplicates(["page_id"]).select("page_id", F.split(text.plain(html.text(F.col("content"))), " ").alias("tokens"))
    gathered = links.groupBy("page_id", together(F.col("pos")).alias("__part")).agg(F.collect_list(F.struct(*(c for c in links.columns if c != "page_id"))).alias("__links"))
    each = gathered.join(words, "page_id").select("page_id", "tokens", F.explode("__links").alias("__l")).select("page_id", "tokens", "__l.*")
    return with_score(each, query).drop("tokens").select(*links.columns, "score")


def frontier(scores: DataFrame, key: str = "abs_url") -> DataFrame:
    """Scores of links summed a target: (key, unique_url, score, links)."""
    return scores.groupBy(key).agg(F.min("unique_url").alias("unique_url"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("links"))


def strictly_joined(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """rows joined with targets by `key`, in which a row without a target is an error when it is reached."""
    there = targets.withColumn("__there", F.lit(True))
    both = rows.join(there, key, "left")
    found = F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no target for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return both.where(found).drop("__there")
