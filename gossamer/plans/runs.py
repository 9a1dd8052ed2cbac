"""Whole runs: from pages to an index, a search over it, an update, and the inspection report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html
from ..operators import crawl, index, pagerank, records, search, snippets
from ..shared import cut
from ..sources import files, sinks
from ..sources.versions import VersionedTable


def documents(pages: DataFrame) -> DataFrame:
    """Index documents (index_id, abs_url, title, contents) of pages (abs_url, title, content); the id is a hash of the URL."""
    return pages.where("abs_url IS NOT NULL").select(F.xxhash64("abs_url").alias("index_id"), "abs_url", "title", F.col("content").alias("contents"))


def index_folder(spark: SparkSession, folder: str, target: str) -> int:
    """Indexes the HTML files below `folder` into the table `target` and its postings; gives the number of documents there."""
    docs = files.page_documents(files.html_folder(spark, folder)).select(F.xxhash64("filename").alias("index_id"), "filename", "title", "contents")
    sinks.append(docs, f"{target}/documents")
    refresh_index(spark, target)
    return spark.read.parquet(f"{target}/documents").count()


def documents_of(spark: SparkSession, target: str) -> DataFrame:
    """Index documents of a target that index_folder or update has written."""
    table = VersionedTable(spark, f"{target}/pages")
    return documents(table.read()) if table.exists() else spark.read.parquet(f"{target}/documents")


def refresh_index(spark: SparkSession, target: str) -> index.Index:
    """Writes the postings of a target anew, by which it is searched; readers see the old ones until they are complete."""
    generation = uuid.uuid4().hex
    stored = index.Index.of(documents_of(spark, target), "contents", "title").store(f"{target}/index-{generation}")
    spark.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("overwrite").parquet(f"{target}/index")
    return stored


def open_index(spark: SparkSession, target: str) -> index.Index:
    return index.Index.open(spark, f"{target}/index-{spark.read.parquet(f'{target}/index').first()[0]}")


def hits(spark: SparkSession, target: str, query: str, k: int = 10) -> DataFrame:
    """A result page (rank, title, abs_url, snippet) of a target by text alone; k rows."""
    docs = documents_of(spark, target)
    name = "filename" if "filename" in docs.columns else "abs_url"
    best = search.top(search.matches(open_index(spark, target), query), k)
    best = cut(best.select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id")).alias("rank"), F.col("doc_id").alias("index_id")), "best")
    return docs.join(F.broadcast(best), "index_id").select("rank", "title", F.col(name).alias("abs_url"), snippets.snippet(F.col("contents"), query).alias("snippet"))


def crawl_and_index(start: str | None, query: str, snapshot: DataFrame, target: str, sites: DataFrame | None = None, max_pages: int = 50, batch: int = 15) -> DataFrame:
    """Crawls from `start` and upserts the pages (abs_url, title, content) into `target`, those apart that are near-duplicates of what it holds; gives the actions.

    Without a start, the crawl goes on from the last good page of the one before; that page is kept with the target.
    """
    spark = snapshot.sparkSession
    start = start or files.last_good(spark, f"{target}/last-good")
    if not start:
        raise ValueError("there is no page to start from")
    visited = cut(crawl.crawl(start, query, snapshot, sites, max_pages, batch), "visited")
    pages = visited.select("page_id", "abs_url", "round").join(snapshot.select("page_id", "title", "content").dropDuplicates(["page_id"]), "page_id")
    good = pages.where(F.size(html.links(F.col("content"))) > 0).select("abs_url", F.struct("round", "page_id").alias("seq"))
    good = good.agg(F.max_by("abs_url", "seq").alias("abs_url")).where("abs_url IS NOT NULL")
    if not good.isEmpty():
        sinks.last_good(good, f"{target}/last-good")
    return update(pages.select("abs_url", "title", "content").dropDuplicates(["abs_url"]), target)


def update(new: DataFrame, target: str) -> DataFrame:
    """Upserts pages (abs_url, ..., content) into `target` and its postings; gives them with their action. A second run changes nothing."""
    spark = new.sparkSession
    table = VersionedTable(spark, f"{target}/pages")
    base = table.read() if table.exists() else spark.createDataFrame([], new.schema)
    actions = cut(index.upsert_actions(new, base, "abs_url", "content"), "actions")
    changed = actions.where("action <> 'skip'").select(new.columns)
    if not changed.isEmpty():
        table.upsert(changed)
        refresh_index(spark, target)
    return actions


def ranked(index_: index.Index, scores: DataFrame, query: str, k: int = 10, hits: int = 50) -> DataFrame:
    """(rank, doc_id, score): of the best `hits` by text the k with the best score (doc_id, rank), fused; k rows."""
    best = search.fused(scores, search.top(search.matches(index_, query), hits), k)
    return best.select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")


def ranked_results(docs: DataFrame, index_: index.Index, scores: DataFrame, query: str, k: int = 10, hits: int = 50) -> DataFrame:
    """A result page (rank, title, abs_url, snippet) of ranked(); of the documents the k that are shown are read.

    scores come from `link_scores`, computed once and kept, not for every query.
    """
    best = cut(ranked(index_, scores, query, k, hits), "ranked")
    rows = docs.join(F.broadcast(best.withColumnRenamed("doc_id", "index_id")), "index_id")  # best has k rows
    return rows.select("rank", "title", "abs_url", snippets.snippet(F.col("contents"), query).alias("snippet"))


def link_scores(pages: DataFrame, links: DataFrame, f: float = 0.7) -> DataFrame:
    """(node, score) of pages (node, url, content) by their links (node, pos, href, anchor)."""
    targets = pages.select(F.col("url").alias("href"), F.col("node").alias("dst"))
    aimed = links.where("href IS NOT NULL").join(targets, "href").select("node", "dst", "pos", "href", "anchor")
    return pagerank.ranks(pagerank.bases(pages), pagerank.normalized(pagerank.strengths(pages, aimed)), f)


def folder_ranks(spark: SparkSession, folder: str, f: float) -> DataFrame:
    """(node, score), best first, of the pages in a flat folder, by their links to each other's file names.

    A page whose links all lead elsewhere gives an equal part to every page.
    """
    pages = files.html_folder(spark, folder, recursive=False, extensions="*").select(F.regexp_extract("filename", "([^/]+)$", 1).alias("node"), F.col("html").alias("content"))
    pages = cut(pages.withColumn("url", F.col("node")), "pages")
    links = pages.select("node", F.posexplode(html.links(F.col("content"))).alias("pos", "l")).select("node", "pos", "l.href", "l.anchor").where(F.col("href").endswith("html"))
    links = links.groupBy("node", "href", "anchor").agg(F.min("pos").alias("pos"))
    return link_scores(pages, links, f).orderBy(F.desc("score"), "node")


def inspection_dates(spark: SparkSession, source: str, target: str) -> None:
    """First and last inspection of every place in the CSV file `source`, as id,first,last."""
    rows = files.inspections(spark, source)
    sinks.first_last_csv(records.first_last(rows, "id", "inspection_date"), target)
