"""python -m gossamer COMMAND: the runs of gossamer.plans from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import server
from .operators import snippets
from .plans import runs
from .sources import fetch, files, sinks


def _crawl_options(c: argparse.ArgumentParser) -> argparse.ArgumentParser:
    c.add_argument("-q", "--query", required=True), c.add_argument("-m", "--max", type=int, default=50), c.add_argument("--batch", type=int, default=15)
    c.add_argument("--pages", required=True, help="parquet of page_id, abs_url, title, content"), c.add_argument("--sites", help="parquet of host, robots_txt"), c.add_argument("--target", required=True)
    return c


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gossamer", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index", help="index the HTML files below a folder")
    c.add_argument("folder"), c.add_argument("target")
    c = sub.add_parser("search", help="search an index table")
    c.add_argument("target"), c.add_argument("query", nargs="+", help="its words, put together with blanks"), c.add_argument("-k", type=int, default=10), c.add_argument("--html", action="store_true")
    c = sub.add_parser("crawl", help="crawl a table of pages from a URL and upsert what is found")
    c.add_argument("-u", "--url", required=True)
    c = _crawl_options(c)
    c = sub.add_parser("update", help="crawl again, from a URL or the last good page, and upsert what has changed")
    c.add_argument("-u", "--url", help="where to start; the last good page of the crawl before if none is given")
    c = _crawl_options(c)
    c = sub.add_parser("ranks", help="PageRank of the pages in a folder")
    c.add_argument("folder"), c.add_argument("-f", type=float, default=0.7)
    c = sub.add_parser("serve", help="answer searches of an index over HTTP")
    c.add_argument("target"), c.add_argument("--port", type=int, default=8080)
    c = sub.add_parser("fetch", help="fetch the pages that a file names, a URL a line, into a table")
    c.add_argument("urls"), c.add_argument("target")
    c = sub.add_parser("inspections", help="first and last inspection of every place in a CSV file")
    c.add_argument("source"), c.add_argument("target")
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> str:
    a = arguments().parse_args(argv)
    if a.command == "index":
        return f"{runs.index_folder(spark, a.folder, a.target)} documents"
    if a.command == "search":
        rows = runs.hits(spark, a.target, " ".join(a.query), a.k)
        return (snippets.as_html(rows).select(snippets.broken_lines(F.col("html"))) if a.html else snippets.as_text(rows)).first()[0]
    if a.command in ("crawl", "update"):
        actions = runs.crawl_and_index(a.url, a.query, spark.read.parquet(a.pages), a.target, spark.read.parquet(a.sites) if a.sites else None, a.max, a.batch)
        return "\n".join(f"{r.action} {r.n}" for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).orderBy("action").collect())
    if a.command == "ranks":
        return "\n".join(f"{r.node} {r.score:.6f}" for r in runs.folder_ranks(spark, a.folder, a.f).toLocalIterator())
    if a.command == "serve":
        answering = server.server(spark, a.target, a.port)
        print(f"http://{answering.server_address[0]}:{answering.server_address[1]}/")
        answering.serve_forever()
    if a.command == "fetch":
        sinks.append(fetch.fetched(files.word_list(spark, a.urls).withColumnRenamed("word", "url")), a.target)
        return a.target
    runs.inspection_dates(spark, a.source, a.target)
    return a.target


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("gossamer").getOrCreate()))
