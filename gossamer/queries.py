"""Queries of the core operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html, text, urls
from .operators import crawl, index, links, orphans, pagerank, records, robots, search, snippets
from .plans import runs
from .shared import exists, shared_path
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: What the queries ask for.
QUERY = "walrus kitchen crawler"
PHRASE = "before the deadline"
DAMPING, ROUNDS = 0.7, 3


def _pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Pages once each, however often they were delivered."""
    return table(spark, folder, "crawl_pages", "page_id", *columns).dropDuplicates(["page_id"])


def _docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "index_docs", "index_id", *columns)


# --- pages and links


def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, "url", "content").select("page_id", F.coalesce(html.title(F.col("content")), "url").alias("title"))


def page_words(spark: SparkSession, folder: str) -> DataFrame:
    n = F.size(text.words(html.text(F.col("content"))))
    return _pages(spark, folder, "content").where("content IS NOT NULL").select("page_id", n.alias("words"), F.round(F.log2(n), 6).alias("phi"))


def page_body_chars(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, "content").select("page_id", F.length(html.body_text(F.col("content"))).alias("chars"))


def page_out_links(spark: SparkSession, folder: str) -> DataFrame:
    return links.extracted(table(spark, folder, "crawl_pages", "page_id", "abs_url", "content")).select("page_id", "pos", "href", "abs_url", "unique_url")


def link_urls(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("abs_url")
    return table(spark, folder, "page_links", "link_id", "abs_url").select("link_id", urls.base(u).alias("base"), urls.folder(u).alias("folder"), urls.valid(u).alias("is_valid"), urls.file_name(u).alias("file_name"), urls.unique(u).alias("unique_url"), urls.host(u).alias("host"))


def host_page_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, "host").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


def robots_rules(spark: SparkSession, folder: str) -> DataFrame:
    return robots.rules(table(spark, folder, "sites", "host", "robots_txt")).select("host", "allowed_all", F.array_join("disallow", " ").alias("disallow"))


def robots_safe_links(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "page_links", "link_id", "abs_url").select("link_id", urls.host(F.col("abs_url")).alias("host"), urls.path(F.col("abs_url")).alias("path"))
    return robots.safe(each, table(spark, folder, "sites", "host", "robots_txt")).select("link_id")


def page_walked_chars(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, "content").select("page_id", F.length(html.walked_text(F.col("content"))).alias("chars"))


def anchor_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The polynomial hash of every anchor with its number of characters."""
    return table(spark, folder, "page_links", "link_id", "anchor").select("link_id", text.polynomial_hash(F.col("anchor"), F.length("anchor")).alias("hash"))


def link_scores(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "page_links", "link_id", "page_id", "pos", "url", "anchor", "abs_url", "unique_url").withColumnRenamed("url", "href")
    return links.scored(table(spark, folder, "crawl_pages", "page_id", "content"), each, QUERY).select("link_id", "score")


def frontier_top(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "page_links", "link_id", "page_id", "pos", "url", "anchor", "abs_url", "unique_url").withColumnRenamed("url", "href")
    scores = links.scored(table(spark, folder, "crawl_pages", "page_id", "content"), each, QUERY)
    return links.frontier(scores).select("abs_url", "score", "links").orderBy(F.desc("score"), "abs_url").limit(20)


def unseen_links(spark: SparkSession, folder: str) -> DataFrame:
    """Link targets that no page answers."""
    pages = table(spark, folder, "crawl_pages", "unique_url")
    return table(spark, folder, "page_links", "unique_url").join(pages, "unique_url", "left_anti").where("unique_url IS NOT NULL").distinct()


def linked_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder, "unique_url").join(table(spark, folder, "page_links", "unique_url"), "unique_url", "left_semi").select("page_id")


def crawl_order(spark: SparkSession, folder: str) -> DataFrame:
    """A crawl with the default budget, from the page with the most links to known pages among those that robots rules allow."""
    pages = _pages(spark, folder, "abs_url", "content").where("abs_url IS NOT NULL")
    allowed = robots.safe(pages.select("page_id", urls.host(F.col("abs_url")).alias("host"), urls.path(F.col("abs_url")).alias("path")), table(spark, folder, "sites", "host", "robots_txt")).select("page_id")
    known = pages.select(urls.unique(F.col("abs_url")).alias("unique_url")).distinct()
    often = links.extracted(pages).join(allowed, "page_id").join(known, "unique_url").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    first = pages.join(often, "page_id").agg(F.max_by("abs_url", F.struct("n", -F.col("page_id")))).first()[0]
    return crawl.crawl(first or "", QUERY, table(spark, folder, "crawl_pages", "page_id", "abs_url", "content"), table(spark, folder, "sites", "host", "robots_txt"), batch=5)


def last_good(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "crawl_pages", "page_id", "abs_url").select("abs_url", F.col("page_id").alias("seq"), "page_id")
    return crawl.last_good_page(seen, table(spark, folder, "page_links", "page_id"))


# --- index and search


_STORED: dict[tuple[str, str, str], str] = {}


def _kept(spark: SparkSession, folder: str, what: str, write: Callable[[str], object]) -> str:
    """Where something is stored that searches need and no query changes: written once a session and folder, and again if it is gone."""
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _STORED or not exists(spark, _STORED[key]):
        path = shared_path(spark, what)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def _index(spark: SparkSession, folder: str) -> index.Index:
    return index.Index.open(spark, _kept(spark, folder, "index", lambda path: index.Index.of(_docs(spark, folder, "contents", "title"), "contents", "title").store(path)))


def postings_df(spark: SparkSession, folder: str) -> DataFrame:
    return index.dictionary(_index(spark, folder).postings.where("field = 'contents'"))


def doc_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return index.lengths(_docs(spark, folder, "contents"), "contents")


def doc_count(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).agg(F.count(F.lit(1)).alias("docs"))


def _search(query: str, k: int | None = None, scoring: str = "tfidf", default: str = "contents") -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        hits = search.matches(_index(spark, folder), query, default=default, scoring=scoring)
        return (search.top(hits, k) if k else hits).select("doc_id", F.round("score", 6).alias("score"))

    return run


def two_field_merge(spark: SparkSession, folder: str) -> DataFrame:
    return search.two_fields(_index(spark, folder), QUERY).select("doc_id", "field", F.round("score", 6).alias("score"))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages as nodes, and the strengths of their links as weights."""
    pages = table(spark, folder, "crawl_pages", "page_id", "unique_url", "content").withColumnRenamed("page_id", "node")
    targets = pages.where("unique_url IS NOT NULL").groupBy("unique_url").agg(F.min("node").alias("dst"))
    each = table(spark, folder, "page_links", "page_id", "pos", "unique_url", "url", "anchor").join(targets, "unique_url")
    edges = pagerank.strengths(pages, each.select(F.col("page_id").alias("node"), "dst", "pos", F.col("url").alias("href"), "anchor"))
    return pagerank.bases(pages), pagerank.normalized(edges)


def pagerank_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pagerank.ranks(*_graph(spark, folder), f=DAMPING, iterations=ROUNDS).select("node", F.round("score", 9).alias("score"))


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Converged scores (node, score), kept."""
    return spark.read.parquet(_kept(spark, folder, "ranks", lambda path: pagerank.ranks(*_graph(spark, folder), f=DAMPING).write.parquet(path)))


def pagerank_converged(spark: SparkSession, folder: str) -> DataFrame:
    return _ranks(spark, folder).select("node", F.round("score", 9).alias("score"))


def _doc_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the score of the page at its address, whatever its spelling; 0 without one."""
    at = lambda df: df.withColumn("address", orphans.address(F.col("abs_url")))
    latest = at(_pages(spark, folder, "abs_url")).where("address IS NOT NULL").groupBy("address").agg(F.min("page_id").alias("node"))
    scores = latest.join(_ranks(spark, folder), "node").select("address", "score")
    return at(_docs(spark, folder, "abs_url")).join(scores, "address", "left").select(F.col("index_id").alias("doc_id"), F.coalesce("score", F.lit(0.0)).alias("rank"))


def _kept_doc_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(_kept(spark, folder, "doc-ranks", lambda path: _doc_ranks(spark, folder).write.parquet(path)))


def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.top(search.matches(_index(spark, folder), QUERY), 50)
    return search.fused(_kept_doc_ranks(spark, folder), hits, 10).select("doc_id", F.round("rank", 9).alias("rank"), F.round("text_score", 6).alias("text_score"), F.round("score", 6).alias("score"))


def strict_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Links into the crawl with the page each leads to; one that has none would be an error."""
    pages = _pages(spark, folder, "unique_url").where("unique_url IS NOT NULL").groupBy("unique_url").agg(F.min("page_id").alias("target"))
    inside = table(spark, folder, "page_links", "link_id", "unique_url").join(pages, "unique_url", "left_semi")
    return links.strictly_joined(inside, pages, "unique_url").select("link_id", "target")


def search_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship's ranking."""
    best = runs.ranked(_index(spark, folder), _kept_doc_ranks(spark, folder), QUERY)
    return best.join(_docs(spark, folder, "title", "abs_url").withColumnRenamed("index_id", "doc_id"), "doc_id").select("rank", "doc_id", "title", "abs_url", F.round("score", 6).alias("score"))


def search_page(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: text hits, ranked by links, with highlighted snippets."""
    return runs.ranked_results(_docs(spark, folder, "title", "abs_url", "contents"), _index(spark, folder), _kept_doc_ranks(spark, folder), QUERY)


def search_page_html(spark: SparkSession, folder: str) -> DataFrame:
    return snippets.as_html(search_page(spark, folder)).select(snippets.broken_lines(F.col("html")).alias("html"))


def search_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return snippets.as_text(search_page(spark, folder))


def phrase_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets of the documents in which the whole query stands."""
    rows = _docs(spark, folder, "contents").where(F.contains(F.lower(F.regexp_replace("contents", "[ \t\n\r\f]+", " ")), F.lit(PHRASE)))
    return rows.select("index_id", snippets.snippet(F.col("contents"), PHRASE).alias("snippet"))


def doc_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "contents").select("index_id", snippets.snippet(F.col("contents"), PHRASE).alias("snippet"))


def highlighted_titles(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder, "title").select("index_id", snippets.highlighted(F.col("title"), "notes the").alias("title"))


def hit_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of five words about each `deadline`, those at most five words apart joined."""
    each = _docs(spark, folder, "contents").select(F.col("index_id").alias("doc_id"), F.posexplode(text.terms(F.col("contents"))).alias("pos", "term")).where("term = 'deadline'")
    return snippets.merged_rows(each.select("doc_id", (F.col("pos") - 5).alias("start"), (F.col("pos") + 5).alias("end")), 5)


# --- versions


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages of the batches and, of each address, the page that was fetched last."""
    new = table(spark, folder, "page_batches", "incoming_id", "abs_url", "content")
    old = table(spark, folder, "crawl_pages", "page_id", "abs_url", "content", "fetched_at").groupBy("abs_url").agg(F.max_by("content", F.struct("fetched_at", "page_id")).alias("content"))
    return new, old


def upsert_actions(spark: SparkSession, folder: str) -> DataFrame:
    return index.upsert_actions(*_versions(spark, folder), "abs_url", "content").select("incoming_id", "similarity", "action")


def version_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and estimated similarity of each incoming page with the last fetch of its address."""
    new, old = _versions(spark, folder)
    both = new.join(old.withColumnRenamed("content", "old"), "abs_url").where("content <> '' AND old <> ''")
    a, b = index.shingles(F.col("content")), index.shingles(F.col("old"))
    both = both.select("incoming_id", a.alias("a"), b.alias("b"))
    return both.select("incoming_id", F.round(index.jaccard(F.col("a"), F.col("b")), 9).alias("exact"), index.minhash_estimate(index.minhash(F.col("a")), index.minhash(F.col("b"))).alias("estimate"))


def version_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of each incoming page with the last fetch of its address, by sets of runs."""
    return version_minhash(spark, folder).select("incoming_id", "exact")


def upserted_addresses(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _versions(spark, folder)
    latest = new.where("abs_url IS NOT NULL").groupBy("abs_url").agg(F.max_by("content", "incoming_id").alias("content"))
    actions = index.upsert_actions(latest, old, "abs_url", "content").where("action <> 'skip'")
    return index.upsert(old, actions.select("abs_url", "content"), "abs_url").select("abs_url", F.length("content").alias("chars"))


# --- small tables


def first_last_events(spark: SparkSession, folder: str) -> DataFrame:
    return records.first_last(table(spark, folder, "events", "user_id", "ts"), "user_id", "ts").select("user_id", F.col("first").alias("first_day"), F.col("last").alias("last_day"))


def first_last_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", "o_custkey", "o_orderdate").select("o_custkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    return records.first_last(rows, "o_custkey", "day").select("o_custkey", F.date_format("first", "MM/dd/yyyy").alias("first_day"), F.date_format("last", "MM/dd/yyyy").alias("last_day"))


def nested_orders(spark: SparkSession, folder: str) -> DataFrame:
    out = records.nested(table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderkey", "o_orderstatus"], "orders")
    return out.select("o_custkey", F.array_join(F.transform("orders", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"])), " ").alias("orders"))


def _nations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return (table(spark, folder, t, c).toDF("nation") for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))


def set_union(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _nations(spark, folder)
    return a.union(b).distinct()


def set_intersection(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _nations(spark, folder)
    return a.intersect(b)


def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _nations(spark, folder)
    return a.subtract(b)


def score_ties(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part", "p_partkey", "p_retailprice").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"))
    return pagerank.without_ties(rows)


# --- problem 7


def _crawl(spark: SparkSession, folder: str) -> orphans.Crawl:
    return orphans.Crawl(
        table(spark, folder, "crawl_pages", "page_id", "abs_url", "out_links", "fetched_at", "stored_at", "removed_at"),
        table(spark, folder, "page_links", "link_id", "abs_url", "seen_at"),
        table(spark, folder, "seed_urls", "abs_url"),
        table(spark, folder, "sites", "host"),
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.dangling(_crawl(spark, folder)).select("ref", "owner_id", "target").distinct()


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table and month."""
    return orphans.dangling_counts(_crawl(spark, folder))


SEARCHES: dict[str, Query] = {
    "tfidf_top": _search(QUERY, 10),
    "tfidf_all": _search(QUERY),
    "bm25_top": _search(QUERY, 10, "bm25"),
    "bool_and": _search("walrus AND fjord"),
    "bool_not": _search("walrus -fjord"),
    "phrase_hits": _search(f'"{PHRASE}"'),
    "slop_hits": _search('"walrus guards"~2'),
    "field_hits": _search("title:notes"),
    "prefix_hits": _search("walr*"),
    "wildcard_hits": _search("w?lrus"),
    "fuzzy_hits": _search("walrsu~"),
    "range_hits": _search("[waiter TO walrus]"),
    "open_range_hits": _search("{waiter TO walrus}"),
    "fuzzy_one_hits": _search("walrsus~1"),
    "long_slop_hits": _search('"walrus and guards narrow"~4'),
    "boosted_hits": _search("walrus^2 kitchen"),
    "grouped_hits": _search("(walrus OR kitchen) AND deadline"),
}

FLAGSHIP = "search_page"

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        page_titles, page_words, page_body_chars, page_walked_chars, anchor_hashes, page_out_links, link_urls, host_page_counts, robots_rules, robots_safe_links, link_scores, frontier_top, unseen_links, linked_pages, crawl_order, last_good,
        postings_df, doc_lengths, doc_count, two_field_merge, pagerank_pages, pagerank_converged, rank_fusion, strict_targets, search_ranked, search_page, search_page_html, search_page_text, doc_snippets, phrase_snippets, highlighted_titles, hit_intervals,
        upsert_actions, version_minhash, version_exact, upserted_addresses, first_last_events, first_last_orders, nested_orders, set_union, set_intersection, set_difference, score_ties, p7_found, p7_report,
    )
} | SEARCHES
