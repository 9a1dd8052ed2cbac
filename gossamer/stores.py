"""Queries that write through a sink and read through a source what they have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, urls
from .operators import records
from .shared import shared_path
from .sources import files, sinks
from .sources.tables import table
from .sources.versions import VersionedTable, base_and_deltas
from .streaming import ingest


def _pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "crawl_pages", "page_id", *columns).dropDuplicates(["page_id"])


def page_map_back(spark: SparkSession, folder: str) -> DataFrame:
    """The page map of all pages with their links, written and read again."""
    links = table(spark, folder, "page_links", "page_id", "url", "anchor", "abs_url", "unique_url").groupBy("page_id").agg(F.collect_list(F.struct("url", "anchor", "abs_url", "unique_url")).alias("out_links"))
    pages = _pages(spark, folder, "url", "abs_url", "unique_url", "title", "content").join(links, "page_id", "left").withColumnRenamed("page_id", "id")
    path = shared_path(spark, "page-map")
    sinks.page_map(pages.select(F.col("id").cast("string"), "url", "abs_url", "unique_url", "title", "content", "out_links"), path)
    return files.page_map(spark, path).select("id", "abs_url", "title", F.length("content").alias("chars"), F.coalesce(F.size("out_links"), F.lit(0)).alias("links"))


def raw_pages_back(spark: SparkSession, folder: str) -> DataFrame:
    """Raw contents by file name."""
    path = shared_path(spark, "raw")
    sinks.raw_pages(_pages(spark, folder, "abs_url", "content").where("abs_url IS NOT NULL"), path)
    return spark.read.parquet(path).select("file", F.length("content").alias("chars"))


def appended_back(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to one table."""
    path = shared_path(spark, "appended")
    for kind in ("page", "batch"):
        rows = _pages(spark, folder, "abs_url") if kind == "page" else table(spark, folder, "page_batches", "incoming_id", "abs_url").withColumnRenamed("incoming_id", "page_id")
        sinks.append(rows.select(F.lit(kind).alias("kind"), "page_id", "abs_url"), path)
    return spark.read.parquet(path).select("kind", "page_id", "abs_url")


def dates_csv_back(spark: SparkSession, folder: str) -> DataFrame:
    """First and last order of each customer as id,first,last, read line by line."""
    rows = table(spark, folder, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("id"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    path = shared_path(spark, "dates")
    sinks.first_last_csv(records.first_last(rows, "id", "day"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def data_table_back(spark: SparkSession, folder: str) -> DataFrame:
    """A file of parts with a header, blanks around values and question marks for small ones, read as a data table."""
    path = shared_path(spark, "parts")
    part = table(spark, folder, "part", "p_partkey", "p_size", "p_brand")
    size = F.when(F.col("p_size") < 5, F.lit("?")).otherwise(F.col("p_size").cast("string"))
    part.select(F.concat_ws(", ", F.col("p_partkey").cast("string"), size, "p_brand").alias("key, size, brand")).write.option("header", True).option("quote", "").csv(path, sep="\x01")
    return files.data_table(spark, path, 3, header=True)


def word_list_back(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct words of all titles without stop words, through a word list file."""
    path = shared_path(spark, "words")
    words = table(spark, folder, "index_docs", "title").where("title IS NOT NULL").select(F.explode(text.without_stop_words(F.split("title", " "))).alias("word"))
    words.write.text(path)
    return files.word_list(spark, path)


def versioned_back(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by address, upserted by the batches of even and then of odd number, compacted in between."""
    key = F.col("abs_url").isNotNull()
    newest = lambda df, at: df.where(key).groupBy("abs_url").agg(F.max_by("content", at).alias("content"))
    store = VersionedTable(spark, shared_path(spark, "versioned"))
    store.upsert(newest(table(spark, folder, "crawl_pages", "page_id", "abs_url", "content"), "page_id"))
    batches = table(spark, folder, "page_batches", "incoming_id", "batch_no", "abs_url", "content")
    for odd in (0, 1):
        store.upsert(newest(batches.where(F.col("batch_no") % 2 == odd), "incoming_id"))
        if not odd:
            store.compact()
    return store.read().select("abs_url", F.length("content").alias("chars"))


def base_plus_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The same tables read together without being stored."""
    key = F.col("abs_url").isNotNull()
    base = table(spark, folder, "crawl_pages", "page_id", "abs_url", "content").where(key).groupBy("abs_url").agg(F.max_by("content", "page_id").alias("content"))
    delta = table(spark, folder, "page_batches", "incoming_id", "abs_url", "content").where(key).groupBy("abs_url").agg(F.max_by("content", "incoming_id").alias("content"))
    return base_and_deltas(base, [delta], "abs_url").select("abs_url", F.length("content").alias("chars"))


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder.rstrip('/')}/page_batches.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder.rstrip('/')}/page_batches.parquet*")


def streamed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of all batches, taken in by a stream: the newest of each address."""
    target, state = shared_path(spark, "streamed"), shared_path(spark, "stream-state")
    columns = ["abs_url", "content", "fetched_at"]
    writer = _stream(spark, folder).select(*columns).writeStream.foreachBatch(lambda df, n: ingest.merge_batch(df, target, number=n))
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return VersionedTable(spark, target).read().select("abs_url", F.length("content").alias("chars"))


def streamed_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that arrive a day, counted by a stream."""
    out, state = shared_path(spark, "arrived"), shared_path(spark, "arrived-state")
    rows = ingest.arrivals(_stream(spark, folder).withColumn("arrived_at", F.col("arrived_at").cast("timestamp")), late="3650 days")
    rows = rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "pages")
    writer = rows.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out))
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("day").agg(F.max_by("pages", "n").alias("pages"))


def local_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links within a site as files of a local folder named after the host of their page."""
    pages = _pages(spark, folder, "host").where("host IS NOT NULL")
    rows = table(spark, folder, "page_links", "link_id", "page_id", "url").join(pages, "page_id").where(F.col("url").rlike("^/?[A-Za-z0-9_]") & ~F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    return rows.select("link_id", urls.local(F.concat(F.lit("/pages/"), "host"), F.regexp_replace("url", "^/", "")).alias("path"))


QUERIES = {f.__name__: f for f in (page_map_back, raw_pages_back, appended_back, dates_csv_back, data_table_back, word_list_back, versioned_back, base_plus_delta, streamed_pages, streamed_arrivals, local_links)}

_ONCE = "(SELECT DISTINCT ON (page_id) * FROM crawl_pages) p"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

ORACLE = {
    "page_map_back": f"SELECT CAST(page_id AS VARCHAR) AS id, abs_url, title, length(content) AS chars, CAST(coalesce(n, 0) AS INTEGER) AS links FROM {_ONCE} LEFT JOIN (SELECT page_id, count(*) AS n FROM page_links GROUP BY 1) l USING (page_id)",
    "raw_pages_back": f"SELECT replace(replace(abs_url, '/', '_'), ':', '') AS file, coalesce(length(content), 0) AS chars FROM {_ONCE} WHERE abs_url IS NOT NULL",
    "appended_back": f"SELECT 'page' AS kind, page_id, abs_url FROM {_ONCE} UNION ALL SELECT 'batch', incoming_id, abs_url FROM page_batches",
    "dates_csv_back": "SELECT o_custkey || ',' || strftime(min(o_orderdate), '%m/%d/%Y') || ',' || strftime(max(o_orderdate), '%m/%d/%Y') AS line FROM orders GROUP BY o_custkey HAVING count(*) = count(o_orderdate)",
    "data_table_back": "SELECT CAST(p_partkey AS VARCHAR) AS c0, CASE WHEN p_size >= 5 THEN CAST(p_size AS VARCHAR) END AS c1, trim(p_brand) AS c2 FROM part",
    "word_list_back": f"SELECT DISTINCT word FROM (SELECT trim(regexp_replace(w, '[^-a-zA-Z0-9_ ]', '', 'g')) AS word FROM (SELECT unnest(string_split(title, ' ')) AS w FROM index_docs) x WHERE w NOT IN ({_STOP})) y WHERE word <> ''",
    "versioned_back": """
        WITH c AS (SELECT abs_url, arg_max(content, page_id) FILTER (content IS NOT NULL) AS content, 0 AS n FROM crawl_pages WHERE abs_url IS NOT NULL GROUP BY 1
          UNION ALL SELECT abs_url, arg_max(content, incoming_id) FILTER (content IS NOT NULL), 1 + batch_no % 2 FROM page_batches WHERE abs_url IS NOT NULL GROUP BY abs_url, batch_no % 2)
        SELECT abs_url, length(content) AS chars FROM c QUALIFY row_number() OVER (PARTITION BY abs_url ORDER BY n DESC) = 1""",
    "base_plus_delta": """
        WITH c AS (SELECT abs_url, arg_max(content, page_id) FILTER (content IS NOT NULL) AS content, 0 AS n FROM crawl_pages WHERE abs_url IS NOT NULL GROUP BY 1
          UNION ALL SELECT abs_url, arg_max(content, incoming_id) FILTER (content IS NOT NULL), 1 FROM page_batches WHERE abs_url IS NOT NULL GROUP BY 1)
        SELECT abs_url, length(content) AS chars FROM c QUALIFY row_number() OVER (PARTITION BY abs_url ORDER BY n DESC) = 1""",
    "streamed_pages": "SELECT abs_url, length(content) AS chars FROM page_batches WHERE abs_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY abs_url ORDER BY fetched_at DESC NULLS LAST, content DESC NULLS LAST) = 1",
    "streamed_arrivals": "SELECT strftime(arrived_at, '%Y-%m-%d') AS day, count(*) AS pages FROM page_batches WHERE arrived_at IS NOT NULL GROUP BY 1",
    "local_links": f"SELECT link_id, '/pages/' || p.host || '/' || regexp_replace(l.url, '^/', '') AS path FROM page_links l JOIN {_ONCE} USING (page_id) WHERE p.host IS NOT NULL AND regexp_matches(l.url, '^/?[A-Za-z0-9_]') AND NOT regexp_matches(l.url, '^[A-Za-z][A-Za-z0-9+.-]*:')",
}
