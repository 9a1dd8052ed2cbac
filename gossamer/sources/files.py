"""Files: folders of pages, page maps, CSV, lists and data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html
from ..shared import exists

#: A page as the page map holds it.
PAGE = "id string, url string, abs_url string, unique_url string, title string, content string, out_links array<struct<url:string,anchor:string,abs_url:string,unique_url:string>>"

# Columns of the inspection file.
INSPECTION = "id name boro building street zipcode phone cuisine inspection_date action violation_code violation_description critical_flag score grade grade_date record_date inspection_type".split()


def html_folder(spark: SparkSession, folder: str, recursive: bool = True, extensions: str = "{html,htm}") -> DataFrame:
    """(filename, html) of the pages in a folder; hidden files are skipped. extensions '*' takes every file."""
    glob = "*" if extensions == "*" else f"*.{extensions}"
    df = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("html"))


def folder_links(spark: SparkSession, folder: str) -> DataFrame:
    """(url, anchor, abs_url): a link for each file right in a folder, without an anchor."""
    df = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("abs_url"))
    return df.select(F.regexp_extract("abs_url", "([^/]+)$", 1).alias("url"), F.lit(None).cast("string").alias("anchor"), "abs_url")


def page_documents(pages: DataFrame) -> DataFrame:
    """(filename, title, contents) of (filename, html): what the directory index holds; title is null without a title element."""
    return pages.select("filename", html.title(F.col("html")).alias("title"), html.body_text(F.col("html")).alias("contents"))


def page_map(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a page map: JSON lines, a page a line, as sinks.page_map writes them, or a JSON document {"pages": {abs_url: page}}; none if there is nothing."""
    if not exists(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(PAGE))
    kind = ", ".join(x.replace(" ", ":", 1) for x in PAGE.split(", "))
    whole = spark.read.schema(f"pages map<string,struct<{kind}>>").json(path, multiLine=True).where("pages IS NOT NULL")
    if not whole.isEmpty():
        return whole.select(F.explode("pages").alias("key", "page")).select("page.*")
    return spark.read.schema(PAGE).json(path)


def last_good(spark: SparkSession, path: str) -> str | None:
    """The page that sinks.last_good kept at `path`, or None."""
    row = spark.read.text(path).first() if exists(spark, path) else None
    return row[0] if row else None


def inspections(spark: SparkSession, path: str) -> DataFrame:
    """Inspection rows of a CSV file with a header and quoted commas, all text; a missing type is empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in INSPECTION])
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', enforceSchema=True).withColumn("inspection_type", F.coalesce("inspection_type", F.lit("")))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word), distinct, of a file with a word on each line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def data_table(spark: SparkSession, path: str, columns: int, sep: str = ",", missing: str = "?", header: bool = False) -> DataFrame:
    """A table of c0, c1, ... from a text file; `missing` is null, blanks around values go, sep ' ' is any run of blanks.

    header: the first line of each file is none of the data, whatever it says.
    """
    lines = spark.read.csv(path, schema="value string", sep="\x01", quote="", escape="", header=header, enforceSchema=True)
    lines = lines.select(F.trim("value").alias("value")).where("value <> ''")
    parts = F.split("value", " +" if sep == " " else f"[{sep}]")
    return lines.select(*(F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit(missing)).alias(f"c{i}") for i in range(columns)))
