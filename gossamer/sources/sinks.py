"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def page_map(pages: DataFrame, path: str) -> None:
    """Pages (columns of files.PAGE) as JSON lines, the whole map anew; files.page_map reads them back."""
    pages.write.mode("overwrite").json(path)


def raw_pages(pages: DataFrame, path: str, files: int | None = None) -> None:
    """(file, content) of `pages` (abs_url, content) in `files` parquet files, hashed and sorted by the file name made of the URL; the pages are one each by name, not a folder each."""
    rows = pages.select(urls.file_name(F.col("abs_url")).alias("file"), F.coalesce("content", F.lit("")).alias("content"))
    (rows.repartition(files, "file") if files else rows.repartition("file")).sortWithinPartitions("file").write.mode("overwrite").parquet(path)


def last_good(page: DataFrame, path: str) -> None:
    """Keeps the page (abs_url) that a crawl can go on from."""
    page.coalesce(1).write.mode("overwrite").text(path)


def first_last_csv(rows: DataFrame, path: str) -> None:
    """id,first,last without header; dates as MM/dd/yyyy."""
    rows.select("id", *(F.date_format(c, "MM/dd/yyyy") for c in ("first", "last"))).write.mode("overwrite").csv(path, header=False, quote="")
