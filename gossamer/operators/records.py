"""Small table pipelines: first and last dates, nesting, listings, set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_last(rows: DataFrame, key: str, date: str, pattern: str = "M/d/yyyy") -> DataFrame:
    """(key, first, last) of the dates in `date`, a DATE or a text in `pattern`.

    A key with a date that can't be read, or is null, is left out whole. Null keys are a key.
    """
    kind = dict(rows.dtypes)[date]
    day = F.try_to_timestamp(F.col(date), F.lit(pattern)).cast("date") if kind == "string" else F.col(date).cast("date")
    each = rows.select(F.col(key), day.alias("__day"))
    out = each.groupBy(key).agg(F.min("__day").alias("first"), F.max("__day").alias("last"), F.count_if(F.col("__day").isNull()).alias("__bad"))
    return out.where("__bad = 0").drop("__bad")


def nested(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """(key, name): per key the array of its rows' `columns`, sorted. The groups are results, of the size of their key's rows."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def amount(price: Column) -> Column:
    """The number after a dollar sign; null if there is none."""
    return F.replace(F.nullif(F.regexp_extract(price, r"\$([0-9][0-9,]*)", 1), F.lit("")), F.lit(",")).cast("int")


def listing_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Fields of the listing rows `<tr id="listing...` of pages: a row each."""
    row = F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?s)<tr id="listing.*?</tr>'), F.lit(0)))
    each = pages.select(row.alias("row"))
    part = lambda p, i=1: F.nullif(F.trim(F.regexp_extract("row", p, i)), F.lit(""))
    cells = lambda c: F.regexp_extract_all(F.col("row"), F.lit(rf'(?s)<td class="{c}"[^>]*>(.*?)</td>'), F.lit(1))
    number = lambda c: F.nullif(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    rooms, sizes = cells("rooms"), cells("size")
    beds = F.coalesce(F.get(rooms, F.lit(0)), F.lit(""))
    return each.select(
        part(r'id="listing_(\d+)"').cast("long").alias("listing_id"), part(r'(?s)<h5>\s*<a[^>]*href="([^"]*)"').alias("href"), part(r"(?s)<h5>\s*<a[^>]*>(.*?)</a>").alias("address"),
        part(r'(?s)<td class="area"[^>]*>(.*?)</td>').alias("area"), part(r'(?s)<td class="type"[^>]*>(.*?)</td>').alias("listing_type"),
        F.when(F.lower(beds).contains("studio"), 0.0).otherwise(number(beds)).alias("beds"), number(F.coalesce(F.get(rooms, F.lit(1)), F.lit(""))).alias("baths"),
        number(F.replace(F.coalesce(F.get(sizes, F.lit(0)), F.lit("")), F.lit(","), F.lit(""))).cast("int").alias("size"), amount(F.col("row")).alias("price"),
    )


def data_layer_rows(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON objects that follow each other in the lines that hold `dataLayer`, read by `schema`.

    A line is cut before each `{"id"`; what precedes the first and the last two pieces are no objects.
    """
    pieces = F.split(F.col(value), r'(?=\{"id")')
    kept = F.slice(pieces, 2, F.greatest(F.size(pieces) - 3, F.lit(0)))
    each = lines.where(F.col(value).contains("dataLayer")).select(F.explode(kept).alias("__piece"))
    return each.select(F.from_json(F.regexp_extract("__piece", r"(\{.*\})", 1), schema).alias("r")).select("r.*")
