"""Snippets of a text for a query: windows about the hits, merged, cut and highlighted.

The query is a constant, so everything is column expressions over one array of words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html, text

#: Words of a snippet, words to either side of a hit, characters and tries of the widening.
SIZE, AROUND, CHARS, TRIES = 40, 5, 40, 15


def merged_rows(intervals: DataFrame, gap: int, key: str = "doc_id") -> DataFrame:
    """Intervals (key, start, end) with those joined that overlap or lie at most `gap` apart.

    Both ends belong to an interval. One window sort by key; the longest chain of a key is one task's.
    """
    w = W.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.where("start IS NOT NULL AND end IS NOT NULL").withColumn("__new", (before.isNull() | (F.col("start") > before + gap)).cast("int"))
    return marked.withColumn("__no", F.sum("__new").over(w)).groupBy(key, "__no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__no")


def merged(intervals: Column, gap: int) -> Column:
    """The same for an array of structs (start, end)."""
    empty = F.slice(intervals, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        near = F.size(acc) > 0
        return F.when(near & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + gap), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    step_safe = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x))
    return F.aggregate(F.array_sort(intervals), empty, step_safe)


def _window(words: Column, begin: Column, end: Column, by: Column) -> Column:
    return text.joined_slice(words, F.greatest(begin - by, F.lit(0)), F.least(end + by, F.size(words) - 1))


def reduced(content: Column, query: str) -> Column:
    """The part of a text that answers `query`.

    If the whole query stands in it, AROUND words to either side, widened word by word until the
    window has over CHARS characters or TRIES are used up. Else windows about the query's words
    (stop words left out): a span of under SIZE words is widened to it, farther hits are merged
    windows joined by ` ... `. Without a hit, the first SIZE + 1 words.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), "[ \t\n\r\f]+", " "))
    asked = query.strip()
    wanted = [re.sub(r"[^-a-z0-9_]", "", w.lower()) for w in asked.split(" ") if w not in text.STOP_WORDS]
    wanted = [w for w in dict.fromkeys(wanted) if w]

    def whole(x: Column) -> Column:
        begin = F.size(F.split(F.substring(x["flat"], F.lit(1), F.greatest(x["at"] - 1, F.lit(0))), " ")) - 1

        def widened(y: Column) -> Column:
            end = y["begin"] + len(asked.split(" ")) - 1
            by = F.get(F.filter(F.sequence(F.lit(AROUND), F.lit(AROUND + TRIES)), lambda w: F.length(_window(y["words"], y["begin"], end, w)) > CHARS), F.lit(0))
            return _window(y["words"], y["begin"], end, F.coalesce(by, F.lit(AROUND + TRIES)))

        return text.bound(F.struct(x["words"].alias("words"), begin.alias("begin")), widened)

    def about_hits(words: Column, hits: Column) -> Column:
        first, last = F.array_min(hits), F.array_max(hits)
        # widened on both sides alike until it has SIZE words, or the text ends
        side = F.ceil((SIZE - (last - first + 1)) / 2).cast("int")
        one = _window(words, first, last, F.greatest(side, F.lit(0)))
        windows = F.transform(hits, lambda p: F.struct(F.greatest(p - AROUND, F.lit(0)).alias("start"), F.least(p + AROUND, F.size(words) - 1).alias("end")))
        many = F.array_join(F.transform(merged(windows, AROUND), lambda x: text.joined_slice(words, x["start"], x["end"])), " ... ")
        return F.when(last - first < SIZE, one).otherwise(many)

    def parts(words: Column) -> Column:
        head = text.joined_slice(words, F.lit(0), F.lit(SIZE))
        if not wanted:
            return head
        marks = F.transform(words, lambda w, i: F.when(F.lower(text.cleaned(w)).isin(*wanted), i))
        hits = F.filter(marks, lambda i: i.isNotNull())
        return text.bound(F.struct(words.alias("w"), hits.alias("h")), lambda y: F.when(F.size(y["h"]) == 0, head).otherwise(about_hits(y["w"], y["h"])))

    at = F.locate(asked.lower(), F.lower(flat)) if asked else F.lit(0)
    bundle = F.struct(flat.alias("flat"), F.split(flat, " ").alias("words"), at.alias("at"))
    return text.bound(bundle, lambda x: F.when(x["at"] > 0, whole(x)).otherwise(parts(x["words"])))


def highlighted(snippet: Column, query: str) -> Column:
    """The whole query in <b>, wherever it stands; if it doesn't, each of its words. Case doesn't matter."""
    asked = query.strip()
    if not asked:
        return snippet
    words = sorted({w for w in asked.split(" ") if w}, key=lambda w: (-len(w), w))
    wrap = lambda p: F.regexp_replace(snippet, f"(?i)({p})", "<b>$1</b>")
    return F.when(F.contains(F.lower(snippet), F.lit(asked.lower())), wrap(re.escape(asked))).otherwise(wrap("|".join(map(re.escape, words))))


def shortened(snippet: Column, size: int = SIZE) -> Column:
    """At most `size` words, but on to the end of a <b> that is still open there."""

    def cut(words: Column) -> Column:
        head = F.array_join(F.slice(words, 1, size), " ")
        opened = text.occurrences(head, F.lit("<b>")) > text.occurrences(head, F.lit("</b>"))
        tail = F.slice(words, size + 1, F.greatest(F.size(words) - size, F.lit(0)))
        marks = F.filter(F.transform(tail, lambda w, i: F.when(F.contains(w, F.lit("</b>")), i + 1)), lambda i: i.isNotNull())
        more = F.array_join(F.slice(tail, 1, F.coalesce(F.get(marks, F.lit(0)), F.size(tail))), " ")
        return F.when(opened & (F.size(tail) > 0), F.concat(head, F.lit(" "), more)).otherwise(head)

    return text.bound(F.split(snippet, " "), lambda words: F.when(F.size(words) <= size, F.array_join(words, " ")).otherwise(cut(words)))


def snippet(content: Column, query: str) -> Column:
    return shortened(highlighted(reduced(content, query), query))


def as_html(results: DataFrame) -> DataFrame:
    """One row (html) that lists `results` (rank, title, abs_url, snippet), by rank; results are a page of hits.

    Titles and URLs are escaped, a snippet keeps its <b>. Without a result it says so.
    """
    safe = F.replace(F.replace(html.escaped(F.coalesce("snippet", F.lit(""))), F.lit("&lt;b&gt;"), F.lit("<b>")), F.lit("&lt;/b&gt;"), F.lit("</b>"))
    url = html.escaped(F.col("abs_url"))
    # Fixed value: the line of a result.
    line = F.format_string('<div><b>%d: <a href="%s">%s</a></b><br>%s<br><a href="%s">%s</a></div>', F.col("rank").cast("long"), url, html.escaped(F.coalesce("title", "abs_url")), safe, url, url)
    rows = results.select(F.struct("rank", line.alias("line")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("r"))
    found = F.concat(F.lit("<h3>Results:</h3>"), F.array_join(F.transform("r", lambda x: x["line"]), ""))
    return rows.select(F.when(F.size("r") > 0, found).otherwise("<h3>No results were found</h3>").alias("html"))


def as_text(results: DataFrame) -> DataFrame:
    """The same as plain text; without a result it says so."""
    line = F.format_string("%d: %s\nURL: %s\n%s\n\n", F.col("rank").cast("long"), F.coalesce("title", "abs_url"), "abs_url", F.coalesce("snippet", F.lit("")))
    rows = results.select(F.struct("rank", line.alias("line")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("r"))
    joined = F.array_join(F.transform("r", lambda x: x["line"]), "")
    return rows.select(F.when(F.size("r") > 0, joined).otherwise("No results were found").alias("text"))


def broken_lines(page: Column) -> Column:
    """A line end after each closing div, for a console."""
    return F.regexp_replace(page, "(</div>)", "$1\n")
