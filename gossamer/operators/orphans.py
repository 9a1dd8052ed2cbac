"""References to records that don't exist, or didn't exist at the time of the reference.

References are aggregated once a key and period (count, first and last time) before anything is
joined. From that table come the few keys that hold more than a fraction of all references, and
the verdict on every key and period: all of its references are orphans, none is, or, where a
record began or ended in between, each must be looked at. Verdicts of heavy keys are checked and
sent by broadcast, as long as they are few; the others go through shuffled joins. Counts a
period are sums of verdicts; rows are looked up only for those that are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import cut

#: A key is heavy if it holds more than this share of all references; so at most 500 are.
HEAVY_SHARE = 1 / 500
#: Rows that may be broadcast, some ten MB; more are joined by a shuffle.
FEW = 100_000


def _parts(url: Column) -> tuple[Column, Column]:
    """Host and the rest of a URL without scheme and fragment."""
    host, rest = (F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", i) for i in (1, 2))
    host = F.lower(host)
    return F.when(F.endswith(host, F.lit(":80")), F.substring(host, F.lit(1), F.length(host) - 3)).otherwise(host), rest


def address(url: Column) -> Column:
    """The URL without scheme and fragment, host in lower case, `:80` dropped, the path as it is.

    Null gives null. A URL without a path gives its host.
    """
    return F.concat(*_parts(url))


def address_host(url: Column) -> Column:
    return _parts(url)[0]


def reference_counts(refs: DataFrame) -> DataFrame:
    """(key, period, n, timeless, low, high) of `refs` (key, period, at): references, those of them without a time, and the first and last time; null keys refer to nothing."""
    return (
        refs.where("key IS NOT NULL").groupBy("key", "period")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at").isNull()).alias("timeless"), F.min("at").alias("low"), F.max("at").alias("high"))
    )


def heavy_keys(counts: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys of reference counts with more than `share` of all references: (key), at most 1 / share rows."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > total * share).select("key")


def _few(df: DataFrame) -> DataFrame:
    """The stored table df, broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _split_join(counts: DataFrame, facts: DataFrame, heavy: DataFrame) -> DataFrame:
    """counts left-joined with facts (key, ...), a row a key: the heavy keys by broadcast, the others by shuffle."""
    marked = counts.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), "key", "left")  # at most 1 / share rows
    of_heavy = cut(facts.join(F.broadcast(heavy), "key", "left_semi"), "heavy")
    often = marked.where("__heavy").join(_few(of_heavy), "key", "left")
    return often.unionByName(marked.where("__heavy IS NULL").join(facts, "key", "left")).drop("__heavy")


def missing_counts(counts: DataFrame, existing: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Of reference counts (key, period, n) those whose key no row of `existing` (key) has."""
    heavy = cut(heavy_keys(counts, share), "heavy-keys")
    there = existing.select("key").where("key IS NOT NULL").groupBy("key").agg(F.lit(True).alias("__there"))
    return _split_join(counts, there, heavy).where("__there IS NULL").drop("__there")


def lifetimes(records: DataFrame) -> DataFrame:
    """Records (key, since, until) as (key, spans): per key the union of [since, until), sorted.

    A null `since` is no lifetime; a null `until` is for ever. Spans that overlap or touch are
    merged day by day first, so that the rows of a hot key spread over many groups.
    """
    far = F.lit("9999-12-31").cast(records.schema["since"].dataType)
    spans = records.where("key IS NOT NULL AND since IS NOT NULL").select("key", "since", F.coalesce("until", far).alias("until")).where("until > since")
    spans = spans.groupBy("key", "since").agg(F.max("until").alias("until"))

    def islands(df: DataFrame, *keys: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("since", "until")
        before = F.max("until").over(w.rowsBetween(W.unboundedPreceding, -1))
        df = df.withColumn("__new", (before.isNull() | (F.col("since") > before)).cast("int"))
        df = df.withColumn("__no", F.sum("__new").over(w))
        return df.groupBy(*keys, "__no").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("__no")

    daily = islands(spans.withColumn("__day", F.date_trunc("day", "since")), "key", "__day")
    merged = islands(daily.select("key", "since", "until"), "key")
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("since", "until"))).alias("spans"))


def verdicts(counts: DataFrame, records: DataFrame, heavy: DataFrame) -> DataFrame:
    """counts with gone and spans: how many of a key and period's references find no row of `records` (key, since, until) alive.

    A record lives from `since` on until before `until`. References without a time find nothing
    alive. Where a lifetime begins or ends between the first and the last reference, gone is null,
    and spans holds the lifetimes in between, by which each reference must be judged; else spans is null.
    """
    joined = _split_join(counts, lifetimes(records), heavy)
    near = F.filter("spans", lambda s: (s["since"] <= F.col("high")) & (s["until"] > F.col("low")))
    joined = joined.withColumn("spans", F.coalesce(near, F.array().cast(joined.schema["spans"].dataType)))
    covered = F.exists("spans", lambda s: (s["since"] <= F.col("low")) & (s["until"] > F.col("high")))
    gone = F.when(F.size("spans") == 0, F.col("n")).when(covered, F.col("timeless"))
    return joined.withColumn("gone", gone).withColumn("spans", F.when(F.col("gone").isNull(), F.col("spans")))


def _open(verdicts_: DataFrame) -> DataFrame:
    """(key, __period, __all, spans) of the verdicts that leave an orphan; a reference without a time has no period, so periods are compared as texts."""
    left = verdicts_.where("gone IS NULL OR gone > 0")
    return left.select("key", F.coalesce("period", F.lit("")).alias("__period"), (F.col("gone") == F.col("n")).alias("__all"), "spans")


def _is_orphan() -> Column:
    """Whether a reference (at) that met its open verdict (__all, spans) is an orphan; null and false for one that met none."""
    alive = F.exists("spans", lambda s: (s["since"] <= F.col("at")) & (s["until"] > F.col("at")))
    judged = F.coalesce("__all", F.lit(False)) | F.col("at").isNull() | (F.col("spans").isNotNull() & ~F.coalesce(alive, F.lit(False)))
    return F.col("__met") & judged


def absent_then(refs: DataFrame, records: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Rows of `refs` (key, period, at, ...) for which no row of `records` (key, since, until) lived at `at`; null keys are left out.

    The references are read once for the counts and once for the rows. Those of heavy keys are
    judged where they are read, by broadcast verdicts; what remains of them goes through the
    shuffle of the others by a number of its own, so it spreads evenly.
    """
    counts = cut(reference_counts(refs), "counts")
    often = cut(heavy_keys(counts, share), "heavy-keys")
    found = cut(verdicts(counts, records, often), "verdicts")
    of_heavy = cut(_open(found.join(F.broadcast(often), "key", "left_semi")), "heavy-verdicts")
    met = F.lit(True).alias("__met")
    rows = refs.where("key IS NOT NULL").withColumn("__period", F.coalesce("period", F.lit("")))
    rows = rows.join(F.broadcast(often.withColumn("__heavy", F.lit(True))), "key", "left").join(_few(of_heavy.select("*", met)), ["key", "__period"], "left")
    rows = rows.withColumn("__gone", F.when(F.col("__heavy"), F.coalesce(_is_orphan(), F.lit(False)))).where("__heavy IS NULL OR __gone").select(*refs.columns, "__period", "__gone")
    rows = rows.withColumn("__own", F.when(F.col("__gone"), F.pmod(F.xxhash64(*refs.columns), F.lit(1 << 31)) + 1).otherwise(F.lit(0).cast("bigint")))
    others = _open(found).select("*", met, F.lit(0).cast("bigint").alias("__own"))
    return rows.join(others, ["key", "__period", "__own"], "left").where(F.col("__gone") | _is_orphan()).select(refs.columns)


def absent_counts(refs: DataFrame, records: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(period, orphans): how many of `refs` (key, period, at) find no row of `records` alive.

    Sums of the verdicts; only references of keys and periods that the verdict leaves open are looked at.
    """
    counts = cut(reference_counts(refs), "counts")
    found = cut(verdicts(counts, records, cut(heavy_keys(counts, share), "heavy-keys")), "verdicts")
    sure = found.where("gone > 0").groupBy("period").agg(F.sum("gone").alias("orphans"))
    unsure = _open(found.where("gone IS NULL")).withColumn("__met", F.lit(True))
    rest = refs.where("key IS NOT NULL").withColumn("__period", F.coalesce("period", F.lit(""))).join(unsure, ["key", "__period"]).where(_is_orphan())
    rest = rest.groupBy("period").agg(F.count(F.lit(1)).alias("orphans"))
    return sure.unionByName(rest).groupBy("period").agg(F.sum("orphans").alias("orphans"))


class Crawl:
    """The references of a crawl, and what they refer to.

    `out_links`: ids in pages.out_links, by the month of pages.stored_at, an id of a page once, and
    pages delivered twice once; they refer to links. `abs_url`: links into the hosts of `sites`,
    by the month of links.seen_at; they refer to seeds, and to pages alive at seen_at. A link row
    that comes twice counts twice in a report and once in a list.
    """

    def __init__(self, pages: DataFrame, links: DataFrame, seeds: DataFrame, sites: DataFrame):
        month = lambda c: F.date_format(c, "yyyy-MM").alias("period")
        once = pages.select("page_id", month("stored_at"), F.array_distinct("out_links").alias("out_links")).distinct()
        self.out = once.select("page_id", "period", F.explode("out_links").alias("key"), F.lit(None).cast("timestamp_ntz").alias("at")).where("key IS NOT NULL")
        self.ids = links.select(F.col("link_id").alias("key"))
        into = links.select("link_id", "abs_url", F.col("seen_at").alias("at"), month("seen_at"), *(c.alias(n) for c, n in zip(_parts(F.col("abs_url")), ("__host", "__rest"))))
        into = into.join(sites.select(F.lower("host").alias("__host")).distinct(), "__host", "left_semi")
        self.into = into.select("link_id", "abs_url", "at", "period", F.concat("__host", "__rest").alias("key"))
        for_ever = seeds.select(address(F.col("abs_url")).alias("key"), F.lit("0001-01-01").cast("timestamp_ntz").alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"))
        self.lives = pages.select(address(F.col("abs_url")).alias("key"), F.col("fetched_at").alias("since"), F.col("removed_at").alias("until")).unionByName(for_ever)


def dangling(crawl: Crawl) -> DataFrame:
    """Dangling references of a crawl: (ref, owner_id, target, period), distinct."""
    gone = missing_counts(cut(reference_counts(crawl.out), "counts"), crawl.ids).select("key").distinct()
    out = crawl.out.join(gone, "key", "left_semi").select(F.lit("out_links").alias("ref"), F.col("page_id").alias("owner_id"), F.col("key").cast("string").alias("target"), "period")
    absent = absent_then(crawl.into, crawl.lives)
    absent = absent.select(F.lit("abs_url").alias("ref"), F.col("link_id").alias("owner_id"), F.col("abs_url").alias("target"), "period")
    return out.distinct().unionByName(absent.distinct())


def dangling_counts(crawl: Crawl) -> DataFrame:
    """(ref, period, orphans): how many dangling references a crawl has, by table and month."""
    gone = missing_counts(cut(reference_counts(crawl.out), "counts"), crawl.ids).groupBy("period").agg(F.sum("n").alias("orphans"))
    absent = absent_counts(crawl.into, crawl.lives)
    return gone.select(F.lit("out_links").alias("ref"), "period", "orphans").unionByName(absent.select(F.lit("abs_url").alias("ref"), "period", "orphans"))
