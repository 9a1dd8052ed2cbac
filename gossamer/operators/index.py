"""Inverted index tables, and upserts that near-duplicates of the old version don't cause."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..shared import file_bytes

#: Run length and similarity of the near-duplicate gate of an update.
SHINGLE, SIMILAR = 4, 0.9
#: Folders of terms that the postings of a stored index are dealt to, and bytes of documents for which a folder has a part, so that a term of most documents isn't one task's.
BUCKETS, PART_BYTES = 64, 32 << 20


def postings(docs: DataFrame, *fields: str, id_: str = "index_id") -> DataFrame:
    """(field, term, doc_id, tf, positions, length, bucket) of `docs`; a null or empty field has none.

    positions count all terms of the field, length those that are no stop words. Documents indexed
    twice count under their own ids; rows of one id are told apart by nothing, so their terms add
    up. One shuffle deals the terms to their buckets, and by document to parts of them, and groups them there.
    """
    size = file_bytes(docs)
    parts = size // (BUCKETS * PART_BYTES) + 1 if size < 1 << 60 else 1  # a table that isn't in files has no size
    each = docs.select(F.col(id_).alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text.terms(F.col(f)).alias("terms")) for f in fields))).alias("x"))
    each = each.select("doc_id", "x.field", F.col("x.terms").alias("terms"), F.size(F.filter("x.terms", text.indexed)).alias("length"))
    each = each.select("doc_id", "field", "length", F.posexplode("terms").alias("pos", "term")).where(text.indexed(F.col("term")))
    each = each.withColumns({"bucket": bucket(F.col("term")), "part": F.pmod(F.xxhash64("doc_id"), F.lit(parts))}).repartition("bucket", "part")
    grouped = each.groupBy("bucket", "part", "field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.max("length").alias("length"))
    return grouped.select("field", "term", "doc_id", "tf", "positions", "length", "bucket")


def bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


@dataclass
class Index:
    """Postings as in postings(), and (field, docs, total): how many documents there are and the sum of their lengths in that field."""

    postings: DataFrame
    sizes: DataFrame

    @staticmethod
    def of(docs: DataFrame, *fields: str, id_: str = "index_id") -> Index:
        """The index of a table that isn't stored; every search reads the table."""
        sizes = [lengths(docs, f, id_).agg(F.lit(f).alias("field"), F.count(F.lit(1)).alias("docs"), F.sum("length").alias("total")) for f in fields]
        both = sizes[0]
        for x in sizes[1:]:
            both = both.unionByName(x)
        return Index(postings(docs, *fields, id_=id_), both)

    def store(self, path: str) -> Index:
        """Writes the index: a folder a bucket of terms, sorted by term, so a search reads its terms' folders and row groups only."""
        self.postings.sortWithinPartitions("bucket", "field", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
        return Index.open(self.postings.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        kind = "field string, term string, doc_id bigint, tf bigint, positions array<int>, length int, bucket int"
        return Index(spark.read.schema(kind).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"))


def dictionary(postings_: DataFrame) -> DataFrame:
    """(term, df, cf): documents that hold the term and its occurrences."""
    return postings_.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def lengths(docs: DataFrame, field: str, id_: str = "index_id") -> DataFrame:
    return docs.select(F.col(id_).alias("doc_id"), F.coalesce(F.size(F.filter(text.terms(F.col(field)), text.indexed)), F.lit(0)).alias("length"))


def shingles(content: Column, k: int = SHINGLE) -> Column:
    """Array of runs of k words, repeated ones too. Signs are dropped before the text is split, so words on two lines run together; under k words there is none."""
    words = F.filter(F.split(F.regexp_replace(content, "[^a-zA-Z0-9 ]", ""), "[ \n\r]+"), lambda x: x != "")

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
        return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<string>"))

    return F.coalesce(text.bound(words, runs), F.array().cast("array<string>"))


def counted(runs: Column) -> Column:
    """Distinct (run, count) as strings: the same run of another count is another element.

    The sorted array is folded once: a run's number counts up along its equals, and what stands
    before another run is the count of the run it ends.
    """

    def count(s: Column) -> Column:
        distinct = F.size(F.array_distinct(s))
        single = F.transform(s, lambda x: F.concat(x, F.lit("#1")))  # no run comes twice: nothing to count
        return F.when(distinct == F.size(s), single).otherwise(text.bound(F.array_sort(s), ends))

    def ends(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.coalesce(F.get(s, i - 2), F.lit(""))))
        return text.bound(F.struct(s.alias("s"), begins.alias("b")), lambda x: F.transform(x["b"], lambda i, k: F.concat(F.get(x["s"], i - 1), F.lit("#"), (F.coalesce(F.get(x["b"], k + 1), F.size(x["s"]) + 1) - i).cast("string"))))

    return F.coalesce(text.bound(runs, count), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""

    def ratio(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), both / (F.size(F.array_distinct(x["a"])) + F.size(F.array_distinct(x["b"])) - both)).otherwise(F.lit(0.0))

    return text.bound(F.struct(a.alias("a"), b.alias("b")), ratio)


def minhash(runs: Column, permutations: int = 200) -> Column:
    """Smallest seeded hash of the runs for each of `permutations` seeds."""
    seeds = F.sequence(F.lit(1), F.lit(permutations))
    hashed = F.transform(F.array_distinct(runs), lambda x: F.xxhash64(x))
    return text.bound(hashed, lambda hs: F.transform(seeds, lambda s: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, s)))))


def minhash_estimate(a: Column, b: Column) -> Column:
    """Share of equal minima: the expected similarity of the sets behind them."""
    equal = F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()), lambda x: x)
    return F.size(equal) / F.size(a)


def similarity_of_versions(new: DataFrame, old: DataFrame, key: str, content: str, k: int = SHINGLE) -> DataFrame:
    """new (key, ...) left-joined with old (key, content): adds old_content and similarity (null for a new key)."""
    there = old.select(F.col(key), F.col(content).alias("old_content"), F.lit(True).alias("known"))
    both = new.join(there, key, "left")
    a, b = (counted(shingles(F.coalesce(F.col(c), F.lit("")), k)) for c in (content, "old_content"))
    return both.withColumn("similarity", F.when(F.col("known"), F.round(jaccard(a, b), 9)))


def upsert_actions(new: DataFrame, old: DataFrame, key: str, content: str, threshold: float = SIMILAR) -> DataFrame:
    """new with similarity and action: insert (key unknown), skip (near-duplicate of the old version), update."""
    rows = similarity_of_versions(new, old, key, content)
    action = F.when(F.col("known").isNull(), "insert").when(F.col("similarity") >= threshold, "skip").otherwise("update")
    return rows.withColumn("action", action).drop("known", "old_content")


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """base with the rows of delta in place of its rows of the same key; a replay gives the same."""
    return base.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta.select(base.columns))
