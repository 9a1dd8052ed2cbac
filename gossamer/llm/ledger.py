"""Has this key been seen before? An exact ledger of keys, hash-bucketed on disk.

The history is a bucketed parquet table (key, first_at). A batch is reduced to one row a
key with its first arrival (map-side combined, so a hot key costs one row a task), that is
sort-merge left-joined with the bucketed history (the history isn't shuffled), and the keys
without a partner are appended. A row of the batch is seen unless it is the first arrival of
a new key; that is decided by an anti-join on the arrival, which is unique, so a key that
holds a third of all rows spreads evenly. No answer is ever wrong: the error rate is zero.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_path


#: Keys that a bucket of the ledger is made for.
BUCKET_KEYS = 4_000_000


class KeyLedger:
    """Exact ledger at `path` (a new one in the shared folder by default).

    Null keys are never seen and never stored. Rows with the same arrival count as one
    arrival: of a new key both are unseen. An empty batch changes nothing. Keys are compared
    as stored, byte by byte; an empty string is a key. Columns besides key and arrival play no part.
    keys: how many keys the ledger is going to hold, by which it is cut into buckets.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keys: int = 0):
        self.spark, self.path = spark, path or shared_path(spark, "ledger")
        self.buckets = buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET_KEYS))
        self.table = f"ledger_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (key STRING, batch BIGINT, first_at BIGINT) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def history(self) -> DataFrame:
        return self.spark.table(self.table)

    def accept(self, batch: DataFrame, key: str, arrival: str, batch_no: int) -> DataFrame:
        """The rows of `batch` (key, arrival) whose key was seen earlier; new keys are appended.

        A batch that was already accepted under `batch_no` gives the same answer again and
        appends nothing, so a repeated call after a failure is safe.
        """
        rows = batch.select(F.col(key).alias("key"), F.col(arrival).cast("bigint").alias("at")).where("key IS NOT NULL")
        firsts = rows.groupBy("key").agg(F.min("at").alias("first_at"))
        known = self.history().where(F.col("batch") < batch_no).select("key", F.lit(True).alias("known"))
        mine = self.history().where(F.col("batch") == batch_no)
        if mine.isEmpty():
            fresh = firsts.join(known, "key", "left").where("known IS NULL").select("key", F.lit(batch_no).cast("bigint").alias("batch"), "first_at")
            (
                fresh.repartition(self.buckets, "key")
                .write.format("parquet").mode("append").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.table)
            )
            self.spark.catalog.refreshTable(self.table)
            mine = self.history().where(F.col("batch") == batch_no)
        return rows.join(mine.select(F.col("first_at").alias("at")), "at", "left_anti").select("key", "at")

    def close(self) -> None:
        """Takes the ledger's name out of the catalog; its files stay where they are, and so do answers that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def seen_keys(batch: DataFrame, history: DataFrame, key: str, arrival: str) -> DataFrame:
    """Rows (key, at) of `batch` whose key is in `history` or in a row of `batch` that arrived earlier."""
    ledger = KeyLedger(batch.sparkSession, keys=batch.count())
    ledger.accept(history.select(key, F.lit(-1).alias("__at")), key, "__at", 0)
    seen = ledger.accept(batch, key, arrival, 1)
    ledger.close()
    return seen


def wrong_answers(seen: DataFrame, batch: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """One row (asked, seen, wrong, wrong_rate): how often the answers `seen` (key, at) to `batch` are wrong.

    Checked by another way than the ledger's: of a key's rows all but the first must be seen,
    and the first too if `history` has the key. Rows are counted a key on both sides, and
    what is too many or too few is wrong. Without a row to ask about the rate is 0.
    """
    asked = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("asked"))
    said = seen.groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    old = history.select(F.col(key).alias("key"), F.lit(1).alias("old")).where("key IS NOT NULL").distinct()
    both = asked.join(said, "key", "left").join(old, "key", "left").select("asked", F.coalesce("seen", F.lit(0)).alias("seen"), (F.col("asked") - 1 + F.coalesce("old", F.lit(0))).alias("due"))
    whole = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.col("asked"), "asked"), (F.col("seen"), "seen"), (F.abs(F.col("seen") - F.col("due")), "wrong"))))
    return whole.withColumn("wrong_rate", F.coalesce(F.col("wrong") / F.nullif(F.col("asked"), F.lit(0)), F.lit(0.0)))
