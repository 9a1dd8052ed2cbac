"""Pages that arrive in a folder, upserted into a table unless they are near-duplicates of what it has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..shared import cut
from ..sources.versions import VersionedTable


def merge_batch(batch: DataFrame, target: str, key: str = "abs_url", content: str = "content", order: str = "fetched_at", number: int | None = None) -> DataFrame:
    """Upserts a batch into the versioned table `target`; gives the batch's rows with their action.

    Of several rows of one key in the batch the latest counts. The batch is appended as a delta;
    the same batch number again changes nothing, nor do the same rows: they are near-duplicates of
    themselves by then.
    """
    newest = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(order, content)).alias("r")).select("r.*")
    table = VersionedTable(batch.sparkSession, target, key)
    base = table.read() if table.exists() else batch.sparkSession.createDataFrame([], batch.schema)
    actions = cut(index.upsert_actions(newest, base, key, content), "actions")
    changed = actions.where("action <> 'skip'").select(batch.columns)
    if not changed.isEmpty():
        table.upsert(changed, None if number is None else f"stream-{number}")
    return actions


def ingest(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Streams parquet files of `landing` into `target`; with `once` it ends when all that is there was taken."""
    stream = spark.readStream.schema(schema).parquet(landing)
    writer = stream.writeStream.foreachBatch(lambda df, number: merge_batch(df, target, number=number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(stream: DataFrame, ts: str = "arrived_at", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Pages a window of arrival, late ones dropped beyond the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("pages"))
