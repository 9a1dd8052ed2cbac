"""Where intermediate tables go: the folder of spark.checkpoint.dir, which all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

_OWNED: list[tuple[SparkSession, str]] = []
_SENT: list[Broadcast] = []


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and everything runs on this machine (tests)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current.isEmpty():
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gossamer-"))
        current = sc._jsc.sc().getCheckpointDir()
    return configured or current.get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It is removed when the process ends."""
    path = f"{shared_root(spark).rstrip('/')}/gossamer/{name}-{uuid.uuid4().hex}"
    _OWNED.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it again.

    Lineage ends there, so a lost executor costs a re-read and not the whole plan,
    and later branches prune columns of the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value: bytes) -> Broadcast:
    """A broadcast value; it is destroyed at the end of the scratch() it is sent in."""
    _SENT.append(spark.sparkContext.broadcast(value))
    return _SENT[-1]


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables that are cut and the values that are sent within it; what outlives it must be written elsewhere."""
    tables, values = len(_OWNED), len(_SENT)
    try:
        yield
    finally:
        for spark, path in _OWNED[tables:]:
            remove(spark, path)
        for value in _SENT[values:]:
            value.destroy()
        del _OWNED[tables:], _SENT[values:]


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads, whole tables, as the plan's statistics have them; nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if the files it reads are too small to be cut into as many splits; else as it is, unshuffled.

    What is shuffled is less than a split a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if file_bytes(df) < cores * df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df


def mark(spark: SparkSession, path: str) -> None:
    """An empty file at `path`, by which a step is known to be done."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True).close()


class Bucketed:
    """Tables of a job that are bucketed alike by their column node, so joins by it shuffle none of them."""

    def __init__(self, spark: SparkSession, size: int):
        """size: bytes of the largest of them, by which the number of buckets goes."""
        self.spark, self.names, self.paths = spark, [], []
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (128 << 20) + 1)

    def keep(self, df: DataFrame) -> DataFrame:
        name, path = f"kept_{uuid.uuid4().hex}", shared_path(self.spark, "kept")
        df.repartition(self.buckets, "node").write.format("parquet").bucketBy(self.buckets, "node").sortBy("node").option("path", path).saveAsTable(name)
        self.names.append(name)
        self.paths.append(path)
        return self.spark.table(name)

    def close(self) -> None:
        """Drops the tables and removes their files."""
        for name, path in zip(self.names, self.paths):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)


@atexit.register
def _cleanup() -> None:
    for spark, path in _OWNED:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return
