"""Tables that are upserted by appending: a base and deltas, switched by one small file."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Deltas that are read beside the base before they are merged into it.
DELTAS = 8


class VersionedTable:
    """A table at `path` with at most one row a key.

    base: the folder of the last compaction; deltas: folders of later upserts, the newest last. Which
    folders count stands in the manifest with the greatest number, which is created whole or
    not at all: a failure before leaves the table as it was, and of two writers of one number
    the second gets an error. An upsert writes its own rows only.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "abs_url"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def manifest(self) -> tuple[int, dict]:
        """The number and content of the manifest that counts; 0 and nothing for a new table."""
        names = self._fs.globStatus(self._path(f"{self.path}/_manifest-*"))
        numbers = [int(x.getPath().getName().partition("-")[2]) for x in names or []]
        if not numbers:
            return 0, {"base": None, "deltas": [], "batches": []}
        stream = self._fs.open(self._path(f"{self.path}/_manifest-{max(numbers):09d}"))
        try:
            return max(numbers), json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, content: dict) -> None:
        made = self._path(f"{self.path}/_made-{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        target = self._path(f"{self.path}/_manifest-{number:09d}")
        if self._fs.exists(target) or not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise RuntimeError(f"another writer has changed {self.path}")

    def exists(self) -> bool:
        return self.manifest()[0] > 0

    def read(self, schema: str | None = None) -> DataFrame | None:
        """The table as it stands: rows of the newest folder that has their key. None for a new table without a schema."""
        _, m = self.manifest()
        folders = [*([m["base"]] if m["base"] else []), *m["deltas"]]
        if not folders:
            return self.spark.createDataFrame([], schema) if schema else None
        parts = [self.spark.read.parquet(f"{self.path}/{x}") for x in reversed(folders)]
        whole, keys = parts[0], parts[0].select(self.key)
        for x in parts[1:]:
            whole = whole.unionByName(x.join(keys, self.key, "left_anti"), allowMissingColumns=True)
            keys = keys.unionByName(x.select(self.key))
        return whole

    def upsert(self, rows: DataFrame, batch: str | None = None) -> None:
        """Adds `rows`, a row a key, in place of those with the same key. A batch that was taken in before changes nothing."""
        number, m = self.manifest()
        if batch is not None and batch in m["batches"]:
            return
        folder = f"delta-{number + 1:09d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._commit(number + 1, {"base": m["base"], "deltas": [*m["deltas"], folder], "batches": [*m["batches"], *([batch] if batch is not None else [])][-100:]})
        if len(m["deltas"]) >= DELTAS:
            self.compact()

    def compact(self) -> None:
        """Merges the deltas into a new base; folders that no manifest names any more are left for vacuum()."""
        number, m = self.manifest()
        folder = f"base-{number + 1:09d}-{uuid.uuid4().hex[:8]}"
        self.read().write.parquet(f"{self.path}/{folder}")
        self._commit(number + 1, {"base": folder, "deltas": [], "batches": m["batches"]})

    def vacuum(self) -> None:
        """Deletes the folders and manifests that no longer count."""
        number, m = self.manifest()
        kept = {m["base"], *m["deltas"], f"_manifest-{number:09d}"}
        for x in self._fs.listStatus(self._path(self.path)):
            if x.getPath().getName() not in kept:
                self._fs.delete(x.getPath(), True)


def base_and_deltas(base: DataFrame, deltas: list[DataFrame], key: str) -> DataFrame:
    """Rows of `base` and `deltas`, oldest first, the newest of each key."""
    return reduce(lambda old, new: old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True), deltas, base)
