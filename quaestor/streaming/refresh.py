"""Incremental refresh: new files are upserted once each, in order, then the query ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class SnapshotStore:
    """Versioned Parquet snapshots; a reader sees a whole version or the one before."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder, schema
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version that was written to its end, -1 if none."""
        if not self._fs.exists(self._path(self.folder)):
            return -1
        names = [s.getPath() for s in self._fs.listStatus(self._path(self.folder))]
        done = [int(p.getName()[1:]) for p in names if p.getName()[0] == "v" and self._fs.exists(self._path(f"{p.toString()}/_SUCCESS"))]
        return max(done, default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{v}")

    def commit(self, df: DataFrame, version: int) -> None:
        """Writes one version; writing it again after a restart gives the same result."""
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")


def refresh(spark: SparkSession, incoming: str, schema: StructType, store: SnapshotStore, upsert: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> None:
    """Applies all files that have arrived since the last call.

    Each micro-batch is committed under its batch number, so a batch that is repeated
    after a failure starts from the version before it and changes nothing twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        v = store.version()
        before = store.read() if v < number else (spark.read.schema(store.schema).parquet(f"{store.folder}/v{number - 1}") if number > 0 else spark.createDataFrame([], store.schema))
        store.commit(upsert(before, batch), number)

    stream = spark.readStream.schema(schema).parquet(incoming)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
