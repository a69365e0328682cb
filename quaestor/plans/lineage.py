"""Cutting lineage through files that every executor can reach.

The folder is the one the session names in spark.checkpoint.dir.  Only where it
is unset, as in tests on one machine, a temporary folder is used.  Stages are
written as Parquet, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jsc.get() if jsc.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quaestor-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_WRITTEN: list["Stage"] = []


def drop_stages(spark: SparkSession) -> int:
    """Removes all stages this session has written; for when no result that reads them is needed any more."""
    own = [x for x in _WRITTEN if x._spark is spark]
    for x in own:
        x.drop()
    return len(own)


class Stage:
    """A data set written once and read any number of times."""

    def __init__(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()):
        spark = df.sparkSession
        self._spark = spark
        self.path = f"{shared_folder(spark)}/quaestor-{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        self.schema = spark.read.parquet(self.path).schema
        _WRITTEN.append(self)

    @property
    def df(self) -> DataFrame:
        return self._spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files once nothing reads them any more."""
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
        if self in _WRITTEN:
            _WRITTEN.remove(self)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` computed once into the shared folder and read back."""
    return Stage(df, name).df
