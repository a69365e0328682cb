"""Readers of stored tables: scan, point look-up, existence check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = (
    "campuses", "persons", "publications", "authorships", "courses", "theses",
    "thesis_supervisors", "documents", "eval_items", "mix_targets",
)


class NotFound(LookupError):
    """No row has the key that was asked for."""


def table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Scan of one stored table; a given schema saves reading the footers first."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def point(df: DataFrame, key: str, value) -> DataFrame:
    """At most one row by primary key; the equality reaches the Parquet scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def exists(df: DataFrame, condition: Column) -> bool:
    """Whether any row meets the condition; stops at the first."""
    return not df.where(condition).limit(1).isEmpty()


def require(df: DataFrame, key: str, value) -> DataFrame:
    """`point`, raising NotFound when there is no such row."""
    if not exists(df, F.col(key) == F.lit(value)):
        raise NotFound(f"{key}={value!r}")
    return point(df, key, value)
