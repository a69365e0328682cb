"""Joins and groupings that stay balanced when one key holds much of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and holds no more rows than this.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df holds at most `limit` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows, else df for a shuffled join."""
    return F.broadcast(df) if small(df, limit) else df


#: Rows of one key that may meet in one task.
HOT_ROWS = 200_000


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, salt_from: Column, salts: int = 8, counted: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join a side that may have hot keys with a side that has one row per key.

    counted: column of the right side with the number of left rows of its key.  Then only
    keys with more than `hot_rows` are salted, each over as many tasks as its rows need;
    at most one key in `hot_rows` left rows is hot, so their list is broadcast.  Without
    it the left rows of every key spread over `salts` tasks by `salt_from`, and the whole
    right side is repeated that many times.
    """
    if counted is None:
        a = left.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
        b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return a.join(b, [*on, "_salt"], how).drop("_salt")
    parts = F.ceil(F.col(counted) / hot_rows).cast("int")
    hot = right.where(F.col(counted) > hot_rows).select(*on, parts.alias("_salts"))
    a = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt_from), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(counted)
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for costly work on few files.

    Only a plain scan is looked at; where it has enough partitions, as any large table
    does, nothing is shuffled.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
