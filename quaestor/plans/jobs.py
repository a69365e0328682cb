"""Job log as append-only events; the state of a job is its latest event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions.lexicon import JOB_STATES

EVENTS = T.StructType([
    T.StructField("job_id", T.StringType(), False), T.StructField("at", T.TimestampType(), False), T.StructField("status", T.StringType(), False),
    T.StructField("limit_count", T.IntegerType()), T.StructField("campus_id", T.StringType()), T.StructField("processed", T.IntegerType()),
    T.StructField("total", T.IntegerType()), T.StructField("error", T.StringType()),
])
FINAL = ("done", "failed", "cancelled")


def event(spark: SparkSession, job_id: str, at, status: str, **fields) -> DataFrame:
    """One event row; append it to the log."""
    if status not in JOB_STATES:
        raise ValueError(f"unknown state {status!r}")
    row = {"job_id": job_id, "at": at, "status": status} | fields
    return spark.createDataFrame([tuple(row.get(f.name) for f in EVENTS)], EVENTS)


def latest(events: DataFrame, job: str = "job_id", at: str = "at", tie: str | None = None) -> DataFrame:
    """One row a job: start, end, and each field as last set."""
    order = F.struct(F.col(at), *([F.col(tie)] if tie else []))
    keep = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    rest = [c for c in events.columns if c not in (job, at, tie)]
    out = events.groupBy(job).agg(*[keep(c) for c in rest], F.min(at).alias("started_at"), F.max(at).alias("_last"))
    if "status" in rest:
        out = out.withColumn("finished_at", F.when(F.col("status").isin(*FINAL), F.col("_last")))
    return out.drop("_last")


def progress(processed: Column, total: Column) -> Column:
    """Percent done to one digit, half to even; null without a total."""
    return F.when(total > 0, F.bround(processed * 100.0 / total, 1))


def recent(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.col("started_at").desc(), F.col("job_id")).limit(n)


def may_cancel(status: Column) -> Column:
    return status.isin("queued", "running")


def after_cancel(status: Column) -> Column:
    """The state a request to cancel leads to; a job that has ended keeps its state."""
    return F.when(may_cancel(status), F.lit("cancelling")).otherwise(status)


def start(spark: SparkSession, job_id: str, at, **fields) -> DataFrame:
    """The first event of a job."""
    return event(spark, job_id, at, "queued", **fields)


def cancel(events: DataFrame, job_id: str, at) -> DataFrame:
    """The event that asks a job to stop, none if it is already asked; fails for an unknown job and for one that has ended."""
    row = latest(events.where(F.col("job_id") == job_id)).head()
    if row is None:
        raise LookupError(f"no job {job_id}")
    if row.status in FINAL:
        raise ValueError(f"job {job_id} has ended: {row.status}")
    asked = event(events.sparkSession, job_id, at, "cancelling")
    return asked if row.status in ("queued", "running") else asked.limit(0)
