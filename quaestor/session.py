"""Session factory and settings shared by every entry point."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.executorEnv.OMP_NUM_THREADS": "1",  # a task has one core; numpy must not take more
}


def build_session(master: str | None = None, app: str = "quaestor", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; anything in `conf` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cores), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ready(spark: SparkSession) -> str:
    """Health probe: "ok" if a trivial statement runs, else "degraded"."""
    try:
        return "ok" if spark.sql("SELECT 1 AS one").head()[0] == 1 else "degraded"
    except Exception:  # noqa: BLE001 - the probe reports, it does not raise
        return "degraded"
