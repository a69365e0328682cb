"""An approximate index for single vector searches: lists of neighbouring vectors, stored as partitions.

Centroids are fitted on at most SAMPLE vectors; every usable vector is stored, in the
partition of its nearest centroid.  A search reads only the partitions nearest to the
query, so what it costs follows `probes` and not the table.  probes=None reads them all
and is exact.

Defined results: rows with an unusable vector are not stored; equal scores order by
key; a table without usable vectors gives an index whose searches are empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quaestor.functions.lexicon import DIMENSIONS
from quaestor.functions.vector import usable, vector_top_k

#: Vectors the centroids are fitted on at most; rows a list should hold; lists at most; share of the lists a search reads.
SAMPLE, LIST, MAX_LISTS, SHARE = 16_000, 512, 4096, 0.15


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fitted(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids by k-means on the sphere; an empty list keeps its place."""
    c = x[np.random.default_rng(1).choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        for j in np.unique(home):
            c[j] = x[home == j].mean(0)
        c = _unit(c)
    return c


def build_index(df: DataFrame, key: str, vector: str, path: str, dim: int = DIMENSIONS) -> int:
    """Writes the index of df (all columns are kept) under `path`; the number of lists."""
    rows = df.where(usable(F.col(vector), dim))
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40))).select(key, vector).limit(2 * SAMPLE)  # chosen by hash: about SAMPLE rows
    got = picked.toPandas().sort_values(key)
    x = _unit(np.array(got[vector].tolist(), np.float32).reshape(-1, dim))
    lists = int(np.clip(n // LIST, 1, min(MAX_LISTS, max(1, len(x) // 8))))
    centres = fitted(x, lists) if len(x) else np.zeros((1, dim), np.float32)
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series((np.array(s.tolist(), np.float32).reshape(-1, dim) @ shared.value.T).argmax(1).astype(np.int32))

    rows.withColumn("_list", home(F.col(vector))).repartition("_list").write.partitionBy("_list").parquet(f"{path}/rows")
    about = [("centre", json.dumps(c.tolist())) for c in centres] + [("schema", rows.schema.json())]
    df.sparkSession.createDataFrame(about, "kind string, value string").coalesce(1).write.parquet(f"{path}/about")
    return lists


def search_index(spark: SparkSession, path: str, key: str, vector: str, query: Sequence[float], k: int, probes: int | None = -1) -> DataFrame:
    """The k rows nearest to the query among the lists read, as `vector_top_k`; probes=-1 reads SHARE of the lists, but eight at least."""
    about = spark.read.schema("kind string, value string").parquet(f"{path}/about").collect()  # a row a list
    centres = np.array([json.loads(r.value) for r in about if r.kind == "centre"], np.float32)
    schema = StructType.fromJson(json.loads(next(r.value for r in about if r.kind == "schema"))).add("_list", IntegerType())
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if probes is not None:
        n = max(8, int(SHARE * len(centres))) if probes < 0 else probes
        rows = rows.where(F.col("_list").isin(np.argsort(-(centres @ np.asarray(query, np.float32)), kind="stable")[:n].tolist()))
    return vector_top_k(rows.drop("_list"), key, vector, query, k)
