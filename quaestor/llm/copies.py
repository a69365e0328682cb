"""Duplicates hidden by formatting differences, by progressive partition refinement.

Rows are split into classes by keys of rising cost: first the stripped lengths of
the fields, then the letter histogram of the whole record, then the exact normal
form.  A costlier key is computed only for rows whose class still has several
members.  Classes are counted with map-side combination and rows meet their class
in salted joins, so one class may hold any share of the rows.

Defined results: null equals only null in every compared field; letter case, white
space, punctuation and, in fields that are lists, the order of entries do not count;
an empty list entry does not count; exactly equal rows are copies of each other as
long as their ids differ, a repeated id is one row; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.operators.skew import salted_join
from quaestor.plans.lineage import cut

SEPARATORS = r"[;|\r\n]"


def squeezed(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def listed(c: Column) -> Column:
    """Normal form of a field that is an unordered list: its squeezed entries, sorted."""
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(c, SEPARATORS), squeezed), lambda x: x != "")), "\u0001")


def _several(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows whose class under `keys` has more than one member."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return salted_join(df, many, keys, "left_semi", F.col(row), counted="_n")


def hidden_copies(df: DataFrame, key: str, fields: list[str], lists: list[str] = (), plain: list[str] = ()) -> DataFrame:
    """(kept_id, copy_id): for each class of copies its smallest key and each other one.

    plain: columns that must agree as they are; fields: those compared by letters and
    digits; lists: those compared as unordered lists of such entries.
    """
    rows = df.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(plain)], *[F.col(c).alias(f"_f{i}") for i, c in enumerate(fields)], *[F.col(c).alias(f"_l{i}") for i, c in enumerate(lists)]).where(F.col(key).isNotNull())
    p, f, s = [f"_p{i}" for i in range(len(plain))], [f"_f{i}" for i in range(len(fields))], [f"_l{i}" for i in range(len(lists))]
    width = F.xxhash64(*[F.coalesce(F.length(squeezed(F.col(c))), F.lit(-1)) for c in f], *[F.coalesce(F.length(squeezed(F.col(c))), F.lit(-1)) for c in s], *[F.col(c) for c in p])
    rows = cut(_several(rows.withColumn("_k0", width), ["_k0"], "_id"), "copies0")
    text = F.concat_ws("", *[F.coalesce(squeezed(F.col(c)), F.lit("")) for c in f + s])
    letters = F.xxhash64(F.array_join(F.array_sort(F.split(text, "")), ""))
    rows = _several(rows.withColumn("_k1", letters), ["_k0", "_k1"], "_id")
    exact = F.to_json(F.struct(*p, *[squeezed(F.col(c)).alias(c) for c in f], *[listed(F.col(c)).alias(c) for c in s]))
    rows = cut(rows.select("_id", exact.alias("_k2")).distinct(), "copies1")
    kept = rows.groupBy("_k2").agg(F.min("_id").alias("kept_id"), F.count("*").alias("_n")).where("_n > 1")
    return salted_join(rows, kept, ["_k2"], "inner", F.col("_id"), counted="_n").where("_id <> kept_id").select("kept_id", F.col("_id").alias("copy_id"))


def collapse(df: DataFrame, key: str, fields: list[str], lists: list[str] = (), plain: list[str] = ()) -> DataFrame:
    """One row per class: the row of the smallest key, with `n_copies` (itself included), which replaces a column of that name.

    Of rows with one key the first counts, in the order of a hash of all their columns.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c != "n_copies"])
    one = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), row.alias("_row")).groupBy("_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    one = cut(one.select("_row.*"), "rows")
    pairs = cut(hidden_copies(one, key, fields, lists, plain), "collapse")
    n = pairs.groupBy("kept_id").agg((F.count("*") + 1).alias("n_copies"))
    kept = one.join(pairs.select(F.col("copy_id").alias(key)), key, "left_anti")
    return kept.join(n.withColumnRenamed("kept_id", key), key, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1)))
