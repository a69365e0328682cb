"""Top N items within every group, by simultaneous bisection of all groups.

Every item gets one integer code that orders items as (score descending,
identifier ascending).  Each round counts, for all unresolved groups at once, the
rows below a set of midpoints of the group's interval and moves the interval to the
part that holds the N-th row.  A group is resolved when the rows up to its cutoff
are exactly N.  Counting combines map-side and rows meet their cutoff in a salted
join, so one group may hold any share of the rows; no group is sorted or collected.

Defined results: rows with a null group, identifier or score are left out; an item
that repeats in a group counts once; equal scores order by identifier ascending; a
group with fewer than N items keeps them all; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators.skew import salted_join
from quaestor.plans.lineage import Stage, cut

PARTS = 64


def coded(items: DataFrame, item: str, score: str) -> DataFrame:
    """(item, _code): codes rise with (score descending, item ascending).

    The items are sorted once over range partitions; the code is partition number
    and row number in it, so no task or driver sees all of them.
    """
    one = items.where(F.col(item).isNotNull() & F.col(score).isNotNull()).groupBy(item).agg(F.max(score).alias(score))
    return cut(one.orderBy(F.col(score).desc(), F.col(item)).select(item, F.monotonically_increasing_id().alias("_code")), "codes")


def cutoffs(rows: DataFrame, group: str, n: int) -> DataFrame:
    """(group, _cut) of the groups with more than n rows (group, _code); codes are distinct within a group."""
    out: list[DataFrame] = []
    state = rows.groupBy(group).agg(F.count("*").alias("_n"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi"))
    state = cut(state.where(F.col("_n") > n).select(group, F.lit(n).cast("long").alias("_need"), "_lo", "_hi", F.col("_n").alias("_rows")), "state")
    while not state.isEmpty():
        width = F.expr(f"(_hi - _lo) div {PARTS} + 1")
        # Only rows inside an open interval are read again in the next round.
        inside = cut(salted_join(rows.select(group, "_code"), state, [group], "inner", F.col("_code"), counted="_rows").where("_code between _lo and _hi"), "inside")
        rows = inside
        counts = inside.groupBy(group, ((F.col("_code") - F.col("_lo")) / width).cast("int").alias("_part")).agg(
            F.count("*").alias("_n"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi"), F.first("_need").alias("_need"))
        # at most PARTS rows a group
        parts = counts.groupBy(group, "_need").agg(F.sum("_n").alias("_rows"), F.array_sort(F.collect_list(F.struct("_part", "_n", "_lo", "_hi"))).alias("_p"))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
        step = lambda a, x: F.when(a["before"] + F.coalesce(a["n"], F.lit(0)) >= F.col("_need"), a).otherwise(F.struct((a["before"] + F.coalesce(a["n"], F.lit(0))).alias("before"), x["_n"].alias("n"), x["_lo"].alias("lo"), x["_hi"].alias("hi")))
        moved = parts.select(group, "_need", F.aggregate("_p", start, step).alias("_s")).select(
            group, F.col("_s.n").alias("_rows"), (F.col("_need") - F.col("_s.before")).alias("_need"), F.col("_s.n").alias("_n"), F.col("_s.lo").alias("_lo"), F.col("_s.hi").alias("_hi"))
        moved = cut(moved, "bisect")
        out.append(moved.where("_need = _n or _lo = _hi").select(group, F.col("_hi").alias("_cut")))
        state = moved.where("not (_need = _n or _lo = _hi)").select(group, "_need", "_lo", "_hi", "_rows")
    if not out:
        return state.select(group, F.col("_hi").alias("_cut"))
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done


def top_n(links: DataFrame, items: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The n best items of every group: (group, item).  links has (group, item), items has (item, score)."""
    codes = coded(items, item, score)
    pairs = links.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct()
    # an item can be in very many groups
    held = pairs.groupBy(item).agg(F.count("*").alias("_n"))
    rows = Stage(salted_join(pairs, codes.join(held, item), [item], "inner", F.col(group), counted="_n"), "coded").df
    ends = cutoffs(rows.select(group, "_code"), group, n)
    return salted_join(rows, ends, [group], "left", F.col("_code")).where("_cut is null or _code <= _cut").select(group, item)
