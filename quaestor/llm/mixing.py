"""Mixing sources to target weights by Pareto order sampling.

Let a source hold S tokens, have the share t and be usable c times.  The mixture's
size T is the largest for which t * T <= c * S in every source that has a share, so
the shares can all be met.  A document of n tokens is expected in min(c, a * n ** POWER)
copies, where a is such that the source's tokens come to t * T: longer documents are
favoured, by the square root of their length.  The whole part of that number is
allocated for certain, its fraction is the inclusion probability p of one more copy.
Documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u drawn from a hash of the
document and the seed, and taken in that order while their tokens fit what remains of
the source's share.  The factor a comes from a histogram of lengths, the cutoff rank
from two histograms of ranks, so no source is sorted or gathered.

Defined results: sources compare without case and outer spaces; documents with a
null source, or one without a target, belong to no share and are left out; a target
source that is listed twice has the sum of its shares and the larger cap; a null
text counts 0 tokens, as an empty one, and is expected as often as a text of one
token; equal texts under different ids are different documents; documents of equal
rank follow the id; a target source without documents gets nothing and does not hold
the others back; empty tables give an empty mixture.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.skew import small, spread
from quaestor.plans.lineage import cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BUCKETS = 2048
#: Expected copies grow with this power of the length.  0 gives all documents of a source the same probability.
POWER = 0.5
#: Targets are a list that somebody wrote; more than this is refused rather than collected.
MAX_TARGETS = 10_000


def encoder(vocabulary: str | None = None):
    """The public tokenizer; `vocabulary` is the path of its file, by default that of the installed package."""
    import base64

    import tiktoken

    public = importlib.import_module("public_tokenizers")
    with open(vocabulary or public.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Adds `n_tokens` of the whole text and drops the text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for batch in batches:
            yield pd.Series([len(enc.encode_ordinary(x)) if isinstance(x, str) and x else 0 for x in batch], dtype="int64")

    return spread(docs).withColumn("n_tokens", count(F.col(text))).drop(text)


def _source(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))


def _factors(sized: DataFrame, targets: DataFrame, weight: Column) -> DataFrame:
    """(source, need, cap, factor) of the sources that get a share, a row a target."""
    bucket = F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) * 16)  # some 600 a source at most
    sizes = sized.groupBy("source", bucket.alias("b")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * weight).alias("tw")).where("t > 0")
    sizes = cut(sizes.join(F.broadcast(targets), "source"), "lengths")
    total = sizes.groupBy("source").agg((F.first("cap") * F.sum("t") / F.first("share")).alias("most")).agg(F.min("most")).first()[0]
    need = F.col("share") * F.lit(float(total or 0))
    # The longest documents reach the cap; the rest shares what is left.  The first bucket that stays under the cap decides.
    longer = Window.partitionBy("source").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    at_cap = F.coalesce(F.sum("t").over(longer), F.lit(0))
    free = F.sum("tw").over(whole) - F.coalesce(F.sum("tw").over(longer), F.lit(0.0))
    rows = sizes.select("source", "cap", "b", need.alias("need"), (F.col("tw") / F.col("t")).alias("w"), ((need - F.col("cap") * at_cap) / free).alias("factor"), (need >= F.col("cap") * F.sum("t").over(whole) * (1 - 1e-9)).alias("all"))
    # the scarcest source gives all it has
    rows = rows.withColumn("factor", F.when(F.col("all"), F.lit(1e300)).otherwise(F.col("factor")))
    return rows.where(F.col("all") | (F.col("factor") * F.col("w") <= F.col("cap") * (1 + 1e-9))).groupBy("source").agg(F.first("need").alias("need"), F.first("cap").alias("cap"), F.max_by("factor", "b").alias("factor"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 42, vocabulary: str | None = None, power: float = POWER) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document that is taken at least once."""
    listed = targets.select(_source(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().where("target_share > 0 and max_repeats > 0")
    listed = cut(listed.groupBy("source").agg(F.sum("target_share").cast("double").alias("share"), F.max("max_repeats").cast("double").alias("cap")), "targets")
    if not small(listed, MAX_TARGETS):
        raise ValueError(f"more than {MAX_TARGETS} targets")
    # Everything that is broadcast here has a row a target.
    own = docs.select("doc_id", _source(F.col("source")).alias("source"), "text").join(F.broadcast(listed.select("source")), "source", "left_semi")
    sized = cut(token_counts(own, vocabulary=vocabulary), "sized")
    weight = F.pow(F.greatest("n_tokens", F.lit(1)).cast("double"), F.lit(power))
    plan = cut(_factors(sized, listed, weight), "factors")
    expected = F.least(F.col("cap"), F.col("factor") * weight)
    certain = F.floor(expected + 1e-9)
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    p = F.col("_p")
    odds = (u / (1 - u)) * ((1 - p) / p)
    ranked = sized.join(F.broadcast(plan), "source").select("doc_id", "source", "n_tokens", certain.cast("long").alias("_whole"), F.when(expected - certain > 1e-9, expected - certain).alias("_p"))
    ranked = ranked.withColumn("_q", F.when(p > 0, odds / (1 + odds))).drop("_p")
    # Where the cutoff falls: a histogram of the ranks, then one of the bucket it is in.
    room = ranked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("_whole")).alias("t")).join(plan, "source")
    edges = cut(room.select("source", F.lit(0.0).alias("low"), F.greatest(F.col("need") - F.col("t"), F.lit(0.0)).alias("room")), "edges")
    width = 1.0
    for _ in range(2):
        inside = ranked.join(F.broadcast(edges), "source").where((F.col("_q") >= F.col("low")) & (F.col("_q") < F.col("low") + width))
        hist = inside.groupBy("source", F.least(F.floor((F.col("_q") - F.col("low")) / width * BUCKETS), F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("n_tokens").alias("t"))
        before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most BUCKETS rows a source
        filled = hist.withColumn("c", F.sum("t").over(before)).join(F.broadcast(edges), "source")
        full = F.col("c") > F.col("room")
        at = filled.groupBy("source").agg(F.min(F.when(full, F.col("b"))).alias("b"), F.max(F.when(~full, F.col("c"))).alias("c"))
        # without a bucket that overflows all of them fit; the next histogram then begins behind them
        moved = edges.join(at, "source", "left").select("source", (F.col("low") + F.coalesce(F.col("b"), F.lit(BUCKETS)) * (width / BUCKETS)).alias("low"), (F.col("room") - F.coalesce(F.col("c"), F.lit(0))).alias("room"))
        edges = cut(moved, "edges")
        width /= BUCKETS
    near = ranked.join(F.broadcast(edges), "source")
    edge = near.where((F.col("_q") >= F.col("low")) & (F.col("_q") < F.col("low") + width))
    order = Window.partitionBy("source").orderBy("_q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = edge.withColumn("_t", F.sum("n_tokens").over(order)).where("_t <= room").select("doc_id", F.lit(1).alias("_one"))
    taken = near.join(fits, "doc_id", "left").withColumn("copies", (F.col("_whole") + F.when((F.col("_q") < F.col("low")) | F.col("_one").isNotNull(), 1).otherwise(0)).cast("int"))
    return taken.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its share asked and reached, documents, tokens and most copies used."""
    listed = targets.select(_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    listed = listed.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    all_rows = listed.join(got, "source", "left").fillna(0, ["documents", "tokens", "most_copies"])
    whole = Window.partitionBy(F.lit(1))  # one row per target
    return all_rows.withColumn("reached_share", F.round(F.col("tokens") / F.sum("tokens").over(whole), 6))
