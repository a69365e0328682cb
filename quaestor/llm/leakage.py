"""Evaluation texts leaking into training text, with a positional inverted index.

The index holds every token of the corpus and is sharded by document: one row a shard
holds the documents' places on one number line, and for every term (a 64-bit hash of
the word) its sorted list of positions on that line.  Shards are bounded by tokens and
written once to the shared folder; any number of item sets can then be searched, each
reading it to count how often the items' terms occur and to match.  For each run of
`words` consecutive test terms the lists are shifted by the terms' offsets and
intersected, beginning with the rarest terms, until all of them agree; that is an
exact phrase match.  Proximity matches ask that at least `most` terms of the run lie
near their place.  Of the `words - most + 2` rarest terms at least two then do, whichever
are missing, so every pair of these is intersected with a tolerance, and the terms are
counted at each place where the run can begin.

Items are searched in blocks of bounded size, so any number of items can be searched
with the same memory, and the corpus is never tokenised again.  In a shard only runs of
which enough terms occur there are looked at.

Defined results: null and empty texts hold nothing; items shorter than `words` terms
cannot leak; ids keep their type; words are maximal runs of letters and digits without case; repeated
documents are reported each under its id, a repeated id once; empty tables give an
empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators.skew import spread
from quaestor.plans.lineage import Stage

WORD = re.compile(r"[^\W_]+")
WORDS = 10
SHARD_TOKENS = 1_000_000
#: Characters of items that are searched at once; beyond it the items are taken in several blocks.
BLOCK_CHARS = 2_000_000
_GAP = 64

def terms_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    """Words to the 64-bit hashes that stand for them."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 500_000:  # bounds memory
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words)).view(np.int64)


def build_index(docs: DataFrame, key: str, text: str, gap: int = _GAP) -> Stage:
    """The stored index of all tokens, a row a shard; `gap` places lie between two documents."""
    kind = docs.schema[key].dataType.simpleString()

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        ids: list = []
        starts: list[int] = []
        seen: list[np.ndarray] = []
        at = 0

        def shard() -> pd.DataFrame:
            place = np.concatenate([s + np.arange(len(x), dtype=np.int32) for s, x in zip(starts, seen)]).astype(np.int32)
            term = np.concatenate(seen)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])[: len(term)]
            return pd.DataFrame({"docs": [list(ids)], "starts": [np.array(starts, np.int32)], "terms": [term[first]], "counts": [np.diff(np.r_[first, len(term)]).astype(np.int32)], "places": [place]})

        for batch in batches:
            for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                found = known.of(WORD.findall(t.lower()))
                if not len(found):
                    continue
                ids.append(i)
                starts.append(at)
                seen.append(found)
                at += len(found) + gap
                if at >= SHARD_TOKENS:
                    yield shard()
                    ids, starts, seen, at = [], [], [], 0
        if ids:
            yield shard()

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.length("t") > 0))
    return Stage(spread(rows).mapInPandas(index, f"docs array<{kind}>, starts array<int>, terms array<long>, counts array<int>, places array<int>"), "postings")


class _Items:
    """Runs of consecutive terms of the items, with the order in which to intersect them.

    Terms are numbered by their place among the sorted hashes of the items' terms.
    """

    def __init__(self, items: list[tuple[object, np.ndarray]], hashes: np.ndarray, frequency: np.ndarray, words: int):
        self.words, self.hashes = words, hashes
        self.ids = pd.Series([i for i, _ in items]).to_numpy()
        item, start, runs = [], [], []
        for n, (_, terms) in enumerate(items):
            k = np.searchsorted(hashes, terms)
            for s in range(len(k) - words + 1):
                item.append(n)
                start.append(s)
                runs.append(k[s : s + words])
        self.item, self.start = np.array(item, np.int64), np.array(start, np.int64)
        self.runs = np.array(runs, np.int64).reshape(-1, words)
        self.order = np.argsort(frequency[self.runs], axis=1, kind="stable") if len(runs) else self.runs


def _found(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted `hashes` are among the sorted `terms`, and where."""
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    own = np.flatnonzero(terms[at] == hashes) if len(terms) else np.zeros(0, np.int64)
    return own, at[own]


def _search(shard: dict, items: _Items, slack: int, most: int):
    """(run, places, near) matches of one shard."""
    ends = np.cumsum(shard["counts"])
    own, at = _found(shard["terms"], items.hashes)
    lists = {n: shard["places"][ends[k] - shard["counts"][k] : ends[k]].astype(np.int64) for n, k in zip(own.tolist(), at.tolist())}
    present = np.zeros(len(items.hashes), bool)
    present[own] = True
    here = present[items.runs].sum(1)
    if slack:
        return _search_near(lists, items, np.flatnonzero(here >= most), slack, most)
    memo: dict[tuple, np.ndarray] = {}
    out = []
    for r in np.flatnonzero(here == items.words):
        run, order = items.runs[r], items.order[r]
        # Runs that share their rarest pair share that intersection, up to a shift.
        a, b = int(order[0]), int(order[1])
        key = (int(run[a]), int(run[b]), b - a)
        pair = memo.get(key)
        if pair is None:
            x, y = lists[key[0]], lists[key[1]]
            pair = memo[key] = x[_in(x + (b - a), y)]
        if not len(pair):
            continue
        at = pair - a  # where the run would begin
        for j in order[2:]:
            at = at[_in(at + int(j), lists[int(run[j])])]
            if not len(at):
                break
        if len(at):
            out.append((r, at, False))
    return out


def _search_near(lists: dict[int, np.ndarray], items: _Items, runs: np.ndarray, slack: int, most: int):
    """Places where at least `most` terms of a run lie within `slack` of where they belong."""
    none = np.zeros(0, np.int64)
    memo: dict[tuple, np.ndarray] = {}
    out = []
    rare = min(items.words, items.words - most + 2)
    around = np.arange(-slack, slack + 1)
    for r, run, order in zip(runs.tolist(), items.runs[runs].tolist(), items.order[runs].tolist()):
        here = [j for j in order[:rare] if run[j] in lists]
        if len(here) < min(most, 2):
            continue
        starts = []
        # one term alone can be all that is asked for
        for a, b in combinations(sorted(here), 2) if most > 1 else zip(here, here):
            key = (run[a], run[b], b - a)
            pair = memo.get(key)
            if pair is None:
                # both may be off by `slack`, to either side
                pair = memo[key] = _near(lists[run[a]], lists[run[b]], b - a, 2 * slack)
            if len(pair):
                starts.append(pair - a)
        if not starts:
            continue
        at = np.unique(np.add.outer(np.concatenate(starts), around))
        hits = np.zeros(len(at), np.int32)
        for n, j in enumerate(order):
            hits += _close(at + j, lists.get(run[j], none), slack)
            if n >= items.words - most:  # what is too far behind is left out
                keep = hits >= most - (items.words - 1 - n)
                if not keep.all():
                    at, hits = at[keep], hits[keep]
                    if not len(at):
                        break
        if len(at):
            exact = hits == items.words  # all of them near: the only places that can be exact
            if exact.any():
                for j in order:
                    exact[exact] = _in(at[exact] + j, lists.get(run[j], none))
            out += [(r, at[exact], False), (r, at[~exact], True)]
    return out


def _in(x: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    if not len(sorted_list):
        return np.zeros(len(x), bool)
    p = sorted_list.searchsorted(x)
    p[p == len(sorted_list)] = 0
    return sorted_list[p] == x


def _close(x: np.ndarray, sorted_list: np.ndarray, slack: int) -> np.ndarray:
    if not len(sorted_list):
        return np.zeros(len(x), bool)
    p = sorted_list.searchsorted(x - slack)
    inside = p < len(sorted_list)
    p[~inside] = 0
    return inside & (sorted_list[p] <= x + slack)


def _near(x: np.ndarray, y: np.ndarray, shift: int, slack: int) -> np.ndarray:
    return x[_close(x + shift, y, slack)] if len(x) and len(y) else x[:0]


def _blocks(items: Iterator[tuple[object, str]]) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for x in items:
        block.append(x)
        size += len(x[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS, slack: int = 0, most: int | None = None) -> DataFrame:
    """(doc, item_id, longest, coverage, kind): every document that holds `words` consecutive words of an item.

    longest: words of the longest such passage; coverage: the share of the item's words
    that lie in such passages.  With slack > 0 also passages (kind "near") of which at
    least `most` words of a run lie within `slack` places of where they belong.
    """
    stage = build_index(docs, key, text, max(_GAP, words + 2 * slack))
    return search_index(stage.df, items, item, item_text, words, slack, most)


def search_index(index: DataFrame, items: DataFrame, item: str = "item_id", item_text: str = "text", words: int = WORDS, slack: int = 0, most: int | None = None) -> DataFrame:
    """As `leaks`, over a stored index whose gap is at least words + 2 * slack."""
    spark = index.sparkSession
    key_type, item_type = index.schema["docs"].dataType.elementType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"doc {key_type}, item_id {item_type}, longest int, coverage double, kind string"
    stages: list[DataFrame] = []
    chosen = items.select(F.col(item), item_text).where(F.col(item).isNotNull() & (F.length(item_text) > 0)).distinct().orderBy(item, item_text)
    known = _Hashes()
    for block in _blocks(tuple(r) for r in chosen.toLocalIterator()):
        coded = [(i, known.of(t)) for i, t in ((i, terms_of(t)) for i, t in block) if len(t) >= words]
        if not coded:
            continue
        hashes = np.unique(np.concatenate([t for _, t in coded]))  # at most a block's words
        asked = spark.sparkContext.broadcast(hashes)

        def count(batches: Iterator[pd.DataFrame], asked=asked) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(asked.value), np.int64)
            for batch in batches:
                for terms, counts in zip(batch["terms"], batch["counts"]):
                    own, at = _found(np.asarray(terms), asked.value)
                    total[own] += np.asarray(counts)[at]
            own = np.flatnonzero(total)
            yield pd.DataFrame({"term": own, "n": total[own]})

        frequency = np.zeros(len(hashes), np.int64)
        for t, n in index.select("terms", "counts").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row a term of the block
            frequency[t] = n
        lookup = spark.sparkContext.broadcast(_Items(coded, hashes, frequency, words))
        lengths = {i: len(t) for i, t in coded}
        need = words if most is None else most

        def search(batches: Iterator[pd.DataFrame], lookup=lookup, lengths=lengths, need=need) -> Iterator[pd.DataFrame]:
            own = lookup.value
            for batch in batches:
                for row in batch.itertuples(index=False):
                    shard = {k: np.asarray(getattr(row, k)) for k in ("docs", "starts", "terms", "counts", "places")}
                    found = _search(shard, own, slack, need)
                    if not found:
                        continue
                    run = np.concatenate([np.full(len(at), r) for r, at, _ in found])
                    at = np.concatenate([at for _, at, _ in found])
                    near = np.concatenate([np.full(len(at), k) for _, at, k in found])
                    # A run can begin in the gap before its document, if its first words are missing or displaced; the
                    # last place it can reach is never in another document, as gaps are wider than a run with its slack.
                    doc = np.searchsorted(shard["starts"], at + own.words - 1 + slack, side="right") - 1
                    hits = pd.DataFrame({"doc": shard["docs"][doc], "item_id": own.ids[own.item[run]], "line": at - own.start[run], "start": own.start[run], "near": near})
                    yield _summary(hits, own.words, lengths)

        got = index.mapInPandas(search, schema)
        stages.append(got)
    if not stages:
        return spark.createDataFrame([], schema)
    out = stages[0]
    for x in stages[1:]:
        out = out.unionByName(x)
    # a repeated document id may lie in two shards
    return out.groupBy("doc", "item_id").agg(F.max("longest").alias("longest"), F.max("coverage").alias("coverage"), F.min("kind").alias("kind"))


def _summary(hits: pd.DataFrame, words: int, lengths: dict[int, int]) -> pd.DataFrame:
    d, i, n, s, far = (hits[c].to_numpy() for c in ("doc", "item_id", "line", "start", "near"))
    order = np.lexsort((s, n, i, d))
    d, i, n, s, far = d[order], i[order], n[order], s[order], far[order].astype(bool)
    # a repeated document or item id repeats its places
    once = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (n[1:] != n[:-1]) | (s[1:] != s[:-1])]
    far = np.logical_and.reduceat(far, np.flatnonzero(once))
    d, i, n, s = d[once], i[once], n[once], s[once]
    new = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (n[1:] != n[:-1]) | (s[1:] != s[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(s)] - 1
    near = np.logical_and.reduceat(far, first)
    a, b = s[first], s[last] + words
    order = np.lexsort((b, a, i[first], d[first]))
    runs: dict[tuple, list] = {}
    for doc, item, start, stop, far in zip(*(x[order].tolist() for x in (d[first], i[first], a, b, near))):
        g = runs.setdefault((doc, item), [0, 0, 0, True])  # longest, covered, end, near
        g[0] = max(g[0], stop - start)
        g[1] += max(0, stop - max(start, g[2]))
        g[2] = max(g[2], stop)
        g[3] &= far
    rows = [(doc, item, longest, round(covered / lengths[item], 4), "near" if far else "exact") for (doc, item), (longest, covered, _, far) in runs.items()]
    return pd.DataFrame(rows, columns=["doc", "item_id", "longest", "coverage", "kind"])
