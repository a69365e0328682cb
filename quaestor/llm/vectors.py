"""Most similar vectors for every vector, with randomly rotated one-bit codes.

Vectors are assigned to lists by spherical k-means that is fitted on a bounded
sample; every vector is indexed in its nearest list.  Its k-th best cosine within that
list is a floor for what it still looks for.  It asks the `probes` nearest lists, more
of them in tables that are large beside the sample (`probes_for`), and every other list
whose bound reaches the floor, however many those are: a vector in a dense topic asks
all lists of that topic.  The bound is exact along the centroid and allows SPREADS
standard deviations for what two residuals may share, as measured on the sample; close
pairs that straddle two lists share more, hence the nearest lists.

Within a list, residuals to the centroid are rotated by a random orthogonal matrix
and kept as one bit a dimension plus two correction scalars.  Inner products are
estimated from the packed bits against a query of four bits a dimension; pairs whose
upper error bound reaches the k-th best lower bound are reranked with the vectors.

Neighbouring lists form groups, so that a vector travels once to a group and not once
to a list.  A group of more than BLOCK rows is cut into blocks by the hash of the id
and its queries visit each block; queries stream past the block, so no task holds more
than a block of rows and an Arrow batch or two of queries.  The number of lists grows
as the square root of a large table, so lists grow too: a list of more than DIVIDE rows
is divided by a second k-means inside its task, and its parts are asked by the same bound.

Defined results: null, empty, wrongly sized, all-zero vectors and those with NaN or
infinite elements are left out; an id that repeats counts once; equal similarity
orders by id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.skew import spread
from quaestor.plans.lineage import Stage

SAMPLE, LIST, MAX_LISTS, BLOCK, QUERIES = 24_000, 256, 2048, 32_768, 512
#: Lists that every vector asks at least; standard deviations of the bound by which it asks more.
PROBES, SPREADS = 3, 3.0
#: Up to so many vectors for each of the sample its lists follow what is alike; beyond, a vector asks more lists.
SERVED = 2.5
BOUND, QUERY_BITS, GROUP = 2.0, 4, 16
#: A list with more rows than this is divided again where it is searched, and each query asks at least this many parts.
DIVIDE, PARTS_ASKED, PART_SAMPLE = 8192, 6, 8192
#: Rows of a list among which the k-th best is looked for before the search.
FLOOR_ROWS = 2048


@functools.cache
def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _usable(batch: pa.RecordBatch, dim: int) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of the usable rows of (id, vector)."""
    ids, col = batch.column(0), batch.column(1)
    size = np.asarray(col.value_lengths().fill_null(-1))
    keep = np.flatnonzero((size == dim) & np.asarray(ids.is_valid()))
    if not len(keep):
        return [], np.zeros((0, dim), np.float32)
    x = np.asarray(col.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    return ids.take(pa.array(keep[ok])).to_pylist(), (x[ok] / norm[ok, None]).astype(np.float32)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())


def _unpacked(col: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; an emptied centroid restarts at the worst-served vector."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best, near = np.zeros(len(x), np.int32), np.zeros(len(x), np.float32)
        for a in range(0, len(x), 4096):
            s = x[a : a + 4096] @ c.T
            best[a : a + 4096], near[a : a + 4096] = s.argmax(1), s.max(1)
        order = np.argsort(best, kind="stable")
        first = np.searchsorted(best[order], np.arange(k))
        count = np.bincount(best, minlength=k)
        total = np.zeros_like(c)
        full = count > 0
        total[full] = np.add.reduceat(x[order], first[full], axis=0)
        if not full.all():
            total[~full] = x[np.argsort(near)[: int((~full).sum())]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Rotated unit residuals of x, and their lengths."""
    d = x - centre
    n = np.linalg.norm(d, axis=1)
    return (d / np.maximum(n, 1e-12)[:, None]) @ turn, n


def _encoded(base: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, ...]:
    """One bit a dimension, how many are set, the two scalars of each code, and the product with the centre."""
    dim = base.shape[1]
    b, length = _codes(base, centre, rotation(dim))
    bits = b > 0
    fit = np.abs(b).sum(1) / np.sqrt(dim)  # inner product of the code with what it stands for
    return bits.astype(np.float32), bits.sum(1, dtype=np.float32), length, np.maximum(fit, 1e-6), base @ centre


def _estimate(code: tuple[np.ndarray, ...], query: np.ndarray, centre: np.ndarray):
    """Estimated inner products [queries, base] of unit vectors, and the error bound of each."""
    bits, set_, bn, fit, along_centre = code
    dim = query.shape[1]
    q, qn = _codes(query, centre, rotation(dim))
    # the query as QUERY_BITS-bit integers with randomised rounding
    low, high = q.min(1, keepdims=True), q.max(1, keepdims=True)
    step = np.maximum((high - low) / (2**QUERY_BITS - 1), 1e-12)
    level = np.floor((q - low) / step + np.random.default_rng(3).random(q.shape, np.float32)).clip(0, 2**QUERY_BITS - 1)
    # level over the set bits; sums of small integers are exact in single precision, and a product is quicker than counting bits here
    ones = level @ bits.T
    # sum over dimensions of level * sign = 2 * (level over set bits) - all of level
    along = (step * (2 * ones - level.sum(1)[:, None]) + low * (2 * set_[None, :] - dim)) / np.float32(np.sqrt(dim))
    cosine = along / fit[None, :]
    error = BOUND * np.sqrt((1 - fit**2).clip(0) / (dim - 1)) / fit
    scale = qn[:, None] * bn[None, :]
    shift = (query @ centre)[:, None] + along_centre[None, :] - float(centre @ centre)
    return scale * cosine + shift, scale * error[None, :]


def spread_of(x: np.ndarray, centres: np.ndarray) -> float:
    """Standard deviation of the cosine between the residuals of two vectors."""
    home = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
    d = x - np.einsum("ij,ij->i", x, centres[home])[:, None] * centres[home]
    d = d[np.linalg.norm(d, axis=1) > 1e-3]
    if not len(d):
        return 1.0
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return float(np.linalg.norm(d.T @ d / len(d)))


def reach(x: np.ndarray, floor: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray, spread: float, least_asked: int) -> np.ndarray:
    """[queries, lists]: whether a list is among the nearest or may hold a vector with a cosine of `floor`.

    low, high: the cosines to their centroid that the members of a list have.
    """
    along = x @ centres.T
    across = SPREADS * spread * np.sqrt((1 - along**2).clip(0))
    at = (along / np.maximum(np.hypot(along, across), 1e-12)).clip(low, high)  # where along * at + across * sqrt(1 - at^2) is largest
    asks = along * at + across * np.sqrt((1 - at**2).clip(0)) >= floor[:, None]
    n = min(least_asked, along.shape[1])
    np.put_along_axis(asks, np.argpartition(-along, n - 1, axis=1)[:, :n], True, axis=1)
    return asks


def lists_for(n: int) -> int:
    """Lists of n vectors: in proportion up to 256, then as the square root, as the sample does not show more."""
    return int(np.clip(n // LIST, 1, min(MAX_LISTS, max(256, int(n**0.5 / 3)))))


def probes_for(n: int, probes: int = PROBES) -> int:
    """Lists that a vector asks at least: more the thinner the sample is, as alike vectors then fall to more lists."""
    return max(probes, round(probes * (n / (SERVED * SAMPLE)) ** 0.25))


def groups_of(centres: np.ndarray, most: int = GROUP) -> list[np.ndarray]:
    """Neighbouring lists by at most `most`, halved along their longest axis."""
    done, open_ = [], [np.arange(len(centres))]
    while open_:
        g = open_.pop()
        if len(g) <= most:
            done.append(g)
            continue
        c = centres[g] - centres[g].mean(0)
        order = np.argsort(c @ np.linalg.eigh(c.T @ c)[1][:, -1], kind="stable")
        open_ += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
    return done


class _List:
    """The rows of a list in a block, divided into parts if they are many."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray):
        self.parts, self.centres = [(ids, x)], centre[None]
        if len(x) <= DIVIDE:
            return
        step = max(1, len(x) // PART_SAMPLE)
        self.centres = kmeans(x[::step], max(2, min(len(x) // LIST, len(x[::step]) // 4)), rounds=5)
        home = np.concatenate([(x[a : a + 4096] @ self.centres.T).argmax(1) for a in range(0, len(x), 4096)])
        self.parts = [(ids[home == j], x[home == j]) for j in range(len(self.centres))]
        full = [j for j, (i, _) in enumerate(self.parts) if len(i)]
        self.parts, self.centres = [self.parts[j] for j in full], self.centres[full]
        near = [p @ c for (_, p), c in zip(self.parts, self.centres)]
        self.low, self.high = np.array([n.min() for n in near]), np.array([n.max() for n in near])
        self.spread = spread_of(x[::step], self.centres)

    def search(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> Iterator[list]:
        if len(self.parts) == 1:
            yield _best(*self.parts[0], ids, x, self.centres[0], k, floor)
            return
        for a in range(0, len(x), 4096):
            i, q, f = ids[a : a + 4096], x[a : a + 4096], floor[a : a + 4096]
            asks = reach(q, f, self.centres, self.low, self.high, self.spread, PARTS_ASKED)
            for j, part in enumerate(self.parts):
                if (who := asks[:, j]).any():
                    yield _best(*part, i[who], q[who], self.centres[j], k, f[who])


def _best(base_ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, query: np.ndarray, centre: np.ndarray, k: int, floor: np.ndarray):
    """The k best of each query among the base that reach its floor."""
    order = np.argsort(base_ids, kind="stable")
    base_ids, base = base_ids[order], base[order]
    place_of = {i: j for j, i in enumerate(base_ids)}
    code = _encoded(base, centre)
    out: list[tuple] = []
    for a in range(0, len(query), QUERIES):
        qi, q, f = query_ids[a : a + QUERIES], query[a : a + QUERIES], floor[a : a + QUERIES]
        guess, error = _estimate(code, q, centre)
        same = np.array([place_of.get(i, -1) for i in qi])
        own = np.flatnonzero(same >= 0)
        guess[own, same[own]] = -9.0
        lower = guess - error
        edge = -np.partition(-lower, k, axis=1)[:, k - 1] if lower.shape[1] > k else np.full(len(q), -9.0)
        i, j = np.nonzero((guess + error >= np.maximum(edge, f)[:, None]) & (guess > -8.0))
        if len(i) > 0.02 * guess.size:
            exact = (q @ base.T)[i, j]
        else:
            exact = np.empty(len(i), np.float32)
            for s in range(0, len(i), 20_000):  # rerank in slices: a bound on memory, not on candidates
                exact[s : s + 20_000] = np.einsum("ij,ij->i", q[i[s : s + 20_000]], base[j[s : s + 20_000]])
        ok = exact >= f[i]
        i, j, exact = i[ok], j[ok], exact[ok]
        order = np.lexsort((j, -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        out.append((qi[i[top]], base_ids[j[top]], exact[top]))
    return [np.concatenate(x) if out else np.array([]) for x in zip(*out)] if out else [np.array([], object)] * 2 + [np.array([], np.float32)]


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, least: float = -1.0, dim: int = 384, probes: int = PROBES) -> DataFrame:
    """(id, neighbour, cosine): for every usable vector its k most similar with cosine >= `least`; ids as strings."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v"))
    n = rows.where(F.size("v") == dim).count()
    share = min(1.0, SAMPLE / max(n, 1))  # about SAMPLE rows, chosen by the hash of their id
    picked = rows.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _usable(batch, dim)
            yield pa.RecordBatch.from_pydict({"x": _packed(x)})

    got = [r[0] for r in picked.mapInArrow(shrink, "x binary").collect()][: 2 * SAMPLE]  # rows of 2 * dim bytes
    empty = spark.createDataFrame([], "id string, neighbour string, cosine float")
    if not got:
        return empty
    sample = np.frombuffer(b"".join(got), np.float16).reshape(-1, dim).astype(np.float32)
    lists = min(lists_for(n), max(1, len(sample) // 8))
    asked_least = probes_for(n, probes)
    fitted = kmeans(sample, lists)
    centres = spark.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _usable(batch, dim)
            if len(x):
                home = (x @ centres.value.T).argmax(1)
                yield pa.RecordBatch.from_pydict({"list": pa.array(home, pa.int32()), "id": pa.array(ids, pa.string()), "x": _packed(x)})

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With the cosine to the centroid and the k-th best of the list, as far as the list lies in the batch."""
        for batch in batches:
            home, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _unpacked(batch.column(2), dim)
            floor = np.full(len(x), least, np.float32)
            for own in np.split(np.arange(len(x)), np.flatnonzero(np.diff(home)) + 1):
                own = own[np.unique(ids[own], return_index=True)[1]]  # repeats keep the lowest floor
                for a in range(0, len(own), FLOOR_ROWS):
                    some = own[a : a + FLOOR_ROWS]
                    if len(some) > k:
                        s = x[some] @ x[some].T
                        np.fill_diagonal(s, -9.0)
                        # a little lower, for the rounding of products
                        floor[some] = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - 1e-4)
            near = np.einsum("ij,ij->i", x, centres.value[home])
            yield pa.RecordBatch.from_pydict({"list": batch.column(0), "id": batch.column(1), "x": batch.column(2), "near": pa.array(near, pa.float32()), "floor": pa.array(floor, pa.float32())})

    placed = spread(rows.where(F.size("v") == dim)).mapInArrow(assign, "list int, id string, x binary")
    # tasks follow the size of what is shuffled: about 4 MB each
    tasks = int(np.clip(n * dim * 2 / 4e6, 8, max(8, lists)))
    stage = Stage(placed.repartition(tasks, "list").sortWithinPartitions("list").mapInArrow(bounded, "list int, id string, x binary, near float, floor float"), "lists")
    held = {r[0]: r for r in stage.df.groupBy("list").agg(F.count("*"), F.min("near"), F.max("near")).collect()}  # a row a list
    low, high = (np.array([held[j][c] if j in held else 1.0 for j in range(lists)], np.float32) for c in (2, 3))
    groups = [g for g in ([j for j in g if j in held] for g in groups_of(fitted, int(np.clip(BLOCK * lists // n, 1, GROUP)))) if g]
    # Large groups: rows go to one block by their id, queries to each block of the group.
    blocks = [-(-sum(held[j][1] for j in g) // BLOCK) for g in groups]
    first = np.concatenate([[0], np.cumsum(blocks)])
    shared = spark.sparkContext.broadcast((groups, blocks, first, low, high, spread_of(sample, fitted)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, blocks, first, low, high, apart = shared.value
        for batch in batches:
            home, x = batch.column(0).to_numpy(), _unpacked(batch.column(2), dim)
            asks = reach(x, batch.column(4).to_numpy(), centres.value, low, high, apart, asked_least)
            asks[np.arange(len(x)), home] = True
            code = np.array([zlib.crc32(i.encode()) for i in batch.column(1).to_pylist()])
            for g, own in enumerate(groups):
                who = np.flatnonzero(asks[:, own].any(1))
                if not len(who):
                    continue
                mask = (asks[np.ix_(who, own)] << np.arange(len(own))).sum(1)
                some = batch.take(pa.array(who))
                for b in range(blocks[g]):
                    base = np.isin(home[who], own) & (code[who] % blocks[g] == b)
                    yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(who), first[g] + b), pa.int32()), "base": pa.array(base), "mask": pa.array(mask, pa.int32()), "list": some.column(0), "id": some.column(1), "x": some.column(2), "floor": some.column(4)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, _, first = shared.value[:3]
        now, lists_, waiting = -1, {}, []

        def answer() -> Iterator[pa.RecordBatch]:
            """The rows that wait; the first time in a part its base is among them."""
            rows = pa.Table.from_batches(waiting)
            waiting.clear()
            base, mask, home, floor = (rows.column(c).to_numpy() for c in ("base", "mask", "list", "floor"))
            ids, x = rows.column("id").to_numpy(), _unpacked(rows.column("x").combine_chunks(), dim)
            own = groups[int(np.searchsorted(first, now, side="right")) - 1]
            if not lists_:
                for j in own:
                    at = np.flatnonzero(base & (home == j))
                    at = at[np.sort(np.unique(ids[at], return_index=True)[1])]
                    lists_[j] = _List(ids[at], x[at], centres.value[j]) if len(at) else None
            for n_, j in enumerate(own):
                who = (mask >> n_ & 1).astype(bool)
                if lists_[j] is not None and who.any():
                    for a, b, c in lists_[j].search(ids[who], x[who], floor[who], k):
                        yield pa.RecordBatch.from_pydict({"id": pa.array(a, pa.string()), "neighbour": pa.array(b, pa.string()), "cosine": pa.array(c, pa.float32())})

        for batch in batches:
            part, base = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if part[a] != now:
                    if waiting:
                        yield from answer()
                    now = int(part[a])
                    lists_.clear()
                waiting.append(batch.slice(a, b - a))
                if not base[b - 1]:  # base rows come first: here they are complete
                    yield from answer()
        if waiting:
            yield from answer()

    asked = stage.df.mapInArrow(ask, "part int, base boolean, mask int, list int, id string, x binary, floor float")
    tasks = int(np.clip(n * dim * 2 * asked_least / 4e6, 8, max(8, first[-1])))
    found = asked.repartition(tasks, "part").sortWithinPartitions("part", F.desc("base")).mapInArrow(search, "id string, neighbour string, cosine float")
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return found.distinct().withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def similar_pairs(df: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.6, dim: int = 384) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b, where one is among the other's k most similar."""
    near = nearest(df, key, vector, k, least, dim)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
