import numpy as np

from quaestor.llm import vectors
from quaestor.llm.vectors import _encoded, _estimate, nearest, similar_pairs

DIM = 384


def data(n=900, seed=1):
    r = np.random.default_rng(seed)
    c = r.standard_normal((n // 12, DIM))
    x = c[r.integers(0, len(c), n)] + 0.55 * r.standard_normal((n, DIM))
    return (x * r.uniform(0.5, 4, (n, 1))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, v array<float>").selectExpr("*", "1 as list", "'x' as neighbour")


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T).astype(np.float64)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :k]
    return {tuple(sorted((f"{i:05d}", f"{j:05d}"))) for i in range(len(x)) for j in top[i] if s[i, j] >= least}


def test_recall_and_precision(spark):
    x = data()
    df = frame(spark, [(f"{i:05d}", list(map(float, v))) for i, v in enumerate(x)])
    got, want = {tuple(r) for r in similar_pairs(df, "id", "v", 10, 0.6).collect()}, brute(x, 10, 0.6)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.99 * len(got)


def test_blocked_lists_give_the_same(spark, monkeypatch):
    x = data(700, 2)
    df = frame(spark, [(f"{i:05d}", list(map(float, v))) for i, v in enumerate(x)])
    whole = {tuple(r) for r in similar_pairs(df, "id", "v").collect()}
    monkeypatch.setattr(vectors, "BLOCK", 40)
    parts = {tuple(r) for r in similar_pairs(df, "id", "v").collect()}
    assert len(whole & parts) >= 0.99 * len(whole | parts)


def test_divided_lists_keep_the_recall(spark, monkeypatch):
    x = data(900, 4)
    df = frame(spark, [(f"{i:05d}", list(map(float, v))) for i, v in enumerate(x)])
    want = brute(x, 10, 0.6)
    for name, value in (("DIVIDE", 100), ("LIST", 40), ("MAX_LISTS", 2)):
        monkeypatch.setattr(vectors, name, value)
    got = {tuple(r) for r in similar_pairs(df, "id", "v", 10, 0.6).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_error_bound_holds_for_nearly_all():
    x = data(400, 3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = u.mean(0)
    guess, error = _estimate(_encoded(u, centre), u[:60], centre)
    assert (np.abs(guess - u[:60] @ u.T) <= error + 1e-3).mean() > 0.93


def test_unusable_vectors_repeats_and_ties(spark):
    v = [1.0] + [0.0] * (DIM - 1)
    w = [1.0, 0.001] + [0.0] * (DIM - 2)
    bad = [("n", None), ("e", []), ("s", [1.0]), ("z", [0.0] * DIM), ("q", [float("nan")] + v[1:]), ("i", [float("inf")] + v[1:]), (None, v)]
    df = frame(spark, [("a", v), ("a", v), ("b", v), ("c", w), *bad])
    got = sorted((r.id, r.neighbour) for r in nearest(df, "id", "v", 1).collect())
    assert got == [("a", "b"), ("b", "a"), ("c", "a")]
    assert nearest(df.where("id = 'z'"), "id", "v").count() == 0


def crowded(n=1500, seed=6):
    """A third of the rows in one topic without structure of its own, the rest in small ones."""
    r = np.random.default_rng(seed)
    topic = r.standard_normal((n // 12, DIM))
    at = r.integers(1, len(topic), n)
    at[: n // 3] = 0
    return (topic[at] + 0.65 * r.standard_normal((n, DIM))).astype(np.float32)


def test_a_dense_topic_over_many_lists_keeps_its_recall(spark, monkeypatch):
    x = crowded()
    df = frame(spark, [(f"{i:05d}", list(map(float, v))) for i, v in enumerate(x)])
    monkeypatch.setattr(vectors, "LIST", 16)
    got, want = {tuple(r) for r in similar_pairs(df, "id", "v", 10, 0.6).collect()}, brute(x, 10, 0.6)
    dense = {p for p in want if p[1] < f"{len(x) // 3:05d}"}
    assert len(got & dense) >= 0.95 * len(dense) > 2000
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.99 * len(got)


def test_neighbours_below_any_threshold_are_found(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = (r.standard_normal((1200, 24)) @ r.standard_normal((24, DIM)) + 3.0 * r.standard_normal((1200, DIM))).astype(np.float32)
    df = frame(spark, [(f"{i:05d}", list(map(float, v))) for i, v in enumerate(x)])
    monkeypatch.setattr(vectors, "LIST", 16)
    got = {(q.id, q.neighbour) for q in nearest(df, "id", "v", 10).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"{i:05d}", f"{j:05d}") for i in range(len(x)) for j in np.argsort(-s[i])[:10]}
    assert len(got & want) >= 0.95 * len(want)


def test_small_topics_that_the_sample_does_not_show_keep_their_recall(spark, monkeypatch):
    r = np.random.default_rng(11)
    n = 4000
    topic = r.standard_normal((n // 8, DIM))
    x = (topic[r.integers(0, len(topic), n)] + 0.6 * r.standard_normal((n, DIM))).astype(np.float32)
    df = frame(spark, [(f"{i:05d}", v.tolist()) for i, v in enumerate(x)])
    monkeypatch.setattr(vectors, "SAMPLE", 160)
    monkeypatch.setattr(vectors, "LIST", 8)
    got, want = {tuple(q) for q in similar_pairs(df, "id", "v", 10, 0.6).collect()}, brute(x, 10, 0.6)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.99 * len(got)
