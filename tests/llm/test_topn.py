import random

from quaestor.llm.topn import top_n


def brute(links, items, n):
    best = {}
    for i, s in items:
        if i is not None and s is not None:
            best[i] = max(s, best.get(i, s))
    groups = {}
    for g, i in set(links):
        if g is not None and i in best:
            groups.setdefault(g, []).append((-best[i], i))
    return sorted((g, i) for g, v in groups.items() for _, i in sorted(v)[:n])


def run(spark, links, items, n):
    a = spark.createDataFrame(links, "g long, i string").selectExpr("*", "1 as _code", "'x' as _cut")
    b = spark.createDataFrame(items, "i string, s int")
    return sorted(tuple(r) for r in top_n(a, b, "g", "i", "s", n).collect())


def test_against_brute_force_with_a_hot_group_ties_and_nulls(spark):
    r = random.Random(3)
    items = [(f"p{k}", r.choice([None, 1999, 2020, 2021, 2022])) for k in range(900)] + [("p5", 2020), (None, 2000)]
    links = [(1, f"p{k}") for k in range(900)] + [(r.choice([2, 3, 4, 5, None]), f"p{r.randrange(1000)}") for _ in range(300)]
    links += links[:50] + [(7, "missing"), (8, None)]
    for n in (1, 10):
        assert run(spark, links, items, n) == brute(links, items, n)


def test_all_scores_equal(spark):
    items, links = [(f"x{k:03d}", 5) for k in range(200)], [(1, f"x{k:03d}") for k in range(200)]
    assert run(spark, links, items, 3) == [(1, "x000"), (1, "x001"), (1, "x002")]


def test_exactly_n_and_empty(spark):
    items, links = [(f"x{k}", k) for k in range(10)], [(1, f"x{k}") for k in range(10)]
    assert len(run(spark, links, items, 10)) == 10
    assert run(spark, [(1, "a")], [("b", 1)], 3) == []
    a, b = spark.createDataFrame([], "g long, i string"), spark.createDataFrame([], "i string, s int")
    assert top_n(a, b, "g", "i", "s", 3).count() == 0
