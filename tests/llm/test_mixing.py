import pytest

from quaestor.llm.mixing import encoder, mix, shares

pytest.importorskip("public_tokenizers")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as n_tokens", "2 as copies", "'z' as _whole")


def targets_of(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_normalised_sources(spark):
    rows = [(k, " Alpha" if k % 2 else "alpha", f"слово {k} and some words") for k in range(600)] + [(1000 + k, "beta", f"text number {k}") for k in range(100)] + [(5000, None, "x"), (5001, "other", "y")]
    t = targets_of(spark, [("alpha", 0.5, 1), ("beta", 0.5, 3), ("gone", 0.0, 2)])
    m = mix(docs_of(spark, rows), t)
    got = {r.source: r for r in shares(m, t).collect()}
    assert abs(got["alpha"].reached_share - 0.5) < 0.01 and got["beta"].most_copies <= 3 and got["gone"].tokens == 0
    assert {r.source for r in m.collect()} == {"alpha", "beta"} and m.count() == m.select("doc_id").distinct().count()


def test_token_counts_are_the_tokenizers(spark):
    text = "Привет, world! " * 3000
    m = mix(docs_of(spark, [(1, "a", text), (2, "a", ""), (3, "a", None)]), targets_of(spark, [("a", 1.0, 2)]))
    n = {r.doc_id: (r.n_tokens, r.copies) for r in m.collect()}
    assert n == {1: (len(encoder().encode_ordinary(text)), 2), 2: (0, 2), 3: (0, 2)}


def test_repeatable_and_seeded(spark):
    rows = [(k, "a" if k % 3 else "b", f"words {k}") for k in range(300)]
    t = targets_of(spark, [("a", 0.3, 1), ("b", 0.7, 1)])
    one = lambda s: sorted(r.doc_id for r in mix(docs_of(spark, rows), t, seed=s).collect())
    assert one(1) == one(1) and one(1) != one(2)


def test_equal_texts_are_different_documents_and_empty_tables(spark):
    t = targets_of(spark, [("a", 1.0, 1)])
    assert mix(docs_of(spark, [(1, "a", "same"), (2, "a", "same")]), t).count() == 2
    assert mix(docs_of(spark, [(1, "a", "x")]).where("doc_id < 0"), t).count() == 0
    assert mix(docs_of(spark, [(1, "a", "x")]), t.where("max_repeats < 0")).count() == 0


def test_longer_documents_are_favoured_and_whole_copies_are_certain(spark):
    rows = [(k, "a", "word " * (1 + k % 40)) for k in range(4000)] + [(9000 + k, "b", "word " * 10) for k in range(100)]
    t = targets_of(spark, [("a", 0.9, 3), ("b", 0.1, 1)])
    m = mix(docs_of(spark, rows), t).where("source = 'a'").toPandas()
    size = m.n_tokens * m.copies
    want = 9 * 100 * len(encoder().encode_ordinary("word " * 10))
    assert want - 41 <= size.sum() <= want
    per = m.groupby(m.doc_id % 40).copies.sum() / 100  # mean copies of the documents of one length
    short, long = per.reindex(range(0, 8), fill_value=0).mean(), per.reindex(range(32, 40), fill_value=0).mean()
    assert 2.0 < long / short < 4.0  # the square root of the lengths
    even = mix(docs_of(spark, rows), t, power=0).where("source = 'a'").toPandas()
    per = even.groupby(even.doc_id % 40).copies.sum() / 100
    assert 0.7 < per.reindex(range(32, 40)).mean() / per.reindex(range(0, 8)).mean() < 1.4


def test_whole_copies_before_the_sample(spark):
    rows = [(k, "a", "word " * 5) for k in range(100)] + [(500 + k, "b", "word " * 5) for k in range(150)]
    m = mix(docs_of(spark, rows), targets_of(spark, [("a", 0.5, 4), ("b", 0.5, 1)])).toPandas()
    a = m[m.source == "a"].copies
    assert len(a) == 100 and a.min() == 1 and a.max() == 2 and a.sum() == 150


def test_ten_thousand_targets(spark):
    rows = [(k, f"s{k % 10_000}", f"text {k}") for k in range(20_000)]
    t = targets_of(spark, [(f"s{k}", 1e-4, 1) for k in range(10_000)])
    m = mix(docs_of(spark, rows), t)
    assert m.select("source").distinct().count() == 10_000
    with pytest.raises(ValueError):
        mix(docs_of(spark, rows), t.union(targets_of(spark, [("more", 0.1, 1)])))


def test_a_source_listed_twice(spark):
    t = targets_of(spark, [("a", 0.25, 1), ("A ", 0.25, 2), ("b", 0.5, 1)])
    m = mix(docs_of(spark, [(1, "a", "one two"), (2, "b", "one two")]), t)
    got = {r.source: r for r in shares(m, t).collect()}
    assert got["a"].target_share == 0.5 and got["a"].max_repeats == 2 and got["a"].reached_share == 0.5
