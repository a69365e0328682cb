from quaestor.llm.copies import collapse, hidden_copies

SCHEMA = "id int, person_id long, title string, academic_year string, raw_meta string, kept_id int, _id string, _n string"


def pairs(df):
    return sorted(tuple(r) for r in hidden_copies(df, "id", ["title", "academic_year"], ["raw_meta"], ["person_id"]).collect())


def rows(spark, *items):
    return spark.createDataFrame([(*x, 7, "clash", "clash") for x in items], SCHEMA)


def test_formatting_does_not_count(spark):
    df = rows(spark, (5, 1, "Теория  Графов!", "2020/2021", "A: 1; B: 2"), (3, 1, "теория графов", "2020 2021", "b:2|a:1"), (9, 1, "теория графов", "2020/2021", "A: 1\nB: 2;"), (4, 1, "теория графав", "2020/2021", "A: 1; B: 2"))
    assert pairs(df) == [(3, 5), (3, 9)]


def test_same_letters_other_order_is_no_copy(spark):
    assert pairs(rows(spark, (1, 1, "кот", "x", None), (2, 1, "ток", "x", None))) == []


def test_null_equals_only_null(spark):
    df = rows(spark, (1, 1, None, "x", None), (2, 1, None, "x", None), (3, 1, "", "x", None), (4, None, None, "x", None), (5, None, None, "x", None), (6, 1, None, "x", ""))
    assert pairs(df) == [(1, 2), (4, 5)]


def test_repeated_ids_are_one_row_and_null_ids_none(spark):
    assert pairs(rows(spark, (1, 1, "a", "x", None), (1, 1, "a", "x", None), (None, 1, "a", "x", None))) == []


def test_list_entries_are_a_multiset(spark):
    assert pairs(rows(spark, (1, 1, "a", "x", "p;p;q"), (2, 1, "a", "x", "p;q"), (3, 1, "a", "x", "q;p;p"))) == [(1, 3)]


def test_hot_class_long_text_and_empty_table(spark):
    long = "слово " * 20_000
    df = rows(spark, *[(i, 1, long if i % 2 else long.upper(), "x", None) for i in range(1, 41)])
    assert pairs(df) == [(1, i) for i in range(2, 41)]
    assert pairs(rows(spark, (1, 1, "a", "x", None)).where("id < 0")) == []


def test_collapse_counts_copies(spark):
    df = rows(spark, (1, 1, "A", "x", None), (2, 1, "a", "x", None), (3, 2, "b", "x", None))
    got = collapse(df, "id", ["title", "academic_year"], ["raw_meta"], ["person_id"])
    assert sorted((r.id, r.n_copies, r.kept_id) for r in got.collect()) == [(1, 2, 7), (3, 1, 7)]


def test_collapse_of_repeated_ids(spark):
    df = rows(spark, (1, 1, "a", "x", None), (1, 1, "a", "x", None), (2, 1, "A", "x", None), (3, 1, "b", "x", None), (3, 2, "c", "x", None), (None, 1, "a", "x", None))
    got = collapse(df.selectExpr("*", "9 as n_copies"), "id", ["title", "academic_year"], ["raw_meta"], ["person_id"])
    assert sorted((r.id, r.n_copies) for r in got.collect()) == [(1, 2), (3, 1)]
