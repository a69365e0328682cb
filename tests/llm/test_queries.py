"""Registered queries against SQL on the smallest tables."""

import os

import duckdb
import pytest

from quaestor.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
USABLE = "embedding IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
NEAREST = f"""WITH v AS (SELECT 'persons' AS t, person_id::VARCHAR AS id, any_value(embedding::DOUBLE[]) AS v FROM persons WHERE {USABLE} GROUP BY person_id
        UNION ALL SELECT 'publications', id, any_value(embedding::DOUBLE[]) FROM publications WHERE {USABLE} GROUP BY id),
    p AS (SELECT a.t, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.t = b.t AND a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY t, a ORDER BY c DESC, b) AS n FROM p)
    SELECT DISTINCT t AS vec_table, least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 10 AND c >= 0.6"""


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = queries()[name](spark, DIR).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want.astype(got.dtypes.to_dict()))


def test_neighbours_equal_brute_force(spark, duck):
    got = {tuple(r) for r in queries()["p1_found"](spark, DIR).collect()}
    want = set(duck.execute(NEAREST).fetchall())
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


COLUMNS = {"p1_neighbours": ["id", "neighbour", "cosine"], "p2_found": ["publication_id", "field", "lang"], "p5_found": ["src", "rec_id", "rec_seq", "person_id"], "p5_groups": ["name", "name_en", "class_id", "n_links"],
           "p7_mix": ["doc_id", "source", "n_tokens", "copies"], "p8_found": ["doc_id", "kind", "pii_value"], "p8_masked": ["doc_id", "text", "n_finds"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_runs(spark, name):
    got = queries()[name](spark, DIR)
    assert got.columns == COLUMNS[name] and got.count() > 0
