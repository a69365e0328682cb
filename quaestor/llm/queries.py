"""Queries of the training-data operators over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.vectors import similar_pairs

    one = lambda t, key: similar_pairs(table(spark, d, t), key, "embedding").select(F.lit(t).alias("vec_table"), "id_a", "id_b")
    return one("persons", "person_id").unionByName(one("publications", "id"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar publications of every publication, whatever their similarity."""
    from quaestor.llm.vectors import nearest

    return nearest(table(spark, d, "publications"), "id", "embedding", 10).withColumn("cosine", F.round("cosine", 4))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.langid import label_cases

    return label_cases(table(spark, d, "publications"), table(spark, d, "documents"))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every publication's title and of every segment of its abstracts."""
    from quaestor.llm.langid import publication_languages

    return publication_languages(table(spark, d, "publications"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.copies import hidden_copies

    return hidden_copies(table(spark, d, "courses"), "id", ["title", "academic_year", "language", "level"], ["raw_meta"], ["person_id"])


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.copies import collapse

    got = collapse(table(spark, d, "courses"), "id", ["title", "academic_year", "language", "level"], ["raw_meta"], ["person_id"])
    return got.select("id", "person_id", "title", "n_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.topn import top_n

    links = table(spark, d, "authorships").select("person_id", "publication_id")
    items = table(spark, d, "publications").select(F.col("id").alias("publication_id"), "year")
    return top_n(links, items, "person_id", "publication_id", "year", 10)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.names import linked_records

    return linked_records(table(spark, d, "persons"), table(spark, d, "authorships"), table(spark, d, "thesis_supervisors"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every typed name without a profile of its own id, with the group of names it is a spelling of."""
    from quaestor.llm.names import name_groups, unlinked_records

    persons = table(spark, d, "persons")
    return name_groups(persons, unlinked_records(persons, table(spark, d, "authorships"), table(spark, d, "thesis_supervisors")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select(F.col("doc").alias("doc_id"), "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with their extent, exact ones and those with small changes (8 of 10 words within 2 places)."""
    from quaestor.llm.leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), slack=2, most=8).withColumnRenamed("doc", "doc_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.mixing import mix

    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.mixing import mix, shares

    targets = table(spark, d, "mix_targets")
    return shares(mix(table(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.pii import pii_finds

    return pii_finds(table(spark, d, "documents").select("doc_id", "text"))


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    from quaestor.llm.pii import find_pii

    got = find_pii(table(spark, d, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("masked").alias("text"), F.size("finds").alias("n_finds"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_languages, p3_found, p3_collapsed, p4_found, p5_found, p5_groups, p6_found, p6_report, p7_mix, p7_shares, p8_found, p8_masked)}


def oracle_sql() -> dict[str, str]:
    squeeze = lambda c: rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"
    meta = rf"""array_to_string(list_sort(list_filter(list_transform(string_split_regex(raw_meta, '[;|\r\n]'), lambda x: {squeeze('x')}), lambda x: x <> '')), chr(1))"""
    courses = f"""SELECT id, person_id, title AS raw_title, to_json([person_id::VARCHAR, {squeeze('title')}, {squeeze('academic_year')}, {squeeze('language')}, {squeeze('level')}, {meta}]) AS k FROM courses"""
    words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    runs = lambda t, key: f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 8), lambda i: hash(w[i:i+9]))) AS g FROM (SELECT {key}, {words} AS w FROM {t} WHERE text IS NOT NULL)"
    return {
        "p6_found": f"""WITH d AS ({runs("documents", "doc_id")}), i AS ({runs("eval_items", "item_id")}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)""",
        "p3_found": f"""WITH c AS ({courses}), g AS (SELECT *, min(id) OVER (PARTITION BY k) AS kept_id FROM c)
            SELECT DISTINCT kept_id, id AS copy_id FROM g WHERE id <> kept_id""",
        "p3_collapsed": f"""WITH c AS ({courses}), g AS (SELECT k, min(id) AS id, count(*) AS n_copies FROM c GROUP BY k)
            SELECT c.id, c.person_id, c.raw_title AS title, g.n_copies FROM g JOIN c USING (id)""",
        "p4_found": """WITH p AS (SELECT id, max(year) AS year FROM publications WHERE year IS NOT NULL GROUP BY id),
            a AS (SELECT DISTINCT person_id, publication_id FROM authorships WHERE person_id IS NOT NULL),
            r AS (SELECT a.person_id, a.publication_id, row_number() OVER (PARTITION BY a.person_id ORDER BY p.year DESC, p.id) AS n FROM a JOIN p ON p.id = a.publication_id)
            SELECT person_id, publication_id FROM r WHERE n <= 10""",
    }
