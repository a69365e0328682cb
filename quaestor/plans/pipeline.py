"""The whole refresh: pages and upstream items to the next snapshot of every table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.html import parse_pages
from quaestor.plans import enrich, ingest
from quaestor.plans.lineage import cut
from quaestor.schemas import conform

Tables = dict[str, DataFrame]


def ingest_profiles(current: Tables, pages: DataFrame, items: DataFrame, courses: DataFrame | None = None, base: str = "https://portal.example.org/") -> Tables:
    """Next persons, publications, authorships and courses.

    pages: (url, html[, campus_id]); items: (person_id, raw) as the publication service
    sends them.  Courses come from the pages unless given.  Pages without a person are skipped.
    """
    parsed = cut(parse_pages(pages, base).where("person_id is not null").dropDuplicates(["person_id"]), "parsed")
    people = ingest.persons_from_pages(parsed).drop("campus_id")
    if "campus_id" in pages.columns:  # written only where the crawler knows it
        known = pages.where("campus_id is not null").groupBy(F.col("url").alias("profile_url")).agg(F.min("campus_id").alias("_campus"))
        old = current["persons"].select("person_id", F.col("campus_id").alias("_old"))
        people = people.join(known, "profile_url", "left").join(old, "person_id", "left").withColumn("campus_id", F.coalesce("_campus", "_old")).drop("_campus", "_old")
    people = people.join(ingest.publications_total(items), "person_id", "left").withColumn("publications_total", F.coalesce("publications_total", F.lit(0)))
    have = [c for c in people.columns if c in current["persons"].columns]
    persons = cut(ingest.upsert(current["persons"], people.select(*have), ["person_id"]), "persons")
    one = ingest.last_per_key(items.select("raw", F.try_variant_get(F.try_parse_json("raw"), "$.id", "string").alias("_id")).where("_id is not null"), ["_id"], F.col("raw"))
    pubs = ingest.publications_from_json(one)
    publications = ingest.upsert_publications(current["publications"], pubs.select(*[c for c in pubs.columns if c in current["publications"].columns]))
    authorships = ingest.upsert_authorships(current["authorships"], ingest.authorships_from_json(one), persons)
    if courses is None:
        courses = parsed.select("person_id", F.posexplode("courses").alias("_n", "c")).select("person_id", "_n", "c.*")
    fresh = ingest.courses_from_items(courses)
    lessons = ingest.replace_by_person(current["courses"].drop("id"), fresh, parsed)
    lessons = ingest.with_course_ids(lessons, F.struct("title", "academic_year", "url"))
    return {**current, "persons": persons, "publications": publications, "authorships": authorships, "courses": conform(lessons, "courses")}


def ingest_theses(current: Tables, answers: DataFrame) -> Tables:
    """Next theses and supervisors; answers: (person_id, raw).  What an unknown person brings is not written."""
    known = answers.join(current["persons"].select("person_id"), "person_id", "left_semi")
    one = ingest.last_per_key(known.select("raw", F.try_variant_get(F.try_parse_json("raw"), "$.id", "bigint").alias("_id")).where("_id is not null"), ["_id"], F.col("raw"))
    rows = ingest.theses_from_json(one)
    kept = rows.select("thesis_id")
    links = ingest.supervisors_from_json(one).join(kept, "thesis_id", "left_semi").groupBy("thesis_id", "person_id").agg(F.min("display_name").alias("display_name"))
    return {**current, "theses": ingest.upsert_theses(current["theses"], rows.select(*[c for c in rows.columns if c in current["theses"].columns])), "thesis_supervisors": ingest.upsert_supervisors(current["thesis_supervisors"], links, current["persons"])}


def unsupervised(current: Tables) -> DataFrame:
    """People who teach and have no thesis yet: whom a thesis run with only_empty asks about."""
    from quaestor.functions.nested import teaches

    return current["persons"].where(teaches(F.col("positions"))).select("person_id").join(current["thesis_supervisors"].select("person_id"), "person_id", "left_anti")


def to_enrich(rows: DataFrame, only_empty: bool = False, sample: int | None = None) -> DataFrame:
    """How many rows a run will process."""
    n = F.count_if(F.col("embedding").isNull()) if only_empty else F.count("*")
    return rows.agg((n if sample is None else F.least(n, F.lit(sample))).alias("n"))


def enrich_all(current: Tables, only_empty: bool = False, sample: int | None = None) -> Tables:
    """Next persons and publications with tags and vectors; contexts under the gate lose theirs.

    sample: only so many of each, the first by id; the others stay as they are.
    """
    ctx = enrich.person_contexts(current["persons"], current["publications"], current["authorships"], current["courses"], current["theses"], current["thesis_supervisors"])
    if only_empty:
        ctx = ctx.join(current["persons"].where("embedding is null").select("person_id"), "person_id", "left_semi")
    if sample is not None:
        ctx = ctx.orderBy("person_id").limit(sample)
    ctx = cut(ctx, "contexts")
    persons = ingest.write_back(current["persons"], enrich.enrich_persons(ctx), "person_id", ["interests_extracted", "embedding"])
    p = current["publications"].where("title <> ''")
    if only_empty:
        p = p.where("embedding is null")
    text = p.select("id", enrich.publication_context(F.col("title"), F.col("abstract_ru"), F.col("abstract_en"), F.col("venue")).alias("context")).dropDuplicates(["id"])
    if sample is not None:
        text = text.orderBy("id").limit(sample)
    text = cut(text, "contexts")
    found = enrich.extract_topics(text, "id", "context").withColumnRenamed("tags", "topics").join(text.select("id", enrich.embed(F.col("context")).alias("embedding")), "id")
    return {**current, "persons": persons, "publications": ingest.write_back(current["publications"], found, "id", ["topics", "embedding"])}
