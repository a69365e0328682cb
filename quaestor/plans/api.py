"""The public queries: listings, cards, search, experts, feeds.

Every function takes tables (a Catalog) and returns a DataFrame or a Page.  Filters
and orderings are Columns, so pruning, pushdown and top-k planning are Catalyst's.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.functions import lexicon, nested, text, vector
from quaestor.operators import paging
from quaestor.operators.predicates import between, check_query, check_range, equals, has_publications, since, where_all
from quaestor.plans import enrich
from quaestor.sources.tables import exists, point, require, table


class Catalog:
    """The stored tables.  A publication that was ingested twice is one publication."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def pubs(self, *columns: str) -> DataFrame:
        """Publications with the given columns, one row an id.  Only ingested_at can differ between rows of an id, so only wanted columns meet the shuffle."""
        return self.publications.select("id", *[c for c in columns if c != "id"]).dropDuplicates(["id"])

    def links(self) -> DataFrame:
        """(person_id, id) pairs of known authors, each once."""
        return self.authorships.where("person_id is not null").select("person_id", F.col("publication_id").alias("id")).distinct()


# --- people ----------------------------------------------------------------------


def with_campus(persons: DataFrame, campuses: DataFrame) -> DataFrame:
    return persons.join(campuses, "campus_id", "left")


def persons_query(c: Catalog, q=None, campus_id=None, has_pubs=None, language=None) -> DataFrame:
    parts = [[text.contains_ci(F.col("full_name"), q)] if q else [], equals("campus_id", campus_id), has_publications(has_pubs), [nested.has_language(F.col("languages"), language)] if language else []]
    p = where_all(c.persons, *parts)
    return with_campus(p.select("person_id", "full_name", "avatar", "profile_url", "primary_unit", "campus_id", "publications_total"), c.campuses)


def list_persons(c: Catalog, page=1, page_size=20, ordering="full_name", **filters) -> paging.Page:
    check_range("page_size", page_size, 1, 100)
    return paging.paginate(persons_query(c, **filters), paging.ordering(paging.PERSON_ORDERINGS, ordering, "person_id"), page, page_size)


def person_card(c: Catalog, person_id: int) -> DataFrame:
    p = with_campus(require(c.persons, "person_id", person_id), c.campuses)
    return p.withColumns({"research_ids": F.transform_values("research_ids", lambda k, v: v.cast("string")), "n_languages": F.size("languages"), "initial": F.substring("full_name", 1, 1)})


def resolve_campus(c: Catalog, name: str) -> str | None:
    """First campus, by id, whose name holds the text; None means no filter."""
    row = c.campuses.where(text.contains_ci(F.col("campus_name"), name)).orderBy("campus_id").limit(1).head()
    return row[0] if row else None


def person_publications(c: Catalog, person_id: int, year_from=None, year_to=None, type=None) -> DataFrame:
    pubs = where_all(c.pubs("title", "type", "year"), between("year", year_from, year_to), equals("type", type))
    mine = c.authorships.where(F.col("person_id") == person_id).select(F.col("publication_id").alias("id"))
    return pubs.join(mine, "id", "left_semi")


NEWEST = [lambda: F.col("year").desc_nulls_last(), lambda: F.col("id").asc()]


def newest_first() -> list[Column]:
    return [x() for x in NEWEST]


def list_person_publications(c: Catalog, person_id: int, page=1, page_size=20, **filters) -> paging.Page:
    if not exists(c.persons, F.col("person_id") == person_id):
        require(c.persons, "person_id", person_id)
    return paging.paginate(person_publications(c, person_id, **filters), newest_first(), page, page_size)


def person_courses(c: Catalog, person_id: int, academic_year=None) -> DataFrame:
    return where_all(c.courses.where(F.col("person_id") == person_id), equals("academic_year", academic_year))


LATEST_YEAR = [lambda: F.col("academic_year").desc_nulls_last(), lambda: F.col("id").asc()]


def list_person_courses(c: Catalog, person_id: int, page=1, page_size=20, academic_year=None) -> paging.Page:
    require(c.persons, "person_id", person_id)
    return paging.paginate(person_courses(c, person_id, academic_year), [x() for x in LATEST_YEAR], page, page_size)


def card_stats(c: Catalog, people: DataFrame) -> DataFrame:
    """(person_id, courses, theses) with 0 where there are none."""
    courses = c.courses.groupBy("person_id").agg(F.countDistinct("title").alias("courses"))
    theses = c.thesis_supervisors.groupBy("person_id").agg(F.count("*").alias("theses"))
    return people.select("person_id").join(courses, "person_id", "left").join(theses, "person_id", "left").fillna(0, ["courses", "theses"])


def unit_facet(c: Catalog, least: int = lexicon.TEACHER_UNITS_MIN) -> DataFrame:
    rows = c.persons.where("primary_unit is not null and embedding is not null")
    return rows.groupBy("primary_unit").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "primary_unit")


def course_rollup(courses: DataFrame) -> DataFrame:
    """One row a person and stripped title: years in order, levels, languages, times taught; blank titles are dropped."""
    title = text.strip(F.col("title"))
    rows = courses.select("person_id", "id", "academic_year", "level", "language", title.alias("title")).where("title <> ''")
    kept = lambda x: F.when(F.col(x) != "", F.col(x))
    out = rows.groupBy("person_id", "title").agg(
        F.sort_array(F.collect_set(kept("academic_year")), asc=False).alias("years"), F.sort_array(F.collect_set(kept("level"))).alias("levels"),
        F.sort_array(F.collect_set(kept("language"))).alias("languages"), F.max(F.struct("academic_year", "id")).alias("newest"))
    return out.withColumns({"times_taught": F.size("years"), "latest_year": F.coalesce(F.array_max("years"), F.lit(""))})


def person_profile_courses(c: Catalog, person_id: int, page=1, page_size=20) -> paging.Page:
    rows = course_rollup(c.courses.where(F.col("person_id") == person_id))
    return paging.paginate(rows, [F.col("latest_year").desc(), F.col("newest").desc()], page, page_size)


# --- publications ----------------------------------------------------------------


def publications_query(c: Catalog, q=None, year_from=None, year_to=None, type=None, author_person_id=None) -> DataFrame:
    pubs = c.pubs("title", "type", "year", "created_at")
    pubs = where_all(pubs, [text.contains_ci(F.col("title"), q)] if q else [], between("year", year_from, year_to), equals("type", type))
    if author_person_id is not None:
        pubs = pubs.join(c.authorships.where(F.col("person_id") == author_person_id).select(F.col("publication_id").alias("id")), "id", "left_semi")
    return pubs


def list_publications(c: Catalog, page=1, page_size=20, ordering="-created_at", **filters) -> paging.Page:
    check_range("year_from", filters.get("year_from"), 1900, 2100)
    check_range("year_to", filters.get("year_to"), 1900, 2100)
    return paging.paginate(publications_query(c, **filters), paging.ordering(paging.PUBLICATION_ORDERINGS, ordering, "id"), page, page_size)


def authors_of(c: Catalog) -> DataFrame:
    """(id, authors): author structs in the order of their positions."""
    a = F.struct("position", "person_id", "display_name", "display_name_en", "href", "is_hse_person")
    return c.authorships.distinct().groupBy(F.col("publication_id").alias("id")).agg(F.array_sort(F.collect_list(a)).alias("authors"))


def with_authors(c: Catalog, pubs: DataFrame) -> DataFrame:
    """Adds `authors`; only the authorships of these publications are gathered."""
    own = c.authorships.join(pubs.select(F.col("id").alias("publication_id")), "publication_id", "left_semi")
    a = F.struct("position", "person_id", "display_name", "display_name_en", "href", "is_hse_person")
    per = own.distinct().groupBy(F.col("publication_id").alias("id")).agg(F.array_sort(F.collect_list(a)).alias("authors"))
    return pubs.join(per, "id", "left").withColumn("authors", F.coalesce("authors", F.array().cast(per.schema["authors"].dataType)))


def author_card(authors: Column, n: int = 5) -> tuple[Column, Column]:
    """The first n names, and how many more there are."""
    return F.transform(F.slice(authors, 1, n), lambda a: a["display_name"]), F.greatest(F.size(authors) - n, F.lit(0))


def forthcoming(raw: Column, year: Column, now: datetime) -> Column:
    status = F.try_variant_get(F.try_parse_json(raw), "$.status", "string")
    return F.coalesce(status == "2", F.lit(False)) | F.coalesce(year > now.year, F.lit(False))


def publication_cards(c: Catalog, pub_id: str) -> DataFrame:
    """The card of a publication; no row where there is none."""
    return with_authors(c, point(c.publications.drop("embedding"), "id", pub_id))


def publication_card(c: Catalog, pub_id: str) -> DataFrame:
    require(c.publications, "id", pub_id)
    return publication_cards(c, pub_id)


# --- search ----------------------------------------------------------------------


def lexical_persons(c: Catalog, q: str) -> DataFrame:
    return c.persons.where(text.contains_ci(F.col("full_name"), q)).select(F.lit("person").alias("kind"), F.col("person_id").cast("string").alias("key"), F.col("full_name").alias("label"), "publications_total", F.round(text.trigram_similarity(F.col("full_name"), F.lit(q)), 6).alias("score"))


def lexical_publications(c: Catalog, q: str) -> DataFrame:
    hits = c.publications.where(text.contains_ci(F.col("title"), q)).select("id", "title", "year").distinct()
    return hits.select(F.lit("publication").alias("kind"), F.col("id").alias("key"), F.col("title").alias("label"), "year", F.round(text.trigram_similarity(F.col("title"), F.lit(q)), 6).alias("score"))


def person_relevance() -> list[Column]:
    return [F.col("score").desc(), F.col("publications_total").desc(), F.col("label").asc(), F.col("key").asc()]


def publication_relevance() -> list[Column]:
    return [F.col("score").desc(), F.col("year").desc_nulls_last(), F.col("key").asc()]


def search(c: Catalog, q: str, type: str = "all", page: int = 1, page_size: int = 20) -> DataFrame:
    """People first, then publications, under one page window."""
    check_query(q)
    parts = []
    if type in ("all", "person"):
        parts.append((lexical_persons(c, q), person_relevance()))
    if type in ("all", "publication"):
        parts.append((lexical_publications(c, q), publication_relevance()))
    return paging.concatenated_page(parts, page, page_size)


def search_totals(c: Catalog, q: str) -> DataFrame:
    a = lexical_persons(c, q).agg(F.count("*").alias("persons"))
    b = lexical_publications(c, q).agg(F.count("*").alias("publications"))
    return a.join(b).withColumn("total", F.col("persons") + F.col("publications"))  # one row with one row


def search_courses(c: Catalog, q=None, academic_year=None, language=None) -> DataFrame:
    rows = where_all(c.courses, [text.contains_ci(F.col("title"), q)] if q else [], equals("academic_year", academic_year), equals("language", language))
    return rows.join(c.persons.select("person_id", F.col("full_name").alias("person_name")), "person_id")


def news(c: Catalog, moment=None, source=None, person_id=None) -> DataFrame:
    """Publications with a creation time, newest first; the portal's own news are not stored, so that source is empty."""
    rows = where_all(c.pubs("title", "created_at", "url"), [F.col("created_at").isNotNull()], since("created_at", moment))
    if source == "portal":
        rows = rows.where(F.lit(False))
    if person_id is not None:
        rows = rows.join(c.authorships.where(F.col("person_id") == person_id).select(F.col("publication_id").alias("id")), "id", "left_semi")
    return rows


def news_order() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id")]


# --- vectors ---------------------------------------------------------------------


def stored_vector(df: DataFrame, key: str, value) -> list[float]:
    """The embedding of one row, as the query."""
    row = df.where(F.col(key) == F.lit(value)).select("embedding").limit(1).head()
    if row is None or row[0] is None:
        raise LookupError(f"no vector under {key}={value!r}")
    return list(row[0])


def top_publications(c: Catalog, people: DataFrame, k: int = 3) -> DataFrame:
    """(person_id, rank, id, title, year): the k newest publications of the given people."""
    links = c.links().join(people.select("person_id"), "person_id", "left_semi")
    w = Window.partitionBy("person_id").orderBy(F.col("year").desc_nulls_last(), F.col("id"))
    rows = links.join(c.pubs("title", "year"), "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows.select("person_id", "rank", "id", "title", "year")


def experts(c: Catalog, query: list[float], q: str = "", limit: int = 20, offset: int = 0, campus_id=None, unit=None, has_pubs=None) -> DataFrame:
    """The people nearest to a query vector who teach or do research, with the topics they share with q."""
    check_range("limit", limit, 1, 50)
    p = where_all(c.persons, [nested.teaches(F.col("positions"))], equals("campus_id", campus_id), [nested.works_in(F.col("positions"), unit)] if unit else [], has_publications(has_pubs))
    top = vector.vector_top_k(p.select("person_id", "full_name", "campus_id", "primary_unit", "interests", "interests_extracted", "embedding"), "person_id", "embedding", query, limit, offset)
    top = with_campus(top.drop("embedding"), c.campuses)
    return top.withColumns({"tier": vector.score_tier(F.col("score")), "matched": nested.matched_topics(q, F.col("interests"), F.col("interests_extracted"))})


def expert_hits(c: Catalog, query: list[float], q: str = "", pubs_per_person: int = 3, **filters) -> DataFrame:
    """`experts` with their newest publications."""
    hits = experts(c, query, q, **filters)
    pubs = top_publications(c, hits, pubs_per_person).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "year"))).alias("publications"))
    return hits.join(pubs, "person_id", "left")


def semantic_publications(c: Catalog, query: list[float], limit: int = 20, year_from=None, year_to=None, type=None, language=None) -> DataFrame:
    rows = where_all(c.publications.select("id", "title", "type", "year", "language", "embedding"), between("year", year_from, year_to), equals("type", type), equals("language", language))
    one = vector.scored(rows, "embedding", query).drop("embedding").dropDuplicates(["id"])  # copies of an id have equal scores; no vector is shuffled
    return one.orderBy(F.col("score").desc(), "id").limit(limit)


def publication_hits(c: Catalog, query: list[float], **filters) -> DataFrame:
    """`semantic_publications` with their authors."""
    return with_authors(c, semantic_publications(c, query, **filters))


def query_tags(c: Catalog, q: str, lemmatise=None) -> DataFrame:
    """(tag): the keyphrases of a query, best first; a short query has none."""
    one = c.spark.range(1).select("id", F.lit(q).alias("q"))
    return enrich.extract_topics(one, "id", "q", lemmatise=lemmatise).select(F.posexplode("tags").alias("n", "tag")).orderBy("n").select("tag")


def search_experts(c: Catalog, q: str, embedder, lemmatise=None, **filters) -> dict[str, DataFrame]:
    """What an expert search answers: the tags of the query, and the hits with their publications."""
    check_query(q)
    return {"query_tags": query_tags(c, q, lemmatise), "results": expert_hits(c, list(map(float, embedder([q])[0])), q, **filters)}


def shown(hits: DataFrame) -> DataFrame:
    """Hits under the lowest tier are hidden after the limit, so a page may be short."""
    return hits.where(F.col("score") >= lexicon.SCORE_TIERS[-1][0])


def publications_or_lexical(c: Catalog, q: str, embedder=None, ordering: str | None = None, **filters) -> DataFrame:
    """Semantic search with authors, or the lexical listing with a null score where there is no embedder, it fails, or the query is short.

    The lexical listing is newest first unless an ordering is named.
    """
    if embedder is not None and len(q) >= 2:
        try:
            query = list(map(float, embedder([q])[0]))
        except Exception:  # whatever a model raises, the page is answered without it
            query = None
        if query is not None:
            return publication_hits(c, query, **filters)
    limit = filters.pop("limit", 20)
    filters.pop("language", None)
    order = newest_first() if ordering is None else paging.ordering(paging.PUBLICATION_ORDERINGS, ordering, "id")
    return with_authors(c, publications_query(c, q=q or None, **filters).orderBy(*order).limit(limit)).withColumn("score", F.lit(None).cast("double"))


def home(c: Catalog, q: str = "", query: list[float] | None = None, page: int = 1, campus: str | None = None, ordering: str = "-publications_total") -> dict[str, DataFrame]:
    """The start page: a listing without a query; with one, experts and name hits, the latter first if q looks like a name."""
    campus_id = resolve_campus(c, campus) if campus else None
    if not q:
        rows = persons_query(c, campus_id=campus_id)
        return {"people": paging.page_of(rows, paging.ordering(paging.PERSON_ORDERINGS, ordering, "person_id", default="full_name"), page, 20)}
    if len(q) < 2:
        return {}
    name_like = text.looks_like_name(q)
    names = persons_query(c, q=q, campus_id=campus_id).orderBy(F.col("publications_total").desc_nulls_last(), "full_name", "person_id").limit(10 if name_like else 5)
    out = {"names": names} if name_like else {}
    if query is not None:
        out["experts"] = shown(experts(c, query, q, limit=5, offset=5 * (min(page, 10) - 1), campus_id=campus_id))
    out["names"] = names
    out["publications"] = publications_query(c, q=q).orderBy(*newest_first()).limit(5)
    out["courses"] = search_courses(c, q=q).orderBy(F.col("academic_year").desc_nulls_last(), "id").limit(5)
    return out


def person_profile(c: Catalog, person_id: int, now: datetime, pub_page: int = 1, course_page: int = 1) -> dict[str, DataFrame]:
    """The profile page: card with counts and further units, publications marked if forthcoming, courses rolled up."""
    card = person_card(c, person_id).withColumn("extra_units", nested.extra_units(F.col("positions"), F.col("primary_unit")))
    pubs = c.pubs("title", "type", "year", "raw").join(c.authorships.where(F.col("person_id") == person_id).select(F.col("publication_id").alias("id")), "id", "left_semi")
    page = paging.page_of(pubs.withColumn("forthcoming", forthcoming(F.col("raw"), F.col("year"), now)).drop("raw"), newest_first(), pub_page, 10)
    return {"card": card.join(card_stats(c, card), "person_id"), "publications": page, "courses": person_profile_courses(c, person_id, course_page, 20).rows}


def publications_page(c: Catalog, q: str = "", page: int = 1, page_size: int = 20, **filters) -> DataFrame:
    """One page of the lexical listing, with the authors of its publications."""
    return with_authors(c, list_publications(c, page, page_size, q=q or None, **filters).rows)
