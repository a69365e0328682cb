"""Normalising upstream JSON, and snapshot upserts: (current, incoming) gives the next table.

Upserts are functions of DataFrames; writing the result is left to the caller.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.lexicon import PUBLICATION_TYPES
from quaestor.functions.nested import primary_unit
from quaestor.functions.text import absolutize, blank_to_null, clean_whitespace, strip, supervisor_id_from_url


def _unescape(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)

    return run(c)


def clean_html(c: Column) -> Column:
    """Entities are decoded, then tags removed, white space collapsed; nothing left gives null.  Only values with an & pass through Python."""
    decoded = F.when(c.contains("&"), _unescape(F.when(c.contains("&"), c))).otherwise(c)
    return blank_to_null(clean_whitespace(F.regexp_replace(decoded, "<[^>]+>", "")))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))


def clean_label(c: Column) -> Column:
    """As clean_html for short labels inside arrays: the common entities, without Python."""
    for name, sign in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return blank_to_null(clean_whitespace(F.regexp_replace(c, "<[^>]+>", "")))


def publication_type(c: Column) -> Column:
    return F.when(c.isin(*PUBLICATION_TYPES), c).otherwise("OTHER")


def _text(raw: Column, path: str) -> Column:
    return F.try_variant_get(raw, path, "string")


def _object(raw: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(raw, path, "variant")).startswith("OBJECT"), F.lit(False))


def _author(raw: Column, position: Column, portal: str, own_only: bool) -> Column:
    """Author entry of any role.  own_only: the id counts only for people with a profile."""
    titled = _object(raw, "$.title")
    name = F.when(titled, F.coalesce(blank_to_null(_text(raw, "$.title.ru")), _text(raw, "$.title.en"))).otherwise(_text(raw, "$.title"))
    shown = F.coalesce(clean_label(name), blank_to_null(_text(raw, "$.altName")), _text(raw, "$.otherName"), F.lit(""))
    href = absolutize(_text(raw, "$.href"), portal)
    known = F.coalesce((_text(raw, "$.enVersionStatus") == "2") & href.isNotNull(), F.lit(False))
    number = F.when(_text(raw, "$.id").rlike(r"^\d+$"), _text(raw, "$.id")).try_cast("bigint")
    return F.struct(
        (F.when(known, number) if own_only else number).alias("person_id"), shown.alias("display_name"),
        F.when(titled, blank_to_null(strip(_text(raw, "$.title.en")))).alias("display_name_en"),
        href.alias("href"), known.alias("is_hse_person"), position.cast("int").alias("position"))


def _entries(raw: Column, role: str) -> Column:
    return F.coalesce(F.try_variant_get(raw, f"$.authorsByType.{role}", "array<variant>"), F.array().cast("array<variant>"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def role_authors(raw: Column, roles: list[str], portal: str) -> Column:
    """Authors of several roles in order, renumbered from 0."""
    every = F.filter(F.flatten(F.array(*[_entries(raw, r) for r in roles])), _is_object)
    return F.transform(every, lambda x, i: _author(x, i, portal, True))


def publications_from_json(items: DataFrame, raw: str = "raw", base: str = "https://pubs.example.org", portal: str = "https://portal.example.org") -> DataFrame:
    """One row an item (a JSON text a row); items without an id are dropped, a year counts only if it is a JSON integer."""
    v = F.col("_v")
    rows = items.select(F.col(raw).alias("raw"), F.try_parse_json(F.col(raw)).alias("_v")).where(_text(v, "$.id").isNotNull())
    whole = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.year", "variant")) == "BIGINT", F.lit(False))
    link = lambda k: absolutize(_text(v, f"$.documents.{k}.href"), base)
    return rows.select(
        _text(v, "$.id").alias("id"), F.coalesce(_text(v, "$.title"), F.lit("")).alias("title"), publication_type(_text(v, "$.type")).alias("type"),
        F.when(whole, F.try_variant_get(v, "$.year", "int")).alias("year"),
        F.when(_object(v, "$.language"), _text(v, "$.language.name")).otherwise(_text(v, "$.language")).alias("language"),
        F.try_to_timestamp(_text(v, "$.createdAt")).alias("created_at"), "raw",
        clean_html(_text(v, "$.annotation.ru")).alias("abstract_ru"), clean_html(_text(v, "$.annotation.en")).alias("abstract_en"),
        clean_html(_text(v, "$.description.api")).alias("venue"), clean_html(_text(v, "$.description.main")).alias("citation"),
        clean_html(_text(v, "$.publisher.title.ru")).alias("publisher"),
        link("DOI").alias("doi_url"), link("DOCUMENT").alias("document_url"), link("OTHER_URL").alias("external_url"), link("COVER").alias("cover_url"),
        role_authors(v, ["cmn_editor", "resp_editor", "sci_editor"], portal).alias("editors"),
        role_authors(v, ["translator", "trn_editor"], portal).alias("translators"))


def authorships_from_json(items: DataFrame, raw: str = "raw", portal: str = "https://portal.example.org") -> DataFrame:
    """One row an author, keeping the place in the list; entries that are not objects leave a gap."""
    v = F.try_parse_json(F.col(raw))
    each = items.select(_text(v, "$.id").alias("publication_id"), F.posexplode(_entries(v, "author")).alias("position", "_a")).where(F.col("publication_id").isNotNull() & _is_object(F.col("_a")))
    return each.select("publication_id", _author(F.col("_a"), F.col("position"), portal, False).alias("a")).select("publication_id", "a.position", "a.person_id", "a.display_name", "a.display_name_en", "a.href", "a.is_hse_person")


def courses_from_items(items: DataFrame) -> DataFrame:
    """Course items (person_id, title, url, academic_year, language, meta); the level is the text before the first semicolon."""
    level = blank_to_null(strip(F.split_part(F.col("meta"), F.lit(";"), F.lit(1))))
    return items.select("person_id", F.coalesce("title", F.lit("")).alias("title"), "url", "academic_year", "language", level.alias("level"), F.col("meta").alias("raw_meta"))


def theses_from_json(items: DataFrame, raw: str = "raw") -> DataFrame:
    """One row a thesis; the id must be a whole number and the title not blank."""
    v = F.col("_v")
    rows = items.select(F.col(raw).alias("raw"), F.try_parse_json(F.col(raw)).alias("_v"))
    whole = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "BIGINT", F.lit(False))
    title = strip(F.coalesce(_text(v, "$.title"), F.lit("")))
    return rows.where(whole("$.id") & (title != "")).select(
        F.try_variant_get(v, "$.id", "bigint").alias("thesis_id"), title.alias("title"), F.when(whole("$.year"), F.try_variant_get(v, "$.year", "int")).alias("year"),
        _text(v, "$.level").alias("level"), _text(v, "$.student").alias("student"), _text(v, "$.learnProgram.title").alias("program"), _text(v, "$.learnProgram.url").alias("program_url"),
        _text(v, "$.orgUnit.title").alias("org_unit"), F.coalesce(F.try_variant_get(v, "$.hasEnVersion", "boolean"), F.lit(False)).alias("has_en_version"), "raw")


def supervisors_from_json(items: DataFrame, raw: str = "raw") -> DataFrame:
    """(thesis_id, person_id, display_name) of the supervisors with a profile address."""
    v = F.try_parse_json(F.col(raw))
    each = items.select(F.try_variant_get(v, "$.id", "bigint").alias("thesis_id"), F.explode(F.try_variant_get(v, "$.supervisors", "array<variant>")).alias("_s"))
    return each.select("thesis_id", supervisor_id_from_url(_text(F.col("_s"), "$.url")).alias("person_id"), _text(F.col("_s"), "$.name").alias("display_name")).where("thesis_id is not null and person_id is not null")


def persons_from_pages(parsed: DataFrame, campus: Column | None = None) -> DataFrame:
    """Person rows from parsed pages, with the nested columns flattened to what is stored."""
    joined = lambda *parts: F.concat_ws(": ", *parts)
    return parsed.where("person_id is not null").select(
        "person_id", "full_name", "avatar", F.col("url").alias("profile_url"), primary_unit(F.col("positions")).alias("primary_unit"),
        (campus if campus is not None else F.lit(None).cast("string")).alias("campus_id"), "languages", "positions", "contacts",
        F.struct(F.col("managers")).alias("relations"),
        F.struct(F.col("degrees"), F.transform("extra_education", lambda e: joined(e["year"].cast("string"), e["text"])).alias("extra_education")).alias("education"),
        F.col("notes").alias("bio_notes"), "awards", "work_experience",
        F.transform("interests", lambda i: i["label"]).alias("interests"),
        F.transform("grants", lambda g: F.struct(g["text"].alias("title"), F.coalesce(g["years"]["end"], g["years"]["start"]).alias("year"), F.lit(None).cast("string").alias("role"))).alias("grants"),
        F.transform("editorial_staff", lambda e: e["text"]).alias("editorial_staff"),
        F.transform("conferences", lambda c: joined(c["year"].cast("string"), c["description"])).alias("conferences"),
        "research_ids", "patents")


def publications_total(items: DataFrame, person: str = "person_id", raw: str = "raw") -> DataFrame:
    """Per person, how many of their items list them among the authors; each item counts once."""
    v = F.try_parse_json(F.col(raw))
    listed = F.exists(_entries(v, "author"), lambda a: F.coalesce(_text(a, "$.id") == F.col(person).cast("string"), F.lit(False)))
    return items.groupBy(person).agg(F.count_if(listed).cast("int").alias("publications_total"))


# --- upserts ---------------------------------------------------------------------


def last_per_key(df: DataFrame, keys: list[str], arrival: Column) -> DataFrame:
    """Of rows with equal key the one that arrived last."""
    w = Window.partitionBy(*keys).orderBy(arrival.desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], *, keep_first: tuple[str, ...] = (), insert_only: tuple[str, ...] = ()) -> DataFrame:
    """Insert, or on an equal key overwrite the columns that incoming has.

    Columns only the current table has survive.  keep_first: the stored value wins
    unless null.  insert_only: written when the row is new, then never changed.
    Incoming must have one row a key (`last_per_key`).
    """
    a = current.withColumn("_old", F.lit(True)).alias("a")
    b = incoming.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, keys, "full_outer")
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in incoming.columns:
            out.append(F.col(f"a.{c}"))
        elif c in keep_first:
            out.append(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c))
        elif c in insert_only:
            out.append(F.when(F.col("a._old"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(*out)


def upsert_persons(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """campus, extracted interests and embedding are not part of a re-scraped row and survive it."""
    return upsert(current, incoming.drop("campus_id") if "campus_id" in incoming.columns and incoming.schema["campus_id"].dataType.simpleString() == "void" else incoming, ["person_id"])


def upsert_publications(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current, incoming, ["id"])


def upsert_authorships(current: DataFrame, incoming: DataFrame, persons: DataFrame) -> DataFrame:
    """The first known person stays; name and address are written once; removed authors stay."""
    return upsert(current, known_persons(incoming, persons), ["publication_id", "position"], keep_first=("person_id",), insert_only=("display_name", "href"))


def upsert_theses(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(current, incoming, ["thesis_id"])


def upsert_supervisors(current: DataFrame, incoming: DataFrame, persons: DataFrame) -> DataFrame:
    """Links of known people only; links that vanished upstream stay."""
    known = incoming.join(persons.select("person_id"), "person_id", "left_semi").select(*incoming.columns)
    return upsert(current, known, ["thesis_id", "person_id"])


def known_persons(df: DataFrame, persons: DataFrame) -> DataFrame:
    """Ids that have no profile become null."""
    ids = persons.select(F.col("person_id").alias("_known"))
    return df.join(ids, F.col("person_id") == F.col("_known"), "left").withColumn("person_id", F.col("_known")).select(*df.columns)


def replace_by_person(current: DataFrame, incoming: DataFrame, persons: DataFrame) -> DataFrame:
    """All rows of the given persons are replaced by the incoming ones."""
    return current.join(persons.select("person_id").distinct(), "person_id", "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


def with_course_ids(df: DataFrame, order: Column) -> DataFrame:
    """Surrogate ids that rise with (person, order); stable within a snapshot, not gapless, and no task sees all rows."""
    return df.orderBy("person_id", order).withColumn("id", F.monotonically_increasing_id())


def write_back(table: DataFrame, enriched: DataFrame, key: str, columns: list[str], reset: Column | None = None) -> DataFrame:
    """Replaces columns by enriched values; rows where `reset` holds lose them, others keep theirs."""
    e = enriched.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(e, F.col(key) == F.col("_k"), "left")
    pick = lambda c: F.when(F.col("_k").isNotNull(), F.col(f"_{c}")).otherwise(F.when(reset, F.lit(None)).otherwise(F.col(c)) if reset is not None else F.col(c))
    return joined.withColumns({c: pick(c) for c in columns}).select(*table.columns)


def sync_columns(target: DataFrame, source: DataFrame, key: str, columns: list[str], lead: str) -> DataFrame:
    """Copies columns where the source's `lead` is set; target-only rows stay, source-only rows are ignored."""
    return write_back(target, source.where(F.col(lead).isNotNull()), key, columns)
