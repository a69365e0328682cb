"""Schemas of the stored tables by version, and of the public results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions.lexicon import JOB_STATES, PUBLICATION_TYPES

AUTHOR = "struct<person_id:bigint,display_name:string,display_name_en:string,href:string,is_hse_person:boolean,position:int>"
POSITIONS = "array<struct<title:string,units:array<struct<name:string,url:string>>>>"
CELL = "struct<text:string,url:string>"

#: Table, column, type, version that brought it, value in rows that are older (None: null).
COLUMNS: dict[str, list[tuple[str, str, int, object]]] = {
    "campuses": [("campus_id", "string", 1, None), ("campus_name", "string", 1, None)],
    "persons": [
        ("person_id", "bigint", 1, None), ("full_name", "string", 1, None), ("avatar", "string", 1, None), ("profile_url", "string", 1, None),
        ("primary_unit", "string", 1, None), ("campus_id", "string", 1, None), ("publications_total", "int", 1, 0),
        ("languages", "array<string>", 1, []), ("contacts", "struct<phones:string,address:string,hours:string,timetable_url:string>", 1, None),
        ("positions", POSITIONS, 1, []), ("relations", "struct<managers:array<struct<person_id:bigint,name:string,url:string,role:string>>>", 1, None),
        ("education", "struct<degrees:array<struct<year:int,text:string>>,extra_education:array<string>>", 1, None),
        ("work_experience", "array<string>", 1, []), ("awards", "array<string>", 1, []), ("interests", "array<string>", 1, []),
        ("grants", "array<struct<title:string,year:int,role:string>>", 1, []), ("editorial_staff", "array<string>", 1, []), ("conferences", "array<string>", 1, []),
        ("research_ids", "map<string,string>", 1, {}), ("bio_notes", "array<string>", 1, []),
        ("patents", f"array<struct<title:string,kind:string,number:{CELL},registration:{CELL},authors:array<string>,year:int>>", 2, []),
        ("interests_extracted", "array<string>", 3, []), ("embedding", "array<float>", 3, None), ("parsed_at", "timestamp", 1, None)],
    "publications": [
        ("id", "string", 1, None), ("title", "string", 1, None), ("type", "string", 1, "OTHER"), ("year", "int", 1, None), ("language", "string", 1, None), ("url", "string", 1, None),
        ("created_at", "timestamp", 1, None), ("raw", "string", 1, None), ("topics", "array<string>", 3, []), ("embedding", "array<float>", 3, None),
        *[(c, "string", 4, None) for c in ("abstract_ru", "abstract_en", "venue", "citation", "publisher", "doi_url", "document_url", "external_url", "cover_url")],
        ("editors", f"array<{AUTHOR}>", 4, []), ("translators", f"array<{AUTHOR}>", 4, []), ("ingested_at", "timestamp", 1, None)],
    "authorships": [("publication_id", "string", 1, None), ("position", "int", 1, None), ("person_id", "bigint", 1, None), ("display_name", "string", 1, None), ("display_name_en", "string", 4, None), ("href", "string", 1, None), ("is_hse_person", "boolean", 4, False)],
    "courses": [("id", "int", 1, None), ("person_id", "bigint", 1, None), *[(c, "string", 1, None) for c in ("title", "url", "academic_year", "language", "level", "raw_meta")]],
    "theses": [("thesis_id", "bigint", 5, None), ("title", "string", 5, None), ("year", "int", 5, None), *[(c, "string", 5, None) for c in ("level", "student", "program", "program_url", "org_unit")], ("has_en_version", "boolean", 5, False), ("raw", "string", 5, None)],
    "thesis_supervisors": [("thesis_id", "bigint", 5, None), ("person_id", "bigint", 5, None), ("display_name", "string", 5, None)],
}
LATEST = 5


def schema(name: str, version: int = LATEST) -> T.StructType:
    """Schema of a table as of a version; empty if the table came later."""
    cols = [f"`{c}` {t}" for c, t, v, _ in COLUMNS[name] if v <= version]
    return T.StructType.fromDDL(", ".join(cols)) if cols else T.StructType([])


def empty(spark: SparkSession, name: str, version: int = LATEST) -> DataFrame:
    return spark.createDataFrame([], schema(name, version))


def conform(df: DataFrame, name: str, version: int = LATEST) -> DataFrame:
    """A table in the columns of a version: missing ones get their default, others go.  Works up and down."""
    out = []
    for c, t, v, default in COLUMNS[name]:
        if v > version:
            continue
        if c in df.columns:
            out.append(F.col(c).cast(t).alias(c))
        elif default == {}:
            out.append(F.create_map().cast(t).alias(c))
        elif default == []:
            out.append(F.array().cast(t).alias(c))
        else:
            out.append(F.lit(default).cast(t).alias(c))
    return df.select(*out)


#: Public results: names and types, in order.
RESULTS = {
    "person_summary": "person_id bigint, full_name string, avatar string, profile_url string, primary_unit string, campus_id string, campus_name string, publications_total int",
    "publication": f"id string, title string, type string, year int, language string, url string, created_at timestamp, abstract_ru string, abstract_en string, venue string, citation string, publisher string, doi_url string, document_url string, external_url string, cover_url string, authors array<{AUTHOR}>, editors array<{AUTHOR}>, translators array<{AUTHOR}>",
    "search_hit": "kind string, key string, label string, score double",
}


def result(df: DataFrame, name: str) -> DataFrame:
    """Rows in the shape of a public result; columns that df lacks are null."""
    shape = T.StructType.fromDDL(RESULTS[name])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def as_json(df: DataFrame, name: str) -> DataFrame:
    """One JSON text a row, in the shape of a public result."""
    shaped = result(df, name)
    return shaped.select(F.to_json(F.struct(*shaped.columns), {"ignoreNullFields": "false"}).alias("json"))


PUBLICATION_TYPE, JOB_STATE = PUBLICATION_TYPES, JOB_STATES
