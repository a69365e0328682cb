"""Text contexts, keyphrases and embeddings of people and publications.

Contexts, candidate filters and ranking are Column work.  Models are interfaces:
the defaults are a deterministic hashing embedder, an identity lemmatiser and no
recognised entities; anything with the same signature can take their place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions import lexicon
from quaestor.functions.text import (
    names_organisation, normal_tag, numeric_ratio, strip, topical_unit, without_substrings, word_ngrams)

# --- contexts --------------------------------------------------------------------


def _lines(titles: Column, glue: str, distinct: bool = False) -> Column:
    """Non-blank stripped texts joined; null if there are none."""
    t = F.filter(F.transform(titles, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    t = F.array_distinct(t) if distinct else t
    return F.when(F.size(t) > 0, F.array_join(t, glue))


def publication_context(title: Column, abstract_ru: Column, abstract_en: Column, venue: Column) -> Column:
    none_if_blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n\n", none_if_blank(strip(title)), F.coalesce(none_if_blank(abstract_ru), none_if_blank(abstract_en)), none_if_blank(venue))


def ordered_titles(rows: DataFrame, key: str, order: list[Column], title: str, limit: int, name: str) -> DataFrame:
    """(key, array of the first `limit` titles in order).  The window prunes to the limit before it shuffles."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.where(F.col(key).isNotNull()).select(key, title, F.row_number().over(w).alias("_r")).where(F.col("_r") <= limit)
    packed = F.array_sort(F.collect_list(F.struct("_r", title)))
    return numbered.groupBy(key).agg(F.transform(packed, lambda x: x[title]).alias(name))


def newest_titles(rows: DataFrame, key: str, newest: str, number: str, title: str, limit: int, name: str) -> DataFrame:
    """(key, array of the first `limit` distinct non-blank titles), by `newest` descending (null last), then `number`."""
    best = F.max(F.struct(F.col(newest), (-F.col(number)).alias("n")))
    one = rows.where(F.col(key).isNotNull()).select(key, newest, number, strip(F.col(title)).alias("t")).where("t <> ''").groupBy(key, "t").agg(best.alias("b"))
    return ordered_titles(one, key, [F.col("b").desc()], "t", limit, name)


def person_contexts(persons: DataFrame, publications: DataFrame, authorships: DataFrame, courses: DataFrame, theses: DataFrame, supervisors: DataFrame) -> DataFrame:
    """(person_id, full_name, context): name, unit, interests, titles of 50 theses, 30 publications and all courses, cut at the context length."""
    desc = lambda c: F.col(c).desc_nulls_last()
    links = authorships.where("person_id is not null").select("person_id", F.col("publication_id").alias("id")).distinct()
    pubs = ordered_titles(links.join(publications.select("id", "title", "year").dropDuplicates(["id"]), "id"), "person_id", [desc("year"), F.col("id")], "title", 30, "_pubs")
    works = supervisors.select("person_id", "thesis_id").distinct().join(theses.select("thesis_id", "title", "year"), "thesis_id")
    works = ordered_titles(works, "person_id", [desc("year"), F.col("thesis_id")], "title", 50, "_theses")
    # a title and what parts it from the next are two characters at least, so more titles than this are cut off anyway
    lessons = newest_titles(courses, "person_id", "academic_year", "id", "title", lexicon.CONTEXT_CHARS // 2 + 1, "_courses")
    p = persons.select("person_id", "full_name", topical_unit(F.col("primary_unit")).alias("_unit"), "interests")
    joined = p.join(works, "person_id", "left").join(pubs, "person_id", "left").join(lessons, "person_id", "left")
    text = F.concat_ws("\n\n", "full_name", F.nullif("_unit", F.lit("")), _lines(F.col("interests"), "; "), _lines(F.col("_theses"), "; ", True), _lines(F.col("_pubs"), " "), _lines(F.col("_courses"), "\n", True))
    return joined.select("person_id", "full_name", F.substring(text, 1, lexicon.CONTEXT_CHARS).alias("context"))


# --- keyphrases ------------------------------------------------------------------

Lemmatiser = Callable[[str], str]


def lemmatised(c: Column, lemmatise: Lemmatiser | None = None) -> Column:
    """Tags in their base form; without a lemmatiser they stay as they are."""
    if lemmatise is None:
        return c

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return s.map(lambda t: known.setdefault(t, lemmatise(t)) if isinstance(t, str) else None)

    return run(c)


def filter_tags(tags: DataFrame, key: str, tag: str = "tag", person_name: str | None = None, rejects: str | None = None, lemmatise: Lemmatiser | None = None) -> DataFrame:
    """(key, tag): tags that survive the rules, normalised; one row a candidate in and at most one out.

    The rules run from cheap to dear, each on the normalised form: years of service,
    the heading "интересы", the person's own names, organisations, recognised names,
    service words and years in front, mostly digits, stock phrases, too short, stop words.
    """
    t = F.col("_t")
    base = F.regexp_replace(normal_tag(lemmatised(F.col(tag), lemmatise)), r"\s*-\s*", "-")
    rows = tags.where(F.length(strip(F.coalesce(F.col(tag), F.lit("")))) > 0).withColumn("_t", base).where(~t.rlike(r"(?iuU)^стаж\s*\d"))
    rows = rows.withColumn("_t", strip(F.regexp_replace(t, r"(?iuU)^интерес[ыа]?\s+", "")))
    if person_name:
        own = F.filter(F.transform(F.split(F.lower(person_name), r"(?U)\s+"), lambda w: F.regexp_replace(w, rf"^[{re.escape(lexicon.EDGE_SIGNS)}]+|[{re.escape(lexicon.EDGE_SIGNS)}]+$", "")), lambda w: F.length(w) > 3)
        rows = rows.where(~F.coalesce(F.exists(own, lambda w: t.contains(w)), F.lit(False)))
    rows = rows.where(~names_organisation(t))
    if rejects:
        rows = rows.where(~F.coalesce(F.exists(rejects, lambda r: (r != "") & t.contains(F.lower(r))), F.lit(False)))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    stop = F.array(*[F.lit(x) for x in (*lexicon.STOP_RU, *lexicon.STOP_EN)])
    first = F.get(words, F.lit(0))
    rows = rows.where((F.size(words) > 0) & (F.length(first) >= 3) & ~first.isin(*lexicon.SERVICE_FIRST))
    rows = rows.where(~t.rlike(r"(?U)^(?:19|20)\d{2}\b") & (numeric_ratio(t) < 0.4) & ~t.rlike("|".join(map(re.escape, lexicon.JUNK))))
    rows = rows.where((F.length(t) >= 4) & F.exists(words, lambda w: F.length(w) >= 4) & ~F.forall(words, lambda w: F.array_contains(stop, w)) & ~F.array_contains(stop, t))
    return rows.select(key, F.col("_t").alias("tag"))


def rank_tags(candidates: DataFrame, key: str, max_tags: int = lexicon.MAX_TAGS, person_name: str | None = None, rejects: str | None = None, lemmatise: Lemmatiser | None = None, corrected: bool = False) -> DataFrame:
    """(key, tags): candidates (key, tag, score) merged by highest score, filtered, ranked, cut.

    A tag that the lemmatiser changes has no score of its own and ranks as 0, by length;
    corrected=True ranks it by the score of the form it came from.  person_name and
    rejects name columns of the candidates that are the same for all rows of a key.
    """
    extra = [x for x in (person_name, rejects) if x]
    merged = candidates.withColumn("tag", normal_tag(F.col("tag"))).where("tag <> ''").groupBy(key, "tag", *extra).agg(F.max("score").alias("score"))
    rows = merged.withColumn("_row", F.struct(F.col(key), F.col("score"), F.col("tag").alias("was")))
    kept = filter_tags(rows, "_row", "tag", person_name, rejects, lemmatise)
    kept = kept.select(F.col(f"_row.{key}").alias(key), "tag", F.when(F.lit(corrected) | (F.col("tag") == F.col("_row.was")), F.col("_row.score")).otherwise(0.0).alias("score"))
    per = kept.groupBy(key, "tag").agg(F.max("score").alias("score")).groupBy(key).agg(F.collect_list(F.struct("tag", "score")).alias("_a"))
    names = without_substrings(F.transform("_a", lambda x: x["tag"]))
    order = F.array_sort(F.transform(names, lambda n: F.struct((-F.element_at(F.map_from_entries(F.col("_a")), n)).alias("s"), (-F.length(n)).alias("l"), n.alias("t"))))
    return per.select(key, F.slice(F.transform(order, lambda x: x["t"]), 1, max_tags).alias("tags"))


def ngram_candidates(df: DataFrame, key: str, text: str, longest: int = 4) -> DataFrame:
    """(key, tag, score): word runs of 1 to `longest`, scored by how often they come and how long they are."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}-]+"), lambda w: F.length(w) > 1)
    runs = F.flatten(F.array(*[word_ngrams(F.col("_w"), n) for n in range(1, longest + 1)]))
    each = df.select(key, words.alias("_w")).select(key, F.explode(runs).alias("tag"))
    n = F.size(F.split("tag", " "))
    return each.groupBy(key, "tag").agg(F.count("*").alias("_n")).withColumn("score", F.least(F.lit(1.0), F.col("_n") * (0.2 + 0.1 * n))).drop("_n")


def embedded_candidates(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], object], top: int, longest: int = 4, diversity: float = 0.5) -> DataFrame:
    """(key, tag, score): the `top` word runs of each text by maximal marginal relevance; the score is the cosine with the whole text."""
    import numpy as np

    out = T.StructType([df.schema[key], T.StructField("tag", T.StringType()), T.StructField("score", T.DoubleType())])

    def unit(x) -> np.ndarray:
        x = np.asarray(x, np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                words = [w for w in re.split(r"(?:[^\w-]|_)+", t.lower()) if len(w) > 1]
                runs = list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)))
                if runs:
                    v = unit(embedder(runs))
                    score = v @ unit(embedder([t]))[0]
                    rows += [(k, runs[i], float(score[i])) for i in mmr(v, score, top, diversity)]
            yield pd.DataFrame(rows, columns=[key, "tag", "score"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, out)


def extract_topics(df: DataFrame, key: str, text: str, max_tags: int = lexicon.MAX_TAGS, person_name: str | None = None, rejects: str | None = None, lemmatise: Lemmatiser | None = None,
                   embedder: Callable[[list[str]], object] | None = None, entities: str | None = None) -> DataFrame:
    """(key, tags) of every row; texts shorter than 50 characters have none.

    person_name: column with the name of the person the text is about; rejects: column
    with an array of recognised names that are no topics; entities: column with an array
    of recognised entities that are candidates with a score of their own; embedder: then
    candidates are scored by their likeness to the text and chosen for variety, else by
    how often they come and how long they are.
    """
    extra = [x for x in (person_name, rejects) if x]
    long = df.where(F.length(text) >= 50)
    # as many candidates as a keyphrase model would hand over: twice the tags wanted
    if embedder is not None:
        found = embedded_candidates(long, key, text, embedder, 2 * max_tags)
    else:
        best = Window.partitionBy(key).orderBy(F.col("score").desc(), F.length("tag").desc(), "tag")
        found = ngram_candidates(long, key, text).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= 2 * max_tags).drop("_r")
    if entities:
        found = found.unionByName(long.select(key, F.explode(entities).alias("tag"), F.lit(lexicon.ENTITY_SCORE).alias("score")))
    if extra:
        found = found.join(df.select(key, *extra), key)
    ranked = rank_tags(found, key, max_tags, person_name, rejects, lemmatise)
    return df.select(key).join(ranked, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def mmr(vectors, scores, top: int, diversity: float = 0.5) -> list[int]:
    """Maximal marginal relevance over a few unit vectors: indices in the order chosen."""
    import numpy as np

    v, s = np.asarray(vectors, float), np.asarray(scores, float)
    chosen: list[int] = []
    while len(chosen) < min(top, len(s)):
        near = (v @ v[chosen].T).max(1) if chosen else np.zeros(len(s))
        value = (1 - diversity) * s - diversity * near
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return chosen


# --- embeddings ------------------------------------------------------------------


def hash_embed(texts: list[str], dim: int = lexicon.DIMENSIONS):
    """Signed feature hashing of words and character trigrams, to unit length.  Lexical only: it knows no meaning."""
    import numpy as np
    import xxhash

    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            padded = f"^{w}$"
            for f, x in [(w, 1.0), *((padded[j : j + 3], 0.4) for j in range(len(padded) - 2))]:
                h = xxhash.xxh64_intdigest(f)
                out[i, h % dim] += x if h >> 63 else -x
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embed(c: Column, embedder: Callable[[list[str]], object] = hash_embed) -> Column:
    """Embeddings by Arrow batches of 64 texts; null for null or blank text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vectors: list = []
            texts = ["" if not isinstance(x, str) else x for x in s]
            for a in range(0, len(texts), 64):
                vectors += list(embedder(texts[a : a + 64]))
            yield pd.Series([list(map(float, v)) if t.strip() else None for t, v in zip(texts, vectors)])

    return run(c)


def enrich_persons(contexts: DataFrame, gate: int = lexicon.CONTEXT_GATE, embedder: Callable = hash_embed) -> DataFrame:
    """(person_id, interests_extracted, embedding) of contexts (person_id, full_name, context); those below the gate get [] and null."""
    long = F.length("context") >= gate
    topics = extract_topics(contexts.where(long), "person_id", "context", person_name="full_name")
    rows = contexts.select("person_id", F.when(long, F.col("context")).alias("_c")).join(topics, "person_id", "left")
    return rows.select("person_id", F.coalesce("tags", F.array().cast("array<string>")).alias("interests_extracted"), embed(F.col("_c"), embedder).alias("embedding"))
