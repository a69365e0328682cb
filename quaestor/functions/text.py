"""String operators as Column expressions.

Patterns carry (?U) so that \\s, \\w, \\b and letter classes cover Unicode.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestor.functions import lexicon


def clean_whitespace(c: Column) -> Column:
    """Runs of white space become one space, ends are stripped; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """As clean_whitespace, but null and '' give null."""
    return F.when(F.length(c) > 0, clean_whitespace(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """White space of every kind off both ends (trim alone takes only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def person_id_from_url(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, r"/(?:staff|org/persons)/(\d+)", 1)).try_cast("bigint")


def supervisor_id_from_url(url: Column) -> Column:
    """Narrower than person_id_from_url: only /org/persons/<id>."""
    return blank_to_null(F.regexp_extract(url, r"/org/persons/(\d+)", 1)).try_cast("bigint")


def numeric_tail(url: Column) -> Column:
    """Last path segment of a URL if it is a number."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    return blank_to_null(F.regexp_extract(path, r"/(\d+)$", 1)).try_cast("bigint")


def absolutize(url: Column, base: str) -> Column:
    u = blank_to_null(url)
    return F.when(u.rlike(r"^https?://"), u).when(u.startswith("/"), F.concat(F.lit(base), u)).otherwise(F.concat(F.lit(base + "/"), u))


def position_titles(raw: Column) -> Column:
    """'A, B, C:' to ['A', 'B', 'C']; blanks are dropped."""
    text = F.regexp_replace(clean_whitespace(raw), r"[:]*[,]*\s*$", "")
    one = lambda x: F.regexp_replace(clean_whitespace(x), ":+$", "")
    return F.filter(F.transform(F.split(text, ","), one), lambda x: x != "")


def phone_list(raw: Column) -> Column:
    return F.filter(F.transform(F.split(clean_whitespace(raw), r"[,|;/]"), clean_whitespace), lambda x: x != "")


def lenient_csv(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), strip), lambda x: x != "")


def like_pattern(q: str, escape: bool = False) -> str:
    """Pattern for a case-insensitive search of q anywhere.

    % and _ in q act as wildcards, as in the reference's behaviour; escape=True makes
    them ordinary.  A backslash before an ordinary character stands for itself.
    """
    if escape:
        return "%" + re.sub(r"([\\%_])", r"\\\1", q) + "%"
    return "%" + re.sub(r"\\(?![\\%_])", r"\\\\", q) + "%"


def contains_ci(c: Column, q: str, escape: bool = False) -> Column:
    return c.ilike(like_pattern(q, escape))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, one)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(0.0)


def script_language(c: Column) -> Column:
    """ru, en or mixed by the share of Cyrillic letters; ru if there are no letters."""
    cyr, lat = F.regexp_count(c, F.lit("[А-Яа-яЁё]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    share = cyr / (cyr + lat)
    return F.when(cyr + lat == 0, "ru").when(share > 0.8, "ru").when(share < 0.2, "en").otherwise("mixed")


def normal_tag(c: Column) -> Column:
    edge = re.escape(lexicon.EDGE_SIGNS)
    body = F.regexp_replace(strip(F.lower(c)), f"^[{edge}]+|[{edge}]+$", "")
    return clean_whitespace(F.translate(body, "ё", "е"))


def numeric_ratio(c: Column) -> Column:
    """Share of digits and date signs, with the lengths of year abbreviations on top."""
    plain = F.length(c) - F.length(F.translate(c, "0123456789 .,–—-/", ""))
    years = F.aggregate(F.regexp_extract_all(c, F.lit(r"((?iuU)\bгг?\.?\b)"), F.lit(1)), F.lit(0), lambda n, x: n + F.length(x))
    return F.when(F.length(c) > 0, (plain + years) / F.length(c)).otherwise(0.0)


def names_organisation(c: Column) -> Column:
    """Whether a tag holds one of the organisation stems; the shortest only as whole words."""
    short = "|".join(x for x in lexicon.ORGANISATION if len(x) < 4)
    long = "|".join(x for x in lexicon.ORGANISATION if len(x) >= 4)
    return c.rlike(rf"(?U)\b(?:{short})\b|{long}")


def word_ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def without_substrings(tags: Column) -> Column:
    """Distinct tags, longest first, without those contained in a longer one."""
    order = F.array_sort(F.transform(F.array_distinct(tags), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    keep = lambda kept, x: F.when(F.exists(kept, lambda k: k.contains(x["t"])), kept).otherwise(F.array_append(kept, x["t"]))
    return F.aggregate(order, F.array().cast("array<string>"), keep)


def topical_unit(c: Column) -> Column:
    """A unit's name without its kind in front and without the person it is named after."""
    head = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), rf"(?iuU)^(?:{lexicon.UNIT_KINDS})\s+", "")
    text = strip(F.regexp_replace(head, r"(?U)\s+им(?:ени)?\.?\s+(?:[А-ЯЁ]\.\s*){0,2}[А-ЯЁ][а-яё]+\S*$", ""))
    return F.when(F.lower(text).isin(*lexicon.UNIT_IGNORED), "").otherwise(text)


_CAPITALISED = re.compile(r"[А-ЯЁ](?:[а-яё]+\.?|\.(?:[А-ЯЁ]\.)?)")


def looks_like_name(q: str) -> bool:
    """Whether a query has the shape of a personal name: up to three capitalised words or initials, or one lower-case word."""
    words = q.split()
    if not 1 <= len(words) <= 3:
        return False
    if all(_CAPITALISED.fullmatch(w) for w in words):
        return True
    return len(words) == 1 and bool(re.fullmatch(r"[а-яё]{4,}", words[0]))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def grouped_number(c: Column) -> Column:
    """1234567 as '1 234 567'."""
    return F.translate(F.format_number(c, 0), ",", " ")


def display_time(c: Column, seconds: bool = False) -> Column:
    return F.coalesce(F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")) if seconds else F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("—"))
