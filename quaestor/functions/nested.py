"""Predicates and projections over nested arrays; all row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestor.functions.lexicon import TEACHER_TITLE
from quaestor.functions.text import strip


def teaches(positions: Column) -> Column:
    """Whether any position's title is a teaching or research one."""
    return F.coalesce(F.exists(positions, lambda p: F.coalesce(F.lower(p["title"]).rlike(TEACHER_TITLE), F.lit(False))), F.lit(False))


def works_in(positions: Column, unit: str) -> Column:
    """Whether any unit of any position has a name like `unit` (% and _ are wildcards)."""
    from quaestor.functions.text import like_pattern

    pattern = like_pattern(unit.lower())
    inside = lambda p: F.coalesce(F.exists(p["units"], lambda u: F.coalesce(F.lower(u["name"]).like(pattern), F.lit(False))), F.lit(False))
    return F.coalesce(F.exists(positions, inside), F.lit(False))


def has_language(languages: Column, one: str) -> Column:
    return F.coalesce(F.array_contains(languages, one), F.lit(False))


def unit_names(positions: Column) -> Column:
    units = F.flatten(F.filter(F.transform(positions, lambda p: p["units"]), lambda u: u.isNotNull()))
    return F.filter(F.transform(units, lambda u: strip(u["name"])), lambda n: n.isNotNull() & (n != ""))


def extra_units(positions: Column, primary: Column) -> Column:
    """Distinct unit names in order of appearance, without the primary unit."""
    own = strip(F.coalesce(primary, F.lit("")))
    return F.array_distinct(F.filter(unit_names(positions), lambda n: n != own))


def primary_unit(positions: Column) -> Column:
    return F.get(F.get(positions, F.lit(0))["units"], F.lit(0))["name"]


def matched_topics(query: str, stated: Column, extracted: Column) -> Column:
    """Up to six topics that hold a word of the query; extracted ones only where the stated are fewer than three."""
    words = [w.lower() for w in query.split() if len(w) > 2]
    if not words:
        return F.array().cast("array<string>")
    empty = F.array().cast("array<string>")

    def hits(c: Column) -> Column:
        def one(t: Column) -> Column:
            out = F.lit(False)
            for w in words:
                out = out | F.lower(t).contains(w)
            return F.coalesce(out, F.lit(False))

        return F.filter(F.coalesce(c, empty), one)

    raw = hits(stated)
    fresh = F.filter(hits(extracted), lambda t: ~F.exists(raw, lambda r: F.lower(r).contains(F.lower(t)) | F.lower(t).contains(F.lower(r))))
    return F.when(F.size(raw) >= 3, F.slice(raw, 1, 6)).otherwise(F.slice(F.concat(raw, fresh), 1, 6))
