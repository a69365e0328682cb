"""Optional filters, joined by AND.  An argument that is not given adds nothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import all_of


def equals(column: str, value) -> list[Column]:
    """Equality; '' and None mean no filter."""
    return [F.col(column) == F.lit(value)] if value not in (None, "") else []


def between(column: str, low=None, high=None) -> list[Column]:
    """Inclusive range; 0 is a bound, null rows drop out."""
    return [*([F.col(column) >= F.lit(low)] if low is not None else []), *([F.col(column) <= F.lit(high)] if high is not None else [])]


def since(column: str, moment) -> list[Column]:
    return [F.col(column) >= F.lit(moment)] if moment is not None else []


def has_publications(flag: bool | str | None, column: str = "publications_total") -> list[Column]:
    """True: some, False: none, None: either; the texts "true" and "false" also work."""
    if isinstance(flag, str):
        flag = {"true": True, "false": False}.get(flag.lower())
    return [] if flag is None else [F.col(column) > 0 if flag else F.col(column) == 0]


def where_all(df: DataFrame, *parts: Iterable[Column]) -> DataFrame:
    conditions = [c for p in parts for c in p]
    return df.where(all_of(conditions)) if conditions else df


def after_key(df: DataFrame, key: str, last, n: int) -> DataFrame:
    """Keyset page: the n rows after `last` in key order."""
    return (df.where(F.col(key) > F.lit(last)) if last is not None else df).orderBy(key).limit(n)


def check_range(name: str, value: int | None, low: int, high: int) -> None:
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")


def check_query(q: str | None, least: int = 2) -> None:
    if q is None or len(q) < least:
        raise ValueError(f"the query needs {least} characters")
