"""Orderings, pages and totals."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Null places are explicit: ascending keys put nulls last, descending ones first.
PERSON_ORDERINGS = {
    "full_name": lambda: [F.col("full_name").asc_nulls_last()],
    "-full_name": lambda: [F.col("full_name").desc_nulls_first()],
    "publications_total": lambda: [F.col("publications_total").asc_nulls_last()],
    "-publications_total": lambda: [F.col("publications_total").desc_nulls_first()],
}
PUBLICATION_ORDERINGS = {
    "year": lambda: [F.col("year").asc_nulls_last()],
    "-year": lambda: [F.col("year").desc_nulls_first()],
    "created_at": lambda: [F.col("created_at").asc_nulls_last()],
    "-created_at": lambda: [F.col("created_at").desc_nulls_first()],
}


def ordering(known: dict, name: str, tie: str, default: str | None = None) -> list[Column]:
    """Columns of a listed ordering with its tie-break; an unknown name raises, or means `default`."""
    if name not in known:
        if default is None:
            raise ValueError(f"unknown ordering {name!r}")
        name = default
    return [*known[name](), F.col(tie).asc()]


@dataclass
class Page:
    rows: DataFrame
    count: int
    page: int
    page_size: int

    @property
    def last_page(self) -> int:
        return max(1, math.ceil(self.count / self.page_size))

    @property
    def next_page(self) -> int | None:
        return self.page + 1 if self.page < self.last_page else None

    @property
    def previous_page(self) -> int | None:
        return self.page - 1 if self.page > 1 else None


def page_of(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page; plans as TakeOrderedAndProject."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def paginate(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> Page:
    """A page with its total; the total is counted without the ordering."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page from 1, page_size from 1 to 100")
    return Page(page_of(df, order, page, page_size), df.count(), page, page_size)


def page_links(url: str, page: Page) -> tuple[str | None, str | None]:
    """Next and previous addresses; only the page parameter changes."""
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    def at(n: int | None) -> str | None:
        if n is None:
            return None
        s = urlsplit(url)
        pairs = [(k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if k != "page"]
        return urlunsplit(s._replace(query=urlencode([*pairs, ("page", str(n))])))

    return at(page.next_page), at(page.previous_page)


def one_more(df: DataFrame, order: list[Column], page: int, page_size: int, cap: int = 10) -> tuple[DataFrame, bool]:
    """A page and whether another follows, by asking for one row more; no page after `cap`."""
    page = min(max(1, page), cap)
    probe = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size + 1)
    more = probe.count() > page_size and page < cap
    return page_of(df, order, page, page_size), more


def concatenated_page(parts: list[tuple[DataFrame, list[Column]]], page: int, page_size: int) -> DataFrame:
    """One window over several ordered results laid end to end."""
    every = None
    for rank, (df, order) in enumerate(parts):
        keys = df.withColumns({"_rank": F.lit(rank), "_key": F.lit(0)})
        # Only the rows that can reach the page take part, so each part is a top-k.
        from pyspark.sql import Window

        top = keys.orderBy(*order).limit(page * page_size)
        top = top.withColumn("_key", F.row_number().over(Window.partitionBy("_rank").orderBy(*order)))
        every = top if every is None else every.unionByName(top, allowMissingColumns=True)
    totals = every.orderBy("_rank", "_key").offset((page - 1) * page_size).limit(page_size)
    return totals.drop("_rank", "_key")
