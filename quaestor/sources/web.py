"""Upstream sources: paginated and plain JSON services, page lists, and a crawl frontier.

Live reading goes through the Python Data Source API; stored responses are read as
JSON text.  The fetcher is a parameter, so tests and offline runs bring their own.
"""

from __future__ import annotations

import json
import logging
import re
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from quaestor.functions.html import tree

Fetch = Callable[[str, dict | None], str]
AGENT, TIMEOUT, PER_PAGE = "quaestor/1.0", 30, 50
#: Fixed value: the letters of the directory.
LETTERS = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"
log = logging.getLogger(__name__)


def http(url: str, payload: dict | None = None) -> str:
    """GET, or POST of JSON; raises for an error status."""
    body = None if payload is None else json.dumps(payload).encode()
    head = {"User-Agent": AGENT} | ({"Content-Type": "application/json"} if body else {})
    with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=TIMEOUT) as r:  # noqa: S310
        return r.read().decode()


def paged_items(fetch: Callable[[int], dict], max_pages: int | None = None) -> Iterator[dict]:
    """Items of all pages; ends when no more are announced, none remain, a page is empty, or max_pages is reached."""
    n = 0
    while max_pages is None or n < max_pages:
        n += 1
        result = fetch(n).get("result") or {}
        items = result.get("items") or []
        yield from items
        if not items or not result.get("more") or (result.get("remaining") is not None and result["remaining"] <= 0):
            return


def plain_items(answer: dict) -> list[dict]:
    """Items of an unpaged answer; none if it reports failure."""
    return list(answer.get("data") or []) if answer.get("success") else []


class _Part(InputPartition):
    def __init__(self, person_id: int):
        self.person_id = person_id


class PublicationSource(DataSource):
    """spark.read.format("quaestor_publications").options(url=..., ids="1,2,3").load(): a partition a person."""

    @classmethod
    def name(cls) -> str:
        return "quaestor_publications"

    def schema(self) -> str:
        return "person_id bigint, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]
        self.ids = [int(x) for x in options["ids"].split(",") if x.strip()]
        self.pages = int(options["max_pages"]) if "max_pages" in options else None

    def partitions(self):
        return [_Part(i) for i in self.ids]

    def read(self, part):
        ask = lambda n: json.loads(http(self.url, {"authorId": part.person_id, "page": n, "perPage": PER_PAGE}))
        yield from _tolerant(part.person_id, paged_items(ask, self.pages))


def _tolerant(person_id: int, items: Iterator[dict]) -> Iterator[tuple[int, str]]:
    """Items as JSON; a person whose service fails is left out from there on, with a warning, and the others go on."""
    try:
        for item in items:
            yield person_id, json.dumps(item, ensure_ascii=False)
    except (OSError, ValueError) as e:
        log.warning("no more items of %s: %s", person_id, e)


class ThesisSource(PublicationSource):
    """spark.read.format("quaestor_theses").options(url="https://.../{}", ids="1,2,3").load(): the theses a person supervises."""

    @classmethod
    def name(cls) -> str:
        return "quaestor_theses"

    def reader(self, schema) -> DataSourceReader:
        return _ThesisReader(self.options)


class _ThesisReader(_Reader):
    def read(self, part):
        def items():
            yield from plain_items(json.loads(http(self.url.format(part.person_id))))

        yield from _tolerant(part.person_id, items())


def fetch_pages(urls: DataFrame, fetch: Fetch = http) -> DataFrame:
    """Adds `html` to rows with a url; pages that can't be fetched are left out with a warning."""
    out = StructType([*urls.schema.fields, StructField("html", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(url: str) -> str | None:
            try:
                return fetch(url, None)
            except (OSError, ValueError) as e:
                log.warning("no page at %s: %s", url, e)
                return None

        for b in batches:
            b = b.assign(html=[one(u) for u in b["url"]])
            yield b[b["html"].notna()]

    return urls.mapInPandas(run, out)


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages of the paged service, one JSON document a file, as one row an item (raw)."""
    v = F.try_parse_json("value")
    return spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(v, "$.result.items", "array<variant>")).alias("_i")).select(F.to_json("_i").alias("raw"))


def stored_theses(spark: SparkSession, path: str) -> DataFrame:
    v = F.try_parse_json("value")
    ok = F.coalesce(F.try_variant_get(v, "$.success", "boolean"), F.lit(False))
    return spark.read.text(path, wholetext=True).where(ok).select(F.explode(F.try_variant_get(v, "$.data", "array<variant>")).alias("_i")).select(F.to_json("_i").alias("raw"))


def frontier(links: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Distinct addresses in the order first seen: links (url, ..., order) to one row a url, each with its first origin."""
    rest = [c for c in links.columns if c not in ("url", order)]
    first = F.min(F.struct(F.col(order), *rest)).alias("_f")
    seen = links.where("url is not null").groupBy("url").agg(first).select("url", *[F.col(f"_f.{c}").alias(c) for c in (order, *rest)])
    ordered = seen.orderBy(order)
    return ordered.limit(limit) if limit is not None else ordered


def letter_links(page: str, base: str, letters: str | None = None) -> list[tuple[str, str]]:
    """(url, letter) of the directory's letters, all of them unless some are named."""
    links = [(a.attrs.get("href"), a.text) for d in tree(page).find("div", "abc-filter__letter") for a in d.find("a")]
    return [(urljoin(base, href), letter) for href, letter in links if href and (not letters or letter in letters)]


def profile_links(page: str, base: str) -> list[str]:
    """Addresses of the profiles that a list page names, each once."""
    return list(dict.fromkeys(urljoin(base, a.attrs["href"]) for d in tree(page).find("div", "content__person-text") for a in d.find("a") if a.attrs.get("href")))


def of_unit(url: str, unit: str | None) -> str:
    """The address of a list page, narrowed to a unit if it has a place for one."""
    return re.sub(r"(?<=udept=)\d+", unit, url) if unit else url


def crawl_directory(spark: SparkSession, start: str, campus_ids: list[str] | None = None, letters: str | None = None, limit: int | None = None, fetch: Fetch = http) -> DataFrame:
    """(url, campus_id) of the profiles in the order in which a visit of every campus and letter first meets them.

    Without campuses the directory is visited once, unfiltered.  List pages that can't be fetched are skipped.
    """
    pages = [(of_unit(url, c), c) for c in campus_ids or [None] for url, _ in letter_links(fetch(start, None), start, letters)]
    rows = spark.createDataFrame([(n, u, c) for n, (u, c) in enumerate(pages)], "page int, url string, campus_id string")
    
    @F.pandas_udf("array<string>")
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: profile_links(x, start))

    links = fetch_pages(rows, fetch).select("campus_id", "page", F.posexplode(found("html")).alias("n", "url"))
    return frontier(links.select("url", "campus_id", F.struct("page", "n").alias("at")), "at", limit).select("url", "campus_id")


def visits(campuses: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Pages of the directory to visit: every campus with every letter (both are short fixed lists)."""
    return campuses.select("campus_id", F.posexplode(F.array(*[F.lit(x) for x in letters])).alias("_n", "letter"))


def enum_table(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "code string, label string")
