"""Profile pages to nested records.

The standard library's event parser builds a light tree that tolerates unclosed
elements; one table says where each section lies.  `parse_pages` runs as a single
mapInPandas stage; everything after it is Column work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from quaestor.functions.profile_text import (
    conference_fields, editorial_fields, experience_entries, grant_fields, phone_parts, position_titles, squeeze)

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "body"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up: "Node | None"):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self) -> Iterator["Node"]:
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def find(self, tag: str | None = None, cls: str | None = None, direct: bool = False, **attrs) -> list["Node"]:
        """Descendants (or children) by tag, a part of the class, and exact attributes."""
        pool = (k for k in self.kids if isinstance(k, Node)) if direct else self.walk()
        want = {k.replace("_", "-"): v for k, v in attrs.items()}
        return [n for n in pool if (tag is None or n.tag == tag) and (cls is None or cls in n.attrs.get("class", "")) and all(n.attrs.get(k) == v for k, v in want.items())]

    def texts(self) -> Iterator[str]:
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.texts()
            else:
                yield k

    @property
    def text(self) -> str:
        return squeeze("".join(self.texts()))

    @property
    def own(self) -> str:
        return squeeze("".join(k for k in self.kids if isinstance(k, str)))

    def next(self, tag: str | None = None) -> "Node | None":
        after = [k for k in self.up.kids[self.up.kids.index(self) + 1 :] if isinstance(k, Node)]
        return next((k for k in after if tag is None or k.tag == tag), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if ends := _CLOSES.get(tag):
            n = self.at
            while n.up and n.tag not in _SCOPE:
                if n.tag in ends:
                    self.at = n.up
                    break
                n = n.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.up and n.tag != tag:
            n = n.up
        if n.up:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


class Profile:
    """The sections of one page; every one is empty where its markup is missing."""

    def __init__(self, html: str, url: str | None, base: str):
        self.root, self.url, self.base = tree(html), url, base
        self.main = next(iter(self.root.find("div", "main__inner")), Node("div", {}, None))
        side = [n for n in self.root.find("div") if n.attrs.get("class") == "l-extra js-mobile_menu_content is-desktop"]
        self.side = next(iter(side[0].find("div", direct=True)), Node("div", {}, None)) if side else Node("div", {}, None)

    def link(self, href: str | None) -> str | None:
        return urljoin(self.base, href) if href else None

    def blocks(self, node: str) -> list[Node]:
        return self.main.find("div", "b-person-data", tab_node=node)

    def person_id(self) -> int | None:
        marks = [n.attrs["data-author"] for n in self.root.walk() if "data-author" in n.attrs]
        marks += [n.attrs["data-person-id"] for n in self.root.find("script") if "data-person-id" in n.attrs]
        tail = urlsplit(self.url or "").path.rstrip("/").rsplit("/", 1)[-1]
        return next((int(x) for x in map(str.strip, [*marks, tail]) if x.isdigit()), None)

    def full_name(self) -> str | None:
        return next((n.own or None for n in self.main.find("h1", "person-caption")), None)

    def avatar(self) -> str | None:
        for n in self.side.find("div", "person-avatar")[:1]:
            if m := re.search(r"url\(([^)]+)\)", n.attrs.get("style", "")):
                return self.link(m[1].strip().strip("'\""))
        return None

    def languages(self) -> list[str]:
        return [t for dl in self.side.find("dl", "main-list-language-knowledge-level") for dd in dl.find("dd") if (t := dd.own)]

    def contacts(self) -> dict:
        out = dict.fromkeys(("phones", "address", "hours", "timetable_url"))
        for dl in [d for d in self.side.find("dl", "main-list") if any("Контакты" in t.text for t in d.find("dt", direct=True))][:1]:
            for dd in dl.find("dd", direct=True)[:1]:
                shown = [t for t in map(squeeze, dd.texts()) if t and not t.startswith("Телефон")]
                out["phones"] = " | ".join(phone_parts(", ".join(shown))) or None
            for dd in dl.find("dd", "address-with-hours")[:1]:
                place, *hours = re.split(r"Время (?:присутствия|консультаций):", squeeze(" ".join(dd.texts())), maxsplit=1)
                out["address"] = squeeze(place.replace("Адрес:", "")) or None
                out["hours"] = squeeze(hours[0]) or None if hours else None
        for dl in self.side.find("dl", "person-extra-indent-timetable")[:1]:
            out["timetable_url"] = next((self.link(a.attrs["href"]) for a in dl.find("a") if a.attrs.get("class") == "link" and "href" in a.attrs), None)
        return out

    def research_ids(self) -> dict[str, str]:
        out: dict[str, str] = {}
        lists = [d for d in self.side.find("dl", "person-extra-indent") if not re.search("person-extra-indent-timetable|colleagues", d.attrs["class"])]
        for dd in lists[0].find("dd", direct=True) if lists else []:
            label = squeeze("".join(s.own for s in dd.find("span") if s.attrs.get("class") == "b"))
            link = next(iter(dd.find("a")), None)
            if label:
                out[label] = link.text if link else dd.text.replace(label, "").replace(":", "").strip()
            elif link:
                out[link.text] = self.link(link.attrs.get("href")) or link.text
        return out

    def managers(self) -> list[dict]:
        out = []
        for dd in [x for d in self.side.find("dl", "colleagues")[:1] for x in d.find("dd", direct=True)]:
            url = next((self.link(a.attrs["href"]) for a in dd.find("a") if "href" in a.attrs), None)
            m = re.search(r"/(?:staff|org/persons)/(\d+)", url or "")
            out.append({"person_id": int(m[1]) if m else None, "name": squeeze("".join(a.own for a in dd.find("a"))) or None, "url": url, "role": squeeze("".join(s.own for s in dd.find("span", "grey"))) or None})
        return out

    def positions(self) -> list[dict]:
        out = []
        for li in [x for u in self.main.find("ul", "employment-add")[:1] for x in u.find("li", direct=True)]:
            title = squeeze("".join(s.own for s in li.find("span", "person-appointment-title")))
            units = [{"name": a.text or None, "url": self.link(a.attrs.get("href"))} for a in li.find("a") if a.attrs.get("class") == "link"]
            out += [{"title": t, "units": units} for t in position_titles(title)]
        return out

    def notes(self) -> list[str]:
        return [li.text for u in self.main.find("ul", "person-employment-addition")[:1] for li in u.find("li", direct=True) if li.text]

    def degrees(self) -> list[dict]:
        out = []
        for entry in [e for b in self.blocks("sci-degrees1") for g in b.find("div", "g-list_closer") for e in g.find("div", "with-indent")]:
            year = next((n.own for n in entry.find("div", "person-list-hangover")), "")
            text = squeeze(entry.text.removeprefix(year))
            if text:
                out.append({"year": int(year) if year.isdigit() else None, "text": text})
        return out

    def interests(self) -> list[dict]:
        return [{"label": a.text, "url": self.link(a.attrs.get("href"))} for b in self.blocks("sci-intrests") for a in b.find("a", "tag") if a.text]

    def extra_education(self) -> list[dict]:
        out = []
        for p in [p for b in self.blocks("additional_education") for p in b.find("p") if p.find("strong", direct=True)]:
            year = squeeze("".join(s.own for s in p.find("strong")))
            if items := p.next("ul"):
                out += [{"year": int(year) if year.isdigit() else None, "text": li.text} for li in items.find("li") if li.text]
        return out

    def awards(self) -> list[str]:
        items = [re.sub(r"^[\s•·*–—-]+", "", li.text) for b in self.blocks("awards") for u in b.find("ul", "g-list") for li in u.find("li", direct=True)]
        return [x for x in items if x]

    def work_experience(self) -> list[str]:
        chunks = []
        for b in self.blocks("experience"):
            boxes = b.find("div", "with-indent")
            chunks += [p.text for d in boxes for p in d.find("p", "text")] or [d.text for d in boxes]
        return [": ".join(x for x in (e["years"], e["position"]) if x) for c in chunks for e in experience_entries(c)]

    def courses(self) -> list[dict]:
        out = []
        for block in self.main.find("div", "edu-courses"):
            head = next((h.own for h in block.find("h2")), "")
            year = re.search(r"\d{4}/\d{4}", head)
            for li in [x for u in block.find("ul", "g-list") for x in u.find("li", direct=True)]:
                links = [a for a in li.find("a") if a.attrs.get("class") == "link" and "/edu/courses/" in a.attrs.get("href", "")]
                if not links or li.find("span", "edu-courses-archive-toogle"):
                    continue
                meta = re.search(r"\(([^()]*)\)", li.text)
                out.append({"title": links[0].text, "url": self.link(links[0].attrs["href"]), "academic_year": year[0] if year else None, "language": next((s.own or None for s in li.find("span", "language-label")), None), "meta": squeeze(meta[1]) or None if meta else None})
        return out

    def _by_heading(self, words: tuple[str, ...]) -> list[str]:
        """Paragraphs of what follows the first heading with one of the words that has any."""
        for h in self.main.find("h2"):
            box = h.next() if any(w in h.text.lower() for w in words) else None
            if box and (got := [t for n in box.find("p", "text") or [box] if (t := n.text)]):
                return got
        return []

    def grants(self) -> list[dict]:
        listed = [li.text for b in self.blocks("grants") for u in b.walk() if u.tag in ("ol", "ul") for li in u.find("li", direct=True) if li.text]
        return [grant_fields(t) for t in listed or self._by_heading(("гранты", "проекты", "исследован"))]

    def editorial_staff(self) -> list[dict]:
        listed = [d.text for b in self.blocks("editorial-staff")[:1] for d in b.find("div", "with-indent") if d.text]
        return [editorial_fields(t) for t in listed or self._by_heading(("редколлег",))]

    def conferences(self) -> list[dict]:
        blocks = self.blocks("conferences")
        if not blocks:
            return []
        out, year = [], None
        for li in [x for u in blocks[0].find("ul", "g-list_closer") for x in u.find("li", "li2")]:
            if mark := li.find("div", "person-list-hangover"):
                year = int(mark[0].own) if mark[0].own.isdigit() else None  # one that can't be read resets it
            text = (li.find("p") or [li])[0].text
            if text:
                links = [{"url": self.link(a.attrs["href"]), "text": a.text or None} for a in li.find("a") if a.attrs.get("href")]
                out.append(_conference(text, year, links))
        return out or self._paired_conferences(blocks[0])

    def _paired_conferences(self, block: Node) -> list[dict]:
        """Second layout: a paragraph with title and year, then one with the talk."""
        out = []
        for li in block.find("li", "li2"):
            open_ = False
            for t in [p.text for p in li.find("p", "text") if p.text and not p.find("span", "file")]:
                if t.startswith("Доклад:"):
                    if open_:
                        out[-1]["talk_title"] = t[len("Доклад:") :].strip(": ") or out[-1]["talk_title"]
                    open_ = False
                else:
                    m = re.search(r"[,\s](\d{4})\s*г", t)
                    out.append(_conference(t, int(m[1]) if m else None, []))
                    open_ = True
        return out

    _PATENT = {"Номер РИД": "number", "Вид РИД": "kind", "Наименование РИД": "title", "Сведения о регистрации": "registration", "Авторы": "authors", "№ п/п": "index"}

    def patents(self) -> list[dict]:
        """Cells become {text, url}; a plain cell has no url."""
        out = []
        for tr in [r for b in self.blocks("patents") for t in b.find("table", "patent_table") for r in t.find("tr", "patent_table__item")]:
            row: dict[str, dict] = {}
            for td in [t for t in tr.find("td", direct=True) if squeeze(t.attrs.get("data-title"))]:
                url = next((self.link(a.attrs["href"]) for a in td.find("a") if a.attrs.get("href")), None)
                name = squeeze(td.attrs["data-title"])
                row[self._PATENT.get(name, name.lower())] = {"text": td.text, "url": url} if td.text else None
            if row:
                text = lambda k: (row.get(k) or {}).get("text")
                year = re.search(r"\b(?:19|20)\d{2}\b", text("registration") or "")
                out.append({"title": text("title"), "kind": text("kind"), "number": row.get("number"), "registration": row.get("registration"), "authors": [n for n in map(squeeze, re.split("[,;]", text("authors") or "")) if n], "year": int(year[0]) if year else None})
        return out


def _conference(text: str, year: int | None, links: list) -> dict:
    return {"description": text, "links": links, **conference_fields(text, year), "year": year}


_LINK = "struct<url:string,text:string>"
_CELL = "struct<text:string,url:string>"
#: Section, its type.
SECTIONS: dict[str, str] = {
    "person_id": "bigint", "full_name": "string", "avatar": "string", "languages": "array<string>",
    "contacts": "struct<phones:string,address:string,hours:string,timetable_url:string>",
    "research_ids": "map<string,string>",
    "managers": "array<struct<person_id:bigint,name:string,url:string,role:string>>",
    "positions": "array<struct<title:string,units:array<struct<name:string,url:string>>>>",
    "notes": "array<string>", "degrees": "array<struct<year:int,text:string>>",
    "interests": "array<struct<label:string,url:string>>", "extra_education": "array<struct<year:int,text:string>>",
    "awards": "array<string>", "work_experience": "array<string>",
    "courses": "array<struct<title:string,url:string,academic_year:string,language:string,meta:string>>",
    "grants": "array<struct<text:string,number:string,years:struct<start:int,end:int>>>",
    "editorial_staff": "array<struct<text:string,start_year:int,journal:string>>",
    "conferences": f"array<struct<description:string,links:array<{_LINK}>,year:int,title:string,location:string,talk_title:string>>",
    "patents": f"array<struct<title:string,kind:string,number:{_CELL},registration:{_CELL},authors:array<string>,year:int>>",
}
SCHEMA = "url string, " + ", ".join(f"{k} {v}" for k, v in SECTIONS.items())


def profile(html: str, url: str | None = None, base: str = "https://portal.example.org/") -> dict:
    p = Profile(html, url, base)
    return {"url": url} | {k: getattr(p, k)() for k in SECTIONS}


def parse_pages(pages: DataFrame, base: str = "https://portal.example.org/", each: Callable[[str, str, str], dict] = profile) -> DataFrame:
    """pages (url, html) to one nested record a page; a null page gives an empty record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [each(h if isinstance(h, str) else "", u, base) for u, h in zip(b["url"], b["html"])]
            yield pd.DataFrame(rows, columns=["url", *SECTIONS])

    return pages.select("url", "html").mapInPandas(run, SCHEMA)
