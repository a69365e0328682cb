"""Normalisers for texts of profile pages that need more than one pattern (used inside the page parser)."""

from __future__ import annotations

import re

_SPACE = re.compile(r"\s+")
#: How pages write a year, an end that is open, and the dash between the two; signs that are no part of a text's ends.
YEAR = r"(?:\d{1,2}\.)?(?:19|20)\d{2}(?:\s*г\.?)?"
OPEN_END = r"(?:по\s+н\.?в\.?|по\s+настоящее\s+время|н\.?в\.?)"
DASH = r"\s*[–\-−—]\s*"
ENDS = " ,.;—–-\t\n"
TITLE_ENDS = " ,.;:-–—"
TALK = r"\s*\.\s*Доклад\s*:\s*"
PLACE = r"\s*\(([^()]+)\)"

_YEAR, _LATER = re.compile(YEAR, re.I), re.compile(rf"{DASH}(?:{YEAR}|{OPEN_END})", re.I)
_PLACE_AND_TALK, _TALK = re.compile(PLACE + TALK, re.I), re.compile(TALK, re.I)
_YEARS_IN_BRACKETS = re.compile(rf"[^()\d]*(\d{{4}})(?:{DASH}(\d{{4}}))?\s*(?:г\.|гг\.)?\s*")


def squeeze(s: str | None) -> str:
    return _SPACE.sub(" ", s or "").strip()


def _ends_well(text: str, at: int) -> bool:
    """Whether a period may end here."""
    return at == len(text) or text[at].isspace() or text[at] in ",;:."


def periods(text: str) -> list[tuple[int, int]]:
    """Where the text names a year, or a year and what it lasts to; the longest reading that ends at a word's end."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _YEAR.search(text, at):
        a, at = m.start(), m.start() + 1
        if a and (text[a - 1].isdigit() or text[a - 1] == "."):
            continue
        bare = _YEAR.match(text, a, a + len(m[0].rstrip(". гГ")))
        later = [x for y in (m, bare) if y and (x := _LATER.match(text, y.end()))]
        for end in [x.end() for x in later] + [m.end(), m.end() - 1, bare.end() if bare else m.end()]:
            if _ends_well(text, end) and end >= a + 4:
                out.append((a, end))
                at = end
                break
    return out


def experience_entries(text: str | None) -> list[dict[str, str]]:
    """Text cut at its periods: what follows a period belongs to it; text before the first goes to the first entry."""
    body = squeeze(text)
    found = periods(body)
    if not found:
        return [{"years": "", "position": body}] if body else []
    out = []
    for n, (a, b) in enumerate(found):
        words = body[b : found[n + 1][0] if n + 1 < len(found) else None].strip(ENDS)
        if n == 0:
            words = " ".join(x for x in (body[:a].strip(ENDS), words) if x)
        if words:
            out.append({"years": body[a:b].strip(), "position": words})
    return out


def conference_fields(text: str | None, year: int | None = None) -> dict:
    """Year, title, place and talk of a conference line; a year that is known is not looked for."""
    body = squeeze(text)
    out = {"year": year, "title": body or None, "location": None, "talk_title": None}
    if year is None:
        head = body[:4]
        rest = body[4:].lstrip()
        if not (len(head) == 4 and head.isdigit() and rest[:1] in (":", ".") and rest[1:].strip()):
            return out
        out["year"], body = int(head), rest[1:].strip()
        out["title"] = body
    # the title has a character at least, so nothing is looked for before the second
    for mark in (_PLACE_AND_TALK, _TALK):
        if (m := mark.search(body, 1)) and m.end() < len(body):
            place = m[1] if mark is _PLACE_AND_TALK else ""
            return out | {"title": body[: m.start()], "location": squeeze(place) or None, "talk_title": body[m.end() :]}
    whole = body.removesuffix(".").rstrip()
    if whole.endswith(")") and 0 < (a := whole.rfind("(")) < len(whole) - 2 and ")" not in whole[a:-1]:
        out |= {"title": whole[:a].rstrip(), "location": squeeze(whole[a + 1 : -1]) or None}
    return out


def award_fields(text: str | None) -> dict:
    """Title and years of an award that ends in a bracketed year or range."""
    body = squeeze(text)
    a = body.rfind("(")
    m = _YEARS_IN_BRACKETS.fullmatch(body, a + 1, len(body) - 1) if a >= 0 and body.endswith(")") else None
    if not m:
        return {"title": body, "year_from": None, "year_to": None}
    return {"title": body[:a].rstrip(TITLE_ENDS) or body, "year_from": int(m[1]), "year_to": int(m[2]) if m[2] else None}


def grant_fields(text: str) -> dict:
    number = re.search(r"Номер:\s*([^,]+)", text)
    marked = re.findall(r"(\d{4})\s*г", text)
    if not marked and (span := re.search(rf"(\d{{4}}){DASH}(\d{{4}})", text)):
        marked = [span[1], span[2]]
    years = {"start": int(marked[0]), "end": int(marked[-1])} if marked else None
    return {"text": text, "number": (squeeze(number[1]) or None) if number else None, "years": years}


def editorial_fields(text: str) -> dict:
    year, journal = re.search(r"(\d{4})\s*г", text), re.search(r"«([^»]+)»", text)
    return {"text": text, "start_year": int(year[1]) if year else None, "journal": squeeze(journal[1]) if journal else None}


def position_titles(text: str | None) -> list[str]:
    parts = [squeeze(x).rstrip(":") for x in squeeze(text).rstrip(":").rstrip(",").split(",")]
    return [x for x in parts if x]


def phone_parts(text: str | None) -> list[str]:
    return [x for x in map(squeeze, re.split(r"[,|;/]", squeeze(text))) if x]
