"""Windows, symbols, decoding and reconciliation for the personal-data tagger.

The tagger reads every character of every text.  A trained gate chooses the windows
that it learns from (`pii_train`): two tables of log odds, by a hash of three symbols and
by six classes of signs, summed and averaged over a few characters.  Its threshold is set
on held-out marks, nothing about it is written by hand.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from quaestor.llm.lstm_crf import BiLstmCrf

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = 1 + 2 * len(KINDS)  # 0 outside; 1+2k begins kind k, 2+2k continues it
WINDOW, OVERLAP, MARGIN = 192, 64, 36
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
GATE = os.path.join(os.path.dirname(__file__), "pii_gate.npz")
#: Size of the table of symbol runs; classes of signs and how many make a run; characters that are averaged.
HASHED, CLASSES, RUN, BOX = 1 << 18, 8, 6, 8

_LETTERS = "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґäöüßéèêàâçîôûñáíóú"
_SIGNS = " .,;:()[]@+-–—/\\№#'’\"«»!?_&%=<>|·•\n"
_BASE = 4  # pad, unknown letter, unknown sign, digit
SYMBOLS = 2 * (_BASE + len(_LETTERS) + len(_SIGNS))


@functools.cache
def _table() -> np.ndarray:
    """Code point (below 0x2200) to symbol; odd symbols are capitals."""
    out = np.full(0x2200, 2 * 2, np.int16)
    for c in range(0x2200):
        x = chr(c)
        if x.isdigit():
            out[c] = 2 * 3
        elif x.isalpha():
            low = x.lower()
            at = _LETTERS.find(low) if len(low) == 1 else -1
            out[c] = 2 * (_BASE + at if at >= 0 else 1) + (x != low)
        elif (at := _SIGNS.find(x)) >= 0:
            out[c] = 2 * (_BASE + len(_LETTERS) + at)
        elif x.isspace():
            out[c] = 2 * (_BASE + len(_LETTERS))
    return out


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table()[np.where(points < 0x2200, points, 0x2199)]


@functools.cache
def _classes() -> np.ndarray:
    """Symbol to class of signs: small letter, capital, digit, space, full stop, comma and the like, sign of numbers and addresses, other."""
    out = np.full(SYMBOLS, 7, np.int32)
    for k in range(SYMBOLS):
        base = k // 2 - _BASE
        if base == -1:
            out[k] = 2
        elif base == -3 or 0 <= base < len(_LETTERS):
            out[k] = k % 2
        elif base >= len(_LETTERS):
            sign = _SIGNS[base - len(_LETTERS)]
            out[k] = 3 if sign in " \n" else 4 if sign == "." else 5 if sign in ",;:" else 6 if sign in "@+-–()[]/№" else 7
    return out


class Gate:
    """Log odds of a character being part of a find, in sixteenths."""

    def __init__(self, hashed: np.ndarray, runs: np.ndarray, least: float):
        self.hashed, self.runs, self.least = hashed, runs, least

    @classmethod
    def load(cls, path: str = GATE) -> "Gate":
        with np.load(path) as z:
            return cls(z["hashed"], z["runs"], float(z["least"]))

    def save(self, path: str = GATE) -> None:
        np.savez_compressed(path, hashed=self.hashed, runs=self.runs, least=self.least)

    @staticmethod
    def codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the symbols and of the classes around each character."""
        x = np.concatenate([np.zeros(3, np.int64), ids.astype(np.int64), np.zeros(3, np.int64)])
        n = len(ids)
        three = ((x[2 : 2 + n] * SYMBOLS + x[3 : 3 + n]) * SYMBOLS + x[4 : 4 + n]) * 0x9E3779B1 >> 13 & HASHED - 1
        c = _classes()[x]
        run = np.zeros(n, np.int64)
        for k in range(RUN):
            run = run * CLASSES + c[k : k + n]
        return three, run

    def score(self, ids: np.ndarray) -> np.ndarray:
        """Mean over the BOX characters around each."""
        three, run = self.codes(ids)
        total = np.cumsum(np.concatenate([np.zeros(BOX // 2 + 1), self.hashed[three].astype(np.int32) + self.runs[run], np.zeros(BOX // 2)]))
        return (total[BOX:] - total[:-BOX])[: len(ids)] / BOX

    def hits(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.score(ids) >= self.least)


def _cut(a: int, b: int) -> list[tuple[int, int]]:
    """One stretch as overlapping windows."""
    out = []
    while b - a > WINDOW:
        out.append((a, a + WINDOW))
        a += WINDOW - OVERLAP
    return [*out, (a, b)]


def _laid(hits: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Windows around the given characters of a text of n, long stretches cut into overlapping windows."""
    if not len(hits):
        return []
    edge = np.flatnonzero(np.diff(hits) > 2 * MARGIN) + 1
    out = []
    for a, b in zip(hits[np.r_[0, edge]].tolist(), hits[np.r_[edge - 1, len(hits) - 1]].tolist()):
        out += _cut(max(0, a - MARGIN), min(n, b + 1 + MARGIN))
    return out


_APART = "\n" * 16  # between texts that are read at once: wider than what the gate looks at


def windows(texts: list[str], own: Gate | None = None) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Symbols of the joined texts, and windows: (text, start, end, where the text begins among the symbols).

    The windows cover every character, or with a gate of its own what that lets through.
    """
    ids = symbols(_APART.join(texts))
    hits = own.hits(ids) if own else None
    out, start = [], 0
    for k, text in enumerate(texts):
        if hits is None:
            laid = _cut(0, len(text)) if text else []
        else:
            a, b = np.searchsorted(hits, (start, start + len(text)))
            laid = _laid(hits[a:b] - start, len(text))
        out += [(k, x, y, start) for x, y in laid]
        start += len(text) + len(_APART)
    return ids, out


@functools.cache
def tagger(path: str = WEIGHTS) -> BiLstmCrf:
    return BiLstmCrf.load(path)


def _tagged(model: BiLstmCrf, pieces: list[np.ndarray], batch: int = 512) -> dict[int, np.ndarray]:
    """Labels of the windows that are not sure to lie outside as a whole; windows of like length share a batch."""
    lens = np.array([len(x) for x in pieces])
    order = np.argsort(-lens, kind="stable")
    left: list[int] = []  # these windows, and their emissions
    rest = []
    for own in np.array_split(order, -(-len(order) // batch)) if len(order) else []:
        longest = lens[own[0]]
        ids = np.zeros((longest, len(own)), np.int16)
        mask = np.arange(longest)[:, None] < lens[own]
        ids.T[mask.T] = np.concatenate([pieces[i] for i in own])
        e = model.scores(ids, mask)
        may = np.flatnonzero(~model.outside(e, mask))
        left += own[may].tolist()
        rest.append(e[:, :, may])
    if not left:
        return {}
    e = np.zeros((model.k, max(x.shape[1] for x in rest), len(left)), np.float32)
    at = 0
    for x in rest:
        e[:, : x.shape[1], at : at + x.shape[2]] = x
        at += x.shape[2]
    path = model.paths(e, np.arange(e.shape[1])[:, None] < lens[left])
    return {i: path[: lens[i], j] for j, i in enumerate(left)}


def tag_windows(model: BiLstmCrf, pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Labels of each window."""
    got = _tagged(model, pieces)
    return [got[i] if i in got else np.zeros(len(x), np.int8) for i, x in enumerate(pieces)]


_RUN = {
    0: re.compile(r"[\w.+@-]"),
    1: re.compile(r"\d"),
    2: re.compile(r"\d"),
    3: re.compile(r"\w"),
    4: re.compile(r"[\w’'-]"),
}
_SQUEEZE = re.compile(r"[\W_]+")
_AT = re.compile(r"@|\bat\b|собака", re.I)
_DOT = re.compile(r"\.|\bdot\b|точка", re.I)


def value(text: str, kind: int) -> str:
    """The normal form in which a find is reported."""
    if kind in (1, 2):
        return "".join(c for c in text if c.isdigit())
    return _SQUEEZE.sub("", text.lower())


def _valid(text: str, kind: int) -> bool:
    if kind == 0:
        return bool((m := _AT.search(text)) and m.start() > 0 and _DOT.search(text, m.end()))
    digits = sum(c.isdigit() for c in text)
    if kind == 1:
        return 9 <= digits <= 15
    if kind == 2:
        return 10 <= digits <= 12
    if kind == 3:
        return 1 <= digits <= 6 and sum(c.isalpha() for c in text) >= 3
    words = [w for w in re.split(r"[\W\d_]+", text) if w]
    return digits == 0 and len(words) >= 2 and any(len(w) > 1 for w in words)


_PREFIX = re.compile(r"(?:^|(?<=[\s,;:|·(]))\+?\d{1,3}[ .(-]{1,2}$")
_STOP = re.compile(r"(?<=[^\W\d_]{3})[.;|·]\s*")


def _settled(text: str, a: int, b: int, kind: int) -> list[tuple[int, int, int]]:
    """Last corrections of one find: the country or trunk code of a number, the ends and the full stops of names."""
    if kind == 1 and (m := _PREFIX.search(text, max(0, a - 6), a)):
        return [(m.start(), b, kind)]
    if kind != 4:
        return [(a, b, kind)]
    out = []
    cuts = [(m.start(), m.end()) for m in _STOP.finditer(text, a, b)]
    for start, end in zip([a, *[e for _, e in cuts]], [*[s for s, _ in cuts], b]):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_][\w’'-]*\.?", text[start:end])]
        if any(text[start + x].isupper() for x, _ in words):
            while words and text[start + words[0][0]].islower():
                words.pop(0)
            while words and text[start + words[-1][0]].islower():
                words.pop()
        if words:
            out.append((start + words[0][0], start + words[-1][1], kind))
    return out


def spans_of(text: str, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) from character labels: runs of one kind, grown to whole words or digit runs."""
    found = []
    n, at = len(text), 0
    hot = np.flatnonzero(labels)
    while at < len(hot):
        a = int(hot[at])
        kind = (int(labels[a]) - 1) // 2
        b = a + 1
        while b < n and labels[b] == 2 + 2 * kind:
            b += 1
        at = int(np.searchsorted(hot, b))
        rx = _RUN[kind]
        low = found[-1][1] if found else 0
        if rx.match(text[a]):
            while a > low and rx.match(text[a - 1]):
                a -= 1
            if kind == 0 and a and a == low and rx.match(text[a - 1]):  # a name that runs into an address is part of it
                a = found.pop()[0]
        while b < n and rx.match(text[b - 1]) and rx.match(text[b]):
            b += 1
        while b > a and not (text[b - 1].isalnum() or (kind == 4 and text[b - 1] == "." )):
            b -= 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        if b > a:
            found.append((a, b, kind))
    joined: list[tuple[int, int, int]] = []
    for a, b, kind in found:  # pieces of one find that a stray label cut
        if joined and joined[-1][2] == kind and (a <= joined[-1][1] or not any(c.isalnum() or c in ";\n|·" for c in text[joined[-1][1] : a]) and a - joined[-1][1] <= 2 and not (_valid(text[a:b], kind) and _valid(text[joined[-1][0] : joined[-1][1]], kind))):
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]), kind)
        else:
            joined.append((a, b, kind))
    return [x for y in joined for x in _settled(text, *y) if _valid(text[x[0] : x[1]], x[2])]


def find(texts: list[str], model: BiLstmCrf) -> list[list[tuple[int, int, int]]]:
    """Personal data of each text as (start, end, kind).

    Overlapping windows are reconciled over the whole text: where two cover a
    character, the label of the window in which it lies farther from an edge counts.
    """
    ids, spots = windows(texts)
    tagged = _tagged(model, [ids[s + a : s + b] for _, a, b, s in spots])
    labels: dict[int, np.ndarray] = {}
    reach: dict[int, np.ndarray] = {}
    for i, (k, a, b, _) in enumerate(spots):
        got = tagged.get(i)
        if k not in labels:
            if got is None or not got.any():
                continue
            labels[k], reach[k] = np.zeros(len(texts[k]), np.int8), np.zeros(len(texts[k]), np.int16)
        far = np.minimum(np.arange(b - a), np.arange(b - a)[::-1]).astype(np.int16) + 1
        better = far > reach[k][a:b]
        labels[k][a:b][better] = 0 if got is None else got[better]
        reach[k][a:b][better] = far[better]
    return [spans_of(t, labels[k]) if k in labels else [] for k, t in enumerate(texts)]
