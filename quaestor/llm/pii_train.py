"""Training of the personal-data tagger and of the gate before it.

    python -m quaestor.llm.pii_train DIR_OF_TABLES [BATCHES [more]]

"more" goes on from the stored weights at a lower rate.

Labelled spans come from two sources: at most `MAX_DOCUMENTS` stored documents are
marked by the pattern grammar below, which knows the shapes and the cue words of each
kind and the given names of the persons table; and `INVENTED` texts in six languages
are put together with their marks by `pii_examples`.  The tagger sees characters only;
the grammar and the lists are not used when it runs.
"""

from __future__ import annotations

import re
import sys
import time

import numpy as np

from quaestor.llm.lstm_crf import BiLstmCrf, train
from quaestor.llm.pii_examples import invented
from quaestor.llm.pii_model import CLASSES, HASHED, LABELS, MARGIN, RUN, SYMBOLS, WEIGHTS, Gate, find, symbols, windows

MAX_DOCUMENTS, INVENTED, HIDDEN, BATCH = 9000, 16_000, 32, 192
#: Share of the held-out finds that the gate must reach.
REACHED = 0.9995

_U, _L = "A-ZÀ-ÞА-ЯЁІЇЄҐ", "a-zß-ÿа-яёіїєґ'’"
EMAIL = re.compile(
    r"[\w.+-]*\w(?: ?@ ?|\s*[\[(]\s*(?:at|собака)\s*[\])]\s*|\s+(?:at|собака)\s+(?=[\w-]+\s+(?:dot|точка)\s|[\w-]+\.\w))"
    r"[\w-]+(?:(?:\.|\s+(?:dot|точка)\s+|\s*[\[(]\s*(?:dot|точка)\s*[\])]\s*)[\w-]+)+", re.I)
ID_CUE = r"(?:снилс|snils|страхов\w+ номер|insurance (?:no|number)|инн|inn|tin|tax (?:no|number))[^\d\n]{0,14}"
SNILS = re.compile(ID_CUE + r"(\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2}|\d{4}[- ]?\d{4}[- ]?\d{4}|\d{10})(?!\d)", re.I)
PASSPORT = re.compile(r"(?:паспорт|passport)[^\d\n]{0,16}(\d{2} ?\d{2} ?(?:№ ?)?\d{6})(?!\d)", re.I)
PHONE = re.compile(r"(?<![\w.№/-])(?<!№ )(?<!№)(?:\+?\d{1,3}[ .(-]{0,2})?\(?\d{2,4}\)?[ .)-]{0,2}\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w/]|[.-]\d)")
NOT_PHONE = re.compile(r"(?:isbn|doi|удк|рег\.|№|грант|issn|reg\.|grant)[^\n;,]{0,12}$", re.I)
_TYPE = r"(?:ул|улица|наб|набережная|пр|просп|проспект|пр-т|пер|переулок|пл|площадь|шоссе|бульвар|б-р|проезд|вул)"
_STREET = rf"[{_U}][{_L}-]+(?:[ -][{_U}][{_L}-]+)?"
ADDRESS = re.compile(
    rf"\b{_TYPE}\b\.? ?{_STREET},? ?(?:(?:дом|д)\.? ?)?\d{{1,4}}[а-яa-z]?\b"
    rf"|{_STREET} {_TYPE}\b\.?,? ?(?:(?:дом|д)\.? ?)?\d{{1,4}}[а-яa-z]?\b"
    rf"|\b\d{{1,4}}[a-z]? (?:{_STREET} )(?:St|Street|Road|Rd|Lane|Avenue|Ave|Drive|Square)\b"
    rf"|\b[{_U}][{_L}]+(?:straße|strasse|weg|allee|gasse|platz) \d{{1,4}}[a-z]?\b")
_W = rf"(?:[{_U}][{_L}]+(?:-[{_U}][{_L}]+)?|[{_U}]{{3,}}(?:-[{_U}]{{3,}})?)"
_I = rf"[{_U}]\."
NAME = re.compile(rf"\b{_W},? {{0,2}}{_I} ?(?:{_I})?|\b{_I} ?(?:{_I} ?)?{_W}\b|\b{_W},? {{1,2}}{_W}(?: {{1,2}}{_W})?\b")
_PATRONYMIC = re.compile(r"(?:ович|евич|ьич|овн|евн|ичн|ovich|evich|ovn|evn)[а-яa-z]{0,3}$", re.I)
_SURNAME = re.compile(r"[а-яёa-z'’-]{4,}$", re.I)


#: Latin writing of Cyrillic letters.
_LATIN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "e", "ґ": "g"}


def latin(word: str) -> str:
    return "".join(_LATIN.get(c, c) for c in word.lower())


def _stem(word: str) -> str:
    return word[: min(4, max(3, len(word) - 1))]


def given_names(full_names: list[str]) -> dict[str, set[int]]:
    """Stems of given names in Latin letters, each with the lengths of its names."""
    out: dict[str, set[int]] = {"lva": {3}, "lvom": {4}, "pavl": {5}}  # cases that change the stem
    for x in full_names:
        words = (x or "").split()
        pick = words[1:2] if re.search("[а-яё]", x or "", re.I) else words[:1]
        for w in map(latin, pick):
            if len(w) > 2:
                out.setdefault(_stem(w), set()).add(len(w))
    return out


def _given(word: str, given: dict[str, set[int]]) -> bool:
    """Whether a word is a given name in any case or spelling."""
    w = latin(word)
    return any(abs(len(w) - n) <= 2 for s in {w[:3], w[:4]} for n in given.get(s, ()))


def _is_name(words: list[str], given: dict[str, set[int]]) -> bool:
    if any(re.fullmatch(r"(?:ул|наб|St|Road|Lane|Avenue|Street|Der|Die|Das|Im|Unsere|Nach|ISBN|E-mail|Call|Write|Send)", w) for w in words):
        return False
    whole = [w for w in words if len(w) > 1]
    if len(whole) < len(words):  # initials
        return len(whole) == 1 and bool(_SURNAME.match(whole[0])) and len(whole[0]) > 3
    return any(_given(w, given) or _PATRONYMIC.search(w) and len(w) > 6 for w in whole) and len(whole) >= 2


def marked(text: str, given: dict[str, set[int]]) -> list[tuple[int, int, int]]:
    taken = np.zeros(len(text) + 1, bool)
    text = re.sub("[\u00a0\u2000-\u200a\u202f]", " ", text)  # same length
    out = []

    def add(a: int, b: int, kind: int) -> None:
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((a, b, kind))

    for m in EMAIL.finditer(text):
        add(m.start(), m.end(), 0)
    for rx in (SNILS, PASSPORT):
        for m in rx.finditer(text):
            add(m.start(1), m.end(1), 2)
    for m in ADDRESS.finditer(text):
        add(m.start(), m.end(), 3)
    for m in PHONE.finditer(text):
        d = re.sub(r"\D", "", m[0])
        lead = m[0].lstrip()[0]
        if 9 <= len(d) <= 13 and not NOT_PHONE.search(text[max(0, m.start() - 24) : m.start()]) and not re.fullmatch(r"(?:19|20)\d\d[-–. ]+(?:19|20)\d\d\d*", m[0]) and (lead in "+(78" or len(d) == 10 or "(" in m[0] or lead == "0" and len(d) == 11):
            a = m.start() + (len(m[0]) - len(m[0].lstrip()))
            add(a, m.end(), 1)
    at = 0
    while m := NAME.search(text, at):
        words = re.findall(rf"[{_U}{_L}-]+", m[0])
        at = m.end()
        if _is_name(words, given):
            if len(words) == 3 and all(len(w) > 1 for w in words):
                flags = [_given(w, given) or bool(_PATRONYMIC.search(w)) for w in words]
                if not flags[0] and not flags[1]:
                    at = m.start() + len(words[0])
                    continue
                if sum(flags) < 2:  # a third word that belongs to what follows
                    cut = m[0].rindex(words[2])
                    end = m.start() + len(m[0][:cut].rstrip(" ,"))
                    add(m.start(), end, 4)
                    at = end
                    continue
            add(m.start(), m.end(), 4)
        else:
            at = m.start() + len(words[0]) if words else m.end()
    return sorted(out)


Marked = list[tuple[str, list[tuple[int, int, int]]]]


def fit_gate(own: Marked, held: Marked) -> Gate:
    """Log odds by counting; the threshold is the highest that still reaches REACHED of the held-out finds."""
    count = [np.zeros((2, n)) for n in (HASHED, CLASSES**RUN)]
    for text, spans in own:
        inside = np.zeros(len(text), np.int64)
        for a, b, _ in spans:
            inside[a:b] = 1
        for table, code in zip(count, Gate.codes(symbols(text))):
            for y in (0, 1):
                table[y] += np.bincount(code[inside == y], minlength=table.shape[1])
    odds = [np.log((t[1] + 0.2) / t[1].sum()) - np.log((t[0] + 1.0) / t[0].sum()) for t in count]
    odds = [np.where(t.sum(0) > 0, o, 0) for t, o in zip(count, odds)]
    out = Gate(*[np.clip(o * 16, -127, 127).astype(np.int8) for o in odds], 0.0)
    best = []
    for text, spans in held:
        if spans:
            score = out.score(symbols(text))
            # a find that is within the margin of a flagged character is read in full, if it is not much longer
            best += [score[max(0, a - MARGIN // 2) : b + MARGIN // 2].max() for a, b, _ in spans]
    out.least = float(np.quantile(best, 1 - REACHED))
    return out


def examples(marks: Marked, gate: Gate):
    for text, spans in marks:
        ids, spots = windows([text], gate)
        if not spots:
            continue
        labels = np.zeros(len(text), np.int8)
        for a, b, kind in spans:
            labels[a:b] = 2 + 2 * kind
            labels[a] = 1 + 2 * kind
        for _, a, b, _ in spots:
            yield ids[a:b], labels[a:b]


def batches(data, extra, total: int, seed: int):
    """Half of a batch from the documents, half invented; windows with marks are preferred."""
    r = np.random.default_rng(seed)
    hot = [i for i, (_, y) in enumerate(data) if y.any()]
    cold = [i for i, (_, y) in enumerate(data) if not y.any()]
    for _ in range(total):
        pick = [data[i] for i in np.r_[r.choice(hot, BATCH // 3), r.choice(cold or hot, BATCH // 6)]]
        pick += [extra[i] for i in r.choice(len(extra), BATCH - len(pick))]
        longest = max(len(x) for x, _ in pick)
        ids, mask, gold = np.zeros((longest, BATCH), np.int64), np.zeros((longest, BATCH), bool), np.zeros((longest, BATCH), np.int64)
        for j, (x, y) in enumerate(pick):
            ids[: len(x), j], mask[: len(x), j], gold[: len(x), j] = x, True, y
        yield ids, mask, gold


def scores(marks: Marked, model) -> dict[str, tuple[int, int, int]]:
    from quaestor.llm.pii_model import KINDS, value

    out = {k: [0, 0, 0] for k in KINDS}
    for (text, spans), got in zip(marks, find([t for t, _ in marks], model)):
        a = {(k, value(text[x:y], k)) for x, y, k in spans}
        b = {(k, value(text[x:y], k)) for x, y, k in got}
        for k, name in enumerate(KINDS):
            own, theirs = {x for x in a if x[0] == k}, {x for x in b if x[0] == k}
            out[name][0] += len(own & theirs)
            out[name][1] += len(own - theirs)
            out[name][2] += len(theirs - own)
    return {k: tuple(v) for k, v in out.items()}


def main(folder: str, total: int, more: bool = False) -> None:
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    given = given_names(pq.read_table(f"{folder}/persons.parquet", columns=["full_name"]).to_pydict()["full_name"])
    texts = list(dict.fromkeys(t for _, t in sorted(zip(docs["doc_id"], docs["text"])) if t))[:MAX_DOCUMENTS]
    held, own = texts[::12], [t for i, t in enumerate(texts) if i % 12]
    marks = [(t, marked(t, given)) for t in own]
    plain = [p.strip() for t, m in marks[:3000] if not m for p in re.findall(r"[^.!?]{20,160}[.!?]", t)[:2]]
    made, shown = list(invented(INVENTED, 1, plain)), list(invented(1500, 2, plain))
    gate = fit_gate(marks + made, [(t, marked(t, given)) for t in held] + shown)
    gate.save()
    share = sum(b - a for t in held for _, a, b, _ in windows([t], gate)[1]) / sum(map(len, held))
    data, extra = list(examples(marks, gate)), list(examples(made, gate))
    print(len(texts), "documents,", len(data), "windows,", sum(y.any() for _, y in data), "with marks;", len(extra), "invented; gate", gate.least, "lets", round(share, 4), "of the characters through", flush=True)
    model, began = BiLstmCrf.load(WEIGHTS) if more else BiLstmCrf.fresh(SYMBOLS, HIDDEN, LABELS, seed=7), time.time()

    def tell(step: int, loss: float) -> None:
        if step % 50 == 0:
            print(step, round(loss, 3), round(time.time() - began), flush=True)

    train(model, batches(data, extra, total, 12 if more else 11), rate=0.002 if more else 0.004, total=total, tell=tell)
    model.save(WEIGHTS)
    stored = BiLstmCrf.load(WEIGHTS)
    print("held-out documents (both, only marks, only tagger):", scores([(t, marked(t, given)) for t in held], stored))
    print("held-out invented texts:", scores(shown, stored))


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 2000, "more" in sys.argv)
