"""Variant spellings of names typed by people.

Names are brought to one alphabet (look-alike letters put right, Cyrillic written in
Latin letters, the usual romanisations folded together) and cut into parts.  A name,
with all its parts and spellings, is one vector of weighted character n-grams; an
initial shares a gram with every part that begins with it, and a short form carries
the grams of the full names it stands for.  Weights fall with the number of names that
hold a gram and stop rising at RARE of all names, so that a typing error, whose grams
are rare by accident, does not outweigh what is spelled right.

A distributed sparse join finds all pairs of names with a cosine of at least THRESHOLD.
Each name is sent to the postings of its rarest grams only: those that remain when the
commonest grams whose squared weights sum to less than the square of the threshold are
dropped, which loses no pair.  What is shuffled is a row a name and kept gram, never a
pair.  In a posting, dense sketches (an upper bound of the cosine) and the norms of what
is left of two vectors rule pairs out before the cosine is computed in full.  A posting
of more than BLOCK names is cut into blocks and each pair of blocks is a cell of its own.

Pairs that contradict each other (another given name or patronymic than an
abbreviation, a nickname or a typing error can explain) are no pairs; most are seen in
arrays over many pairs at once, and only what these leave is judged pair by pair.  Of the
others each name keeps its TOP best.  They are grouped by average linkage, in rounds that merge
all pairs of groups that are each other's nearest; a pair that was not kept counts as
0, up to as many pairs as can be kept, and groups stay apart if each holds a profile.  A record is linked to the
profile of its group if an exact check agrees: no other profile explains the spellings
as well, and the surname is near enough for what is written out of the rest.

Defined results: records without a usable name, and names of a single part, link to
nobody; records equal in both names link alike; if several profiles fit equally well
there is no link; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.skew import salted_join
from quaestor.plans.lineage import Stage, cut

#: Least cosine of a pair, least average cosine of two groups that merge, partners kept a name, highest cost of a link.
THRESHOLD, MERGE, TOP, MAX_COST = 0.42, 0.25, 32, 4.5
#: Length of the grams; share of the names below which a gram's weight stops rising; names that are added to the counts.
GRAM, RARE, VIRTUAL = 4, 0.005, 1000
#: Grams are numbered by a hash of this many bits, so their counts have a fixed size.
GRAM_BITS, SKETCH = 20, 256
#: Names of a posting that meet in one task.
BLOCK = 8192
#: Spellings that a worker keeps the readings of.
SPELLINGS = 300_000
#: So few edges of the linkage are merged in one task; more are merged in distributed rounds until so few are open.
LOCAL_EDGES = 2_000_000

#: Letters that look alike, and Latin writing of Cyrillic letters (folded).
_LOOK_CYRILLIC = str.maketrans("aeopcyxkmthbABEKMHOPCTXY", "аеорсухкмтнвАВЕКМНОРСТХУ")
_LOOK_LATIN = str.maketrans("аеорсухкмтАВЕКМНОРСТХУ", "aeopcyxkmtABEKMHOPCTXY")
_LETTERS = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", ("a", "b", "v", "g", "d", "e", "e", "ж", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "ч", "ш", "ш", "", "i", "", "e", "ю", "я", "i", "i", "e", "g")))
#: Common short forms of given names.
_SHORT = {
    "александр": "саша шура саня alex aleks sasha sanya alexander", "александра": "саша шура sasha alex", "алексей": "лёша алёша леша alexey lyosha alyosha alexis", "анастасия": "настя nastya", "анатолий": "толя tolya", "андрей": "андрюша andrew", "анна": "аня нюра anya ann anne", "антон": "антоша tosha", "артём": "тёма артемий tyoma", "борис": "боря borya", "вадим": "вадик vadik", "валентина": "валя valya", "валерия": "лера lera", "василий": "вася vasya basil", "вера": "верочка", "виктор": "витя vitya vic victor", "виктория": "вика vika victoria", "владимир": "вова володя vova volodya", "галина": "галя galya", "георгий": "жора гоша гера", "глеб": "глебушка", "григорий": "гриша grisha gregory", "дарья": "даша dasha", "денис": "деня", "дмитрий": "дима митя dima mitya", "евгений": "женя zhenya eugene", "евгения": "женя zhenya eugenia", "егор": "гоша", "екатерина": "катя катерина katya kate catherine katherine", "елена": "лена lena helen helena ellen", "зинаида": "зина zina", "иван": "ваня vanya", "игорь": "гоша", "инна": "инночка", "ирина": "ира ira", "кирилл": "кира", "константин": "костя kostya constantine", "ксения": "ксюша ksyusha ксеня", "лариса": "лара lara", "лев": "лёва лева lyova", "леонид": "лёня lyonya", "людмила": "люда мила люся lyuda mila", "максим": "макс max maks", "маргарита": "рита rita", "марина": "мариша", "мария": "маша маня masha mary", "михаил": "миша misha michael mike", "надежда": "надя nadya", "наталья": "наташа наталия natasha natalia nathalie", "никита": "никитка nik", "николай": "коля kolya nick nicholas", "нина": "ниночка", "оксана": "ксана", "олег": "олежка", "ольга": "оля olya", "павел": "паша pasha paul", "пётр": "петя petya peter", "полина": "поля polya", "раиса": "рая raya", "роман": "рома roma", "руслан": "русик", "светлана": "света sveta", "семён": "сёма сема syoma", "сергей": "серёжа сережа seryozha serge", "софия": "соня софья sonya sofya sophie", "степан": "стёпа степа styopa", "тамара": "тома toma", "татьяна": "таня tanya", "тимофей": "тима tima timothy", "тимур": "тима", "ульяна": "уля ulya", "фёдор": "федя fedya theodore", "юлия": "юля yulya julia julie", "юрий": "юра yura", "яков": "яша yasha jacob", "яна": "яночка", "ярослав": "слава ярик",
}


#: Latin writings brought together, in this order; one sign for each sound that takes two letters.
_SOUNDS = (("shch", "ш"), ("sch", "ш"), ("sh", "ш"), ("ch", "ч"), ("zh", "ж"), ("kh", "h"), ("ts", "c"), ("tz", "c"), ("alex", "aleks"), ("max", "maks"), ("felix", "feliks"), ("xen", "ksen"), ("oxan", "oksan"), ("x", "h"), ("w", "v"), ("y", "i"))


#: What a Latin initial can stand for.
_INITIAL = {"i": "iяю", "j": "iяюж", "z": "zж", "k": "kh", "s": "sш", "c": "cчk", "t": "tc"}


def _fold(token: str, j: str = "i") -> str:
    """One spelling for the usual ways to write a name part; j is what Latin J is read as."""
    if re.search("[а-яёіїєґ]", token):
        s = "".join(_LETTERS.get(c, c if c.isalpha() else "") for c in token)
        return re.sub("i+", "i", s.replace("iя", "я").replace("iю", "ю"))
    s = "".join(c for c in unicodedata.normalize("NFKD", token) if "a" <= c <= "z")
    for a, b in _SOUNDS:
        s = s.replace(a, b)
    s = re.sub("(?<=.)io", "e", s.replace("j", j)).replace("ie", "e")
    return re.sub("i+", "i", re.sub("i+u", "ю", re.sub("i+a", "я", s)))


def _single(s: str) -> str:
    """Without doubled signs."""
    return re.sub(r"(.)\1+", r"\1", s)


def _wide(s: str) -> str:
    return s.replace("я", "ia").replace("ю", "iu")


class Part(NamedTuple):
    text: str
    #: another reading, where Latin J may be Ж
    other: str
    #: an initial or an abbreviation
    short: bool
    #: first signs of the names it can be short for
    letters: str


def _part(raw: str, short: bool) -> Part | None:
    low = raw.lower()
    text, other = _fold(low), _fold(low, "ж")
    if not text:
        return None
    if len(text) > 1 or re.match("[а-яёіїєґ]", low):
        return Part(text, other, short, "".join(sorted({text[0], other[0]})))
    return Part(text, other, short, _INITIAL.get(low[0], _INITIAL.get(text, text)))


#: Particles of surnames, which writers keep or leave out.
_PARTICLES = frozenset("van von der den ter ten zu de del della di da dos das du la le bin ibn".split())


def parts_of(name: str) -> tuple[Part, ...]:
    spaced = re.sub(r"(?<=[а-яёіїєґa-z])(?=[А-ЯЁІЇЄҐA-Z])", " ", name or "")  # glued initials
    glued = spaced != name
    out: list[tuple[Part | None, bool]] = []
    for m in re.finditer(r"[^\W\d_]+(?:['’`ʼ-][^\W\d_]+)*['’`ʼ]?(\.)?", spaced):
        raw = m[0].rstrip(".")
        if glued and len(raw) == 2 and raw.isupper():
            out += [(_part(c, True), False) for c in raw]
            continue
        cyrillic = len(re.findall("[а-яёіїєґ]", raw, re.I))
        latin = len(re.findall("[a-z]", raw, re.I))
        if cyrillic and latin:
            raw = raw.translate(_LOOK_CYRILLIC if cyrillic >= latin or re.search("[бгджзийлпфцчшщъыьэюя]", raw, re.I) else _LOOK_LATIN)
        out.append((_part(raw, bool(m[1]) and len(raw) <= 5 or len(raw) == 1), raw.lower() in _PARTICLES))
    parts = [x for x in out if x[0]]
    plain = [x for x in parts if not x[1]]
    return tuple(p for p, _ in (plain if len(plain) >= 2 else parts))


def canonical(name: str | None) -> str:
    """The parts of a name as one string; "" for a blank name, "?" for one without letters."""
    if not name or not name.strip():
        return ""
    return " ".join(f"{p.text},{p.other},{p.short:d},{p.letters}" for p in parts_of(name)) or "?"


@lru_cache(maxsize=200_000)
def parsed(form: str) -> tuple[Part, ...]:
    return tuple(Part(t, o, s == "1", x) for t, o, s, x in (p.split(",") for p in form.split(" ") if "," in p))


_NICK: dict[str, set[str]] = {}
for _full, _nicks in _SHORT.items():
    for _n in _nicks.split():
        _NICK.setdefault(_fold(_n), set()).add(_fold(_full))


def profile_name(name: str) -> tuple[str, str, str] | None:
    """(surname, given, patronymic) of a profile; Latin names have the surname last.

    With more than three parts the surname is a compound of those that are left over.
    """
    parts = [p.text for p in parts_of(name)]
    if len(parts) < 2:
        return None
    if re.search("[а-яё]", name, re.I):
        n = max(1, len(parts) - 2)
        return "".join(parts[:n]), parts[n], parts[n + 1] if len(parts) > n + 1 else ""
    return "".join(parts[2:]) or parts[1], parts[0], parts[1] if len(parts) > 2 else ""


@lru_cache(maxsize=400_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Edits with exchange of neighbours; most + 1 if more."""
    if a == b:
        return 0
    # an edit changes the set of letters by two at most
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, two[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@lru_cache(maxsize=400_000)
def _closest(a: str, b: str, most: int) -> int:
    d = distance(a, b, most)
    if d < 2:
        return d
    for way in (_single, _wide):
        x, y = way(a), way(b)
        if (x, y) != (a, b):
            d = min(d, distance(x, y, most))
    return d


def closest(p: Part, full: str, most: int = 3) -> int:
    """Fewest edits between a part and a name over the ways to read them: doubled signs as one, ia for я, J as Ж."""
    d = _closest(p.text, full, most)
    return d if d < 2 or p.other == p.text else min(d, _closest(p.other, full, most))


def _fits(p: Part, full: str, most: int) -> float | None:
    """Cost of reading a part as the given name or patronymic `full`; None if it can't be."""
    if full in (p.text, p.other):
        return 0.0
    if len(p.text) == 1:
        return 0.3 if full[0] in p.letters else None
    if full.startswith((p.text, p.other)) and (p.short or len(p.text) >= 3 and len(full) - len(p.text) >= 2):
        return 0.3 if p.short else 0.6
    if full in _NICK.get(p.text, ()) or full in _NICK.get(p.other, ()):
        return 0.4
    if p.short or len(p.text) < 3:
        return None
    d = closest(p, full, most)
    return 1.0 * d if d <= most else None


@lru_cache(maxsize=400_000)
def _given_cost(p: Part, full: str) -> float | None:
    return _fits(p, full, 1 if max(len(p.text), len(full)) < 7 else 2)


@lru_cache(maxsize=400_000)
def _patronymic_cost(p: Part, full: str) -> float | None:
    return _fits(p, full, 1) if full else None


def _readings(parts: tuple[Part, ...]) -> Iterator[tuple[Part, tuple[Part, ...]]]:
    """Each part that can be the surname, or two neighbouring ones as a compound, and the parts that are left."""
    if len(parts) <= 3:
        for k, p in enumerate(parts):
            if not p.short:
                yield p, parts[:k] + parts[k + 1 :]
    if 3 <= len(parts) <= 4:
        for k, (p, q) in enumerate(zip(parts, parts[1:])):
            if not (p.short or q.short):
                yield Part(p.text + q.text, p.other + q.other, False, p.letters), parts[:k] + parts[k + 2 :]


def agreement(parts: tuple[Part, ...], surname: str, given: str, patronymic: str) -> tuple[float, bool] | None:
    """(cost, sure) of a typed name as a spelling of a profile's name; None if it contradicts it.

    The less of the name is written out, the nearer the surname must be for the reading
    to be sure: two edits with given name and patronymic, one with the given name, none with initials.
    """
    if not 2 <= len(parts) <= 4:
        return None
    best = None
    for p, rest in _readings(parts):
        most = 2 if min(len(p.text), len(surname)) >= 7 else 1
        if abs(len(p.text) - len(surname)) > most + 2:  # ia for я and doubled signs
            continue
        # the given name goes before the patronymic in every usual order
        a = _given_cost(rest[0], given)
        if a is None:
            continue
        b = 0.0 if len(rest) == 1 else _patronymic_cost(rest[1], patronymic)
        if b is None:
            continue
        d = closest(p, surname, most)
        if d > most:
            continue
        written = 0 if rest[0].short else 1 if len(rest) == 1 or rest[1].short else 2
        cost = 1.2 * d + a + b
        if best is None or cost < best[0]:
            best = cost, d <= written
    return best


@lru_cache(maxsize=400_000)
def _match(p: Part, q: Part) -> bool:
    """Whether two parts can stand for one given name or patronymic."""
    if p.text == q.text:
        return True
    if len(p.text) == 1 and len(q.text) == 1:
        return not set(p.letters).isdisjoint(q.letters)
    if q.short or len(q.text) < len(p.text):
        p, q = q, p
    return _fits(p, q.text, 1) is not None or _fits(q, p.text, 1) is not None


@lru_cache(maxsize=100_000)
def _anchors(form: str) -> tuple[tuple[Part, tuple[Part, ...], frozenset[str]], ...]:
    """The readings of a name that leave something beside the surname, with the letters of the surname."""
    return tuple((p, rest, frozenset(p.text)) for p, rest in _readings(parsed(form)) if rest)


def alike(a: str, b: str) -> bool:
    """Whether two typed names (canonical) can be spellings of one name."""
    if a == b:
        return True
    for p, rest, letters in _anchors(a):
        n = len(p.text)
        for q, other, theirs in _anchors(b):
            m = len(q.text)
            most = 2 if n >= 7 and m >= 7 else 1
            # one edit more for signs that are written in two ways
            if abs(n - m) <= most + 2 and len(letters ^ theirs) <= 2 * most + 2 and all(map(_match, rest, other)) and closest(p, q.text, most) <= most:
                return True
    return False


@lru_cache(maxsize=100_000)
def _word_grams(text: str) -> tuple[int, ...]:
    s = f"^{text}$"
    return tuple({zlib.crc32(s[i : i + GRAM].encode()) >> 32 - GRAM_BITS for i in range(max(1, len(s) - GRAM + 1))})


@lru_cache(maxsize=10_000)
def _first_gram(c: str) -> int:
    return zlib.crc32(f"^{c}.".encode()) >> 32 - GRAM_BITS


def grams_of(forms: tuple[str, ...]) -> np.ndarray:
    """Distinct gram numbers of a name over its canonical spellings."""
    out: set[int] = set()
    for form in forms:
        for p in parsed(form):
            if p.short or len(p.text) < 2:
                out.update(map(_first_gram, p.letters))
                continue
            for t in {p.text, p.other} | _NICK.get(p.text, set()) | _NICK.get(p.other, set()):
                out.update(_word_grams(t))
                out.add(_first_gram(t[0]))
    return np.fromiter(sorted(out), np.int64)


class Weights(NamedTuple):
    """Names that hold each gram, and the number of names."""

    count: np.ndarray
    names: int

    def of(self, grams: np.ndarray) -> np.ndarray:
        return np.log1p(1 / np.maximum(RARE, self.count[grams] / max(1, self.names))) ** 2


@lru_cache(maxsize=1)
def _usual() -> tuple[np.ndarray, int]:
    """Counts of the grams of VIRTUAL names that have a common given name and patronymic and no surname.

    They stand for the names that a small table does not hold, so that weights are alike at every size.
    """
    given = list(_SHORT)
    out = np.zeros(1 << GRAM_BITS)
    for i, name in enumerate(given):
        father = re.sub("[аяйьи]+$", "", given[(7 * i + 3) % len(given)])
        out[grams_of((canonical(f"{name} {father}{('ович', 'овна', 'евич', 'евна')[i % 4]}"), ""))] += VIRTUAL / len(given)
    return out, VIRTUAL


def _counted(nodes: DataFrame) -> Weights:
    """Counts over all names, on top of the usual ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [grams_of(f) for f in zip(*(batch.column(c).to_pylist() for c in (1, 2)))]
            g, n = np.unique(np.concatenate([*own, np.full(len(own), -1)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(g, pa.int32()), "n": pa.array(n, pa.int64())})

    usual, names = _usual()
    out = usual.copy()
    for g, n in nodes.mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():  # at most 2 ** GRAM_BITS + 1 rows
        if g < 0:
            names += n
        else:
            out[g] += n
    return Weights(out, names)


_NODE = "node long, c1 string, c2 string, profile boolean"
_POSTING = "cell long, far boolean, node long, c1 string, c2 string, profile boolean, grams binary, left float"
_EDGE = "a long, b long, profile boolean, cosine double, cost double, sure boolean"


def _bits(letters: str) -> int:
    out = 0
    for c in letters:
        out |= 1 << ord(c) % 64  # letters that share a bit only make fewer pairs contradict
    return out


class _Lexicon:
    """Spellings with their readings as numbers, so that contradictions of many pairs are seen at once.

    A spelling has at most five readings (`_readings`): a surname, and one or two parts
    beside it.  What two of these are to each other is looked up once for each two that
    meet, and only if their letters allow it.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.part: dict[str, int] = {}
        self.parts: list[Part] = []
        self._reading, self._plain = array("i"), array("i")
        self._length, self._sets = array("i"), array("Q")
        self._loose, self._ends = array("b"), array("q")
        self._seen = (0, -1)

    def _part(self, form: str) -> int:
        n = self.part.get(form)
        if n is None:
            n = self.part[form] = len(self.parts)
            text, other, short, letters = form.split(",")
            self.parts.append(p := Part(text, other, short == "1", letters))
            nick = _NICK.get(text, set()) | _NICK.get(other, set())
            self._length.append(len(text))
            self._sets.extend((_bits(text), _bits(_wide(text)), _bits(letters) | _bits("".join(x[0] for x in nick))))
            x = _single(_wide(text))
            self._ends.extend((len(x), ord(x[0]), ord(x[-1]), ord(x[0]) << 21 | ord(x[:2][-1]), ord(x[-2:][0]) << 21 | ord(x[-1])))
            self._loose.append(2 if text != other else p.short or len(text) == 1 or bool(nick))
        return n

    def of(self, form: str) -> int:
        """Number of a spelling; -1 for a blank one."""
        if not form:
            return -1
        n = self.number.get(form)
        if n is None:
            n = self.number[form] = len(self.number)
            raw = [x for x in form.split(" ") if "," in x]
            ids = [self._part(x) for x in raw]
            flat = []
            if 2 <= len(ids) <= 3:
                for k, x in enumerate(ids):
                    if not self.parts[x].short:
                        rest = ids[:k] + ids[k + 1 :]
                        flat += (x, rest[0], rest[1] if len(rest) > 1 else -1)
            if 3 <= len(ids) <= 4:
                for k in range(len(ids) - 1):
                    p, q = self.parts[ids[k]], self.parts[ids[k + 1]]
                    if not (p.short or q.short):
                        rest = ids[:k] + ids[k + 2 :]
                        flat += (self._part(f"{p.text}{q.text},{p.other}{q.other},0,{p.letters}"), rest[0], rest[1] if len(rest) > 1 else -1)
            self._reading.extend(flat + [-1] * (15 - len(flat)))
            self._plain.extend((ids + [-1] * 3)[:3])
        return n

    def ready(self) -> None:
        """Before pairs are asked for: what has been numbered, as arrays."""
        if (now := (len(self.number), len(self.parts))) == self._seen:
            return
        self._seen = now
        self.reading, self.plain = np.array(self._reading, np.int32).reshape(-1, 5, 3), np.array(self._plain, np.int32).reshape(-1, 3)
        self.length, self.loose = np.array(self._length, np.int16), np.array(self._loose, np.int8)
        self.ends = np.array(self._ends, np.int64).reshape(-1, 5).T.copy()
        self.letters, self.wide, self.first = np.array(self._sets, np.uint64).reshape(-1, 3).T.copy()

    def _agree(self, how, edits: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """how(p, q) of parts that are at most `edits` apart, or stand for each other by initials, beginnings or short forms."""
        # an edit changes three letters at most, as я and ю count as two; a beginning holds no other letters
        may = np.bitwise_count(self.wide[p] ^ self.wide[q]) <= 3 * edits
        if edits == 1:  # one edit, of four signs at most when я is ia and doubled signs are one, leaves the beginning or the end
            some = np.flatnonzero(may)
            (n, a, b, aa, bb), (m, c, d, cc, dd) = self.ends[:, p[some]], self.ends[:, q[some]]
            n = np.minimum(n, m)
            may[some] = (n < 5) | (np.where(n < 7, a, aa) == np.where(n < 7, c, cc)) | (np.where(n < 7, b, bb) == np.where(n < 7, d, dd))
        x, y = self.letters[p], self.letters[q]
        may |= ((self.first[p] & self.first[q]) > 0) & ((self.loose[p] | self.loose[q] > 0) | (x & ~y == 0) | (y & ~x == 0))
        may |= (self.loose[p] | self.loose[q]) > 1
        some = np.flatnonzero(may)
        code, back = np.unique(p[some].astype(np.int64) << 32 | q[some], return_inverse=True)
        parts = self.parts
        may[some] = np.fromiter((how(parts[c >> 32], parts[c & 0xFFFFFFFF]) for c in code.tolist()), bool, len(code))[back]
        return may

    def _beside(self, how: tuple, n: int, pair: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Which of n pairs have two readings whose parts beside the surname agree, first with first and second with second."""
        out = np.zeros(n, bool)
        for k in (0, 1):
            both = np.flatnonzero((own[:, k] >= 0) & (other[:, k] >= 0))
            good = np.ones(len(pair), bool)
            good[both] = self._agree(*how[k], own[both, k], other[both, k])
            pair, own, other = pair[good], own[good], other[good]
        out[pair] = True
        return out

    def may_be_alike(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Which pairs of typed spellings can still be `alike` when only the letters of surnames have been counted."""
        a, b = self.reading[f], self.reading[g]
        p, q = a[:, :, None, 0], b[:, None, :, 0]
        n, m = self.length[p], self.length[q]
        most = np.where((n >= 7) & (m >= 7), np.int8(2), np.int8(1))
        near = (p >= 0) & (q >= 0) & (np.abs(n - m) <= most + 2)
        near &= np.bitwise_count(self.letters[p] ^ self.letters[q]) <= 2 * most + 2
        pair, r, s = np.nonzero(near)
        return self._beside(((_match, 1), (_match, 1)), len(f), pair, a[pair, r, 1:], b[pair, s, 1:]) | (f == g)

    def may_agree(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Which pairs of a typed spelling and a profile can still be in `agreement` when only the length of surnames has been compared."""
        a, b = self.reading[f], self.plain[g]
        p = a[:, :, 0]
        n, m = self.length[p], self.length[b[:, :1]]
        near = (p >= 0) & (np.abs(n - m) <= np.where(np.minimum(n, m) >= 7, 4, 3))
        near &= (a[:, :, 2] < 0) | (b[:, 2:] >= 0)
        near &= (np.bitwise_count(self.wide[p] ^ self.wide[b[:, :1]]) <= np.where(np.minimum(n, m) >= 7, 6, 3)) | (self.loose[p] > 1)
        pair, r = np.nonzero(near)
        given, patronymic = (lambda x, y: _given_cost(x, y.text) is not None), (lambda x, y: _patronymic_cost(x, y.text) is not None)
        return self._beside(((given, 2), (patronymic, 1)), len(f), pair, a[pair, r, 1:], b[pair, 1:])


@lru_cache(maxsize=1)
def _kept() -> _Lexicon:
    return _Lexicon()


def _lexicon() -> _Lexicon:
    """The worker's lexicon, a new one when it holds enough."""
    if len(_kept().number) > SPELLINGS:
        _kept.cache_clear()
    return _kept()


class _Rows:
    """Rows of whole cells: names with their grams, weights and sketches."""

    def __init__(self, table: pa.Table, weights: Weights):
        self.cell, self.far, self.node, self.profile, self.left = (table.column(c).to_numpy() for c in ("cell", "far", "node", "profile", "left"))
        self.forms = list(zip(table.column("c1").to_pylist(), table.column("c2").to_pylist()))
        packed = table.column("grams").to_pylist()
        self.size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        self.start = np.cumsum(self.size) - self.size
        self.gram = np.frombuffer(b"".join(packed), np.int32).astype(np.int64)  # rarest first
        row = np.repeat(np.arange(len(packed)), self.size)
        w = weights.of(self.gram)
        self.weight = w / np.sqrt(np.bincount(row, w * w, len(packed)))[row]
        self.sketch = np.bincount(row * SKETCH + (self.gram * 40503 >> 7) % SKETCH, self.weight, len(packed) * SKETCH).reshape(-1, SKETCH).astype(np.float32)
        code = row << GRAM_BITS | self.gram
        order = np.argsort(code)
        self.code, self.by_code = code[order], self.weight[order]
        self.lexicon, self.form = _lexicon(), np.full((len(packed), 2), -2, np.int32)

    def candidates(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one cell that sketches and remaining norms don't rule out."""
        edge = np.flatnonzero(np.diff(self.cell)) + 1
        out = []
        for a, b in zip(np.r_[0, edge], np.r_[edge, len(self.cell)]):
            if b - a < 2:
                continue
            cross = (self.cell[a] >> 16 & 0xFFFF) != (self.cell[a] & 0xFFFF)
            rows = np.arange(a, b)
            # the longest norms first, so that those whose product is too small are a tail
            one, two = (x[np.argsort(-self.left[x], kind="stable")] for x in ((rows[~self.far[a:b]], rows[self.far[a:b]]) if cross else (rows, rows)))
            falling = -self.left[two]
            for x in range(0, len(one), 512):
                i, low = one[x : x + 512], 0 if cross else x
                j = two[low : np.searchsorted(falling, -(threshold - 1e-4) / self.left[i[0]], side="right")]
                if not len(j):
                    break
                r, c = np.nonzero(self.sketch[i] @ self.sketch[j].T >= threshold - 1e-5)
                if not cross:
                    r, c = r[c > r], c[c > r]
                i, j = i[r], j[c]
                keep = (self.left[i] * self.left[j] >= threshold - 1e-5) & ~(self.profile[i] & self.profile[j])
                i, j = i[keep], j[keep]
                turn = self.node[i] > self.node[j]  # one order for a pair, whatever the rows'
                out.append((np.where(turn, j, i), np.where(turn, i, j)))
        return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 2

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs given names, patronymics and the lengths of surnames don't show to contradict themselves."""
        new = np.zeros(len(self.form), bool)
        new[i] = new[j] = True
        for k in np.flatnonzero(new & (self.form[:, 0] < -1)).tolist():
            x, y = self.forms[k]
            self.form[k] = self.lexicon.of(x), self.lexicon.of(y)
        self.lexicon.ready()
        turn = self.profile[i]
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        ok, profile = np.ones(len(i), bool), self.profile[j]
        for x in (0, 1):
            for y in (0, 1):
                f, g = self.form[i, x], self.form[j, y]
                for may, own in ((self.lexicon.may_be_alike, ~profile), (self.lexicon.may_agree, profile)):
                    k = np.flatnonzero(ok & own & (f >= 0) & (g >= 0))
                    ok[k] = may(f[k], g[k])
        return ok

    def cosines(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each pair, and whether the cell's gram is the rarest they share (so a pair counts in one cell)."""
        n = self.size[i]
        pair = np.repeat(np.arange(len(i)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[i], n)
        code = j[pair] << GRAM_BITS | self.gram[at]
        p = np.searchsorted(self.code, code)
        p[p == len(self.code)] = 0
        hit = self.code[p] == code
        cosine = np.bincount(pair[hit], self.weight[at[hit]] * self.by_code[p[hit]], len(i))
        first = np.full(len(i), -1)
        first[pair[hit][::-1]] = self.gram[at[hit][::-1]]
        return cosine, first == self.cell[i] >> 32


def _judged(rows: _Rows, i: int, j: int) -> tuple[float, bool] | None:
    """(cost, sure) of a pair that does not contradict itself; cost 0 between typed names."""
    if rows.profile[i]:
        i, j = j, i
    own, other = ([f for f in rows.forms[x] if f] for x in (i, j))
    if rows.profile[j]:
        name = [p.text for p in parsed(other[0])]
        costs = [agreement(parsed(f), name[0], name[1], name[2] if len(name) > 2 else "") for f in own]
        if None in costs or not costs:
            return None
        return round(sum(c for c, _ in costs) / len(costs), 4), any(sure for _, sure in costs)
    return (0.0, False) if all(alike(x, y) for x in own for y in other) else None


def similar_names(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, judged: bool = True) -> DataFrame:
    """(a, b, profile, cosine, cost, sure): all pairs of names with cosine >= threshold that don't contradict each other.

    nodes: (node, c1, c2, profile).  a is a typed name; b is a profile (profile = true)
    or another typed name with a higher number.  judged=False leaves contradictions in.
    """
    spark = nodes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(_counted(nodes))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        blocks = np.clip(np.ceil(weights.count / block), 1, 1 << 16).astype(np.int64)
        for batch in batches:
            cells: list[tuple[int, bool]] = []
            take, grams, left = [], [], []
            for r, (node, forms) in enumerate(zip(batch.column(0).to_pylist(), zip(*(batch.column(c).to_pylist() for c in (1, 2))))):
                g = grams_of(forms)
                if not len(g):
                    continue
                g = g[np.lexsort((g, weights.count[g]))]  # one order for all names: rarest first
                w = weights.of(g)
                rest = np.sqrt(np.cumsum((w * w)[::-1])[::-1] / (w * w).sum())  # norm of what is left from each gram on
                packed = g.astype(np.int32).tobytes()
                for k in np.flatnonzero(rest >= threshold - 1e-6):
                    n = int(blocks[g[k]])
                    mine = zlib.crc32(node.to_bytes(8, "big")) % n
                    for other in range(n):
                        cells.append((int(g[k]) << 32 | min(mine, other) << 16 | max(mine, other), mine > other))
                        take.append(r)
                        grams.append(packed)
                        left.append(rest[k])
            some = batch.take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_pydict({"cell": pa.array([c for c, _ in cells], pa.int64()), "far": pa.array([f for _, f in cells], pa.bool_()), "node": some.column(0), "c1": some.column(1), "c2": some.column(2), "profile": some.column(3), "grams": pa.array(grams, pa.binary()), "left": pa.array(left, pa.float32())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value

        def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = _Rows(table, weights)
            left, right = rows.candidates(threshold)
            for s in range(0, len(left), 100_000):
                i, j = left[s : s + 100_000], right[s : s + 100_000]
                cosine, first = rows.cosines(i, j)
                keep = np.flatnonzero((cosine >= threshold) & first)
                if judged:
                    keep = keep[rows.possible(i[keep], j[keep])]
                out = []
                for x, y, c in zip(*(v[keep].tolist() for v in (i, j, cosine))):
                    if rows.node[x] == rows.node[y] or (found := _judged(rows, x, y) if judged else (0.0, False)) is None:
                        continue
                    if rows.profile[x] or not rows.profile[y] and rows.node[x] > rows.node[y]:
                        x, y = y, x
                    out.append((rows.node[x], rows.node[y], bool(rows.profile[y]), c, *found))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(("a", "b", "profile", "cosine", "cost", "sure"), map(list, zip(*out)))))

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by cell; a cell may go on in the next batch
            held.append(batch)
            size += len(batch)
            table = pa.Table.from_batches(held)
            cell = table.column("cell").to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))
            if whole:
                yield from answer(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield from answer(pa.Table.from_batches(held))

    # Few bytes meet and much work comes of them, so the number of tasks is not left to the size of the input.
    return nodes.mapInArrow(post, _POSTING).repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(search, _EDGE)


def _merge_round(a: np.ndarray, b: np.ndarray, s: np.ndarray, size: np.ndarray, profile: np.ndarray, least: float, top: int):
    """Pairs of groups that are each other's nearest; a, b, s: edges with their summed cosines."""
    mean = s / np.minimum(size[a] * size[b], top * np.minimum(size[a], size[b]))
    ok = np.flatnonzero((mean >= least) & ~((profile[a] >= 0) & (profile[b] >= 0)))
    order = ok[np.lexsort((b[ok], a[ok], -mean[ok]))]
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(size), len(a))
    np.minimum.at(best, a[ok], rank[ok])
    np.minimum.at(best, b[ok], rank[ok])
    return ok[(best[a[ok]] == rank[ok]) & (best[b[ok]] == rank[ok])]


def linkage(a: np.ndarray, b: np.ndarray, s: np.ndarray, size: np.ndarray, profile: np.ndarray, least: float, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Group of each of len(size) items by average linkage, and the profile (or -1) of each group.

    Edges (a < b, summed cosine); groups with a profile each don't merge.  The average is
    over all pairs of two groups, of which one without an edge counts 0, but over no more
    than `top` for each member of the smaller, as no name keeps more.
    """
    group, size, profile = np.arange(len(size)), size.astype(float).copy(), profile.copy()
    while len(a):
        won = _merge_round(a, b, s, size, profile, least, top)
        if not len(won):
            break
        to = np.arange(len(size))
        to[b[won]] = a[won]
        size[a[won]] += size[b[won]]
        profile[a[won]] = np.maximum(profile[a[won]], profile[b[won]])
        group = to[group]
        a, b = to[a], to[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        keep = (a != b) & ~((profile[a] >= 0) & (profile[b] >= 0))
        code, back = np.unique(a[keep] * len(size) + b[keep], return_inverse=True)
        s = np.bincount(back, s[keep], len(code))
        a, b = code // len(size), code % len(size)
    return group, profile[group]


_GROUP = "node long, group long, profile long"


def _in_one_task(edges: DataFrame, least: float, top: int) -> DataFrame:
    """(node, group, profile) for a bounded number of edges (a, b, s, size_a, size_b, profile_a, profile_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if len(x)]
        if not got:
            return
        t = pa.Table.from_batches(got)
        a, b, s, na, nb, pa_, pb = (t.column(i).to_numpy() for i in range(7))
        ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        size, profile = np.ones(len(ids)), np.full(len(ids), -1)
        size[code], profile[code] = np.concatenate([na, nb]), np.concatenate([pa_, pb])
        x, y = code[: len(a)], code[len(a) :]
        group, own = linkage(np.minimum(x, y), np.maximum(x, y), s, size, profile, least, top)
        yield pa.RecordBatch.from_pydict({"node": pa.array(ids), "group": pa.array(ids[group]), "profile": pa.array(own)})

    return edges.coalesce(1).mapInArrow(run, _GROUP)


def grouped_names(edges: DataFrame, least: float = MERGE, top: int = TOP, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, group, profile): average linkage over edges (a, b, profile, cosine); names without an edge are not listed.

    Each round merges all pairs of groups that are each other's nearest.  Rounds are
    joins over the open edges until at most `local` are left, which one task finishes.
    """
    none = F.lit(-1).cast("long")
    open_ = cut(edges.select("a", "b", F.col("cosine").alias("s"), F.lit(1.0).alias("size_a"), F.lit(1.0).alias("size_b"), none.alias("profile_a"), F.when(F.col("profile"), F.col("b")).otherwise(none).alias("profile_b")), "edges")
    names = open_.select(F.col("a").alias("node"), F.col("profile_a").alias("profile")).union(open_.select("b", "profile_b"))
    groups = cut(names.groupBy("node").agg(F.max("profile").alias("profile")).select("node", F.col("node").alias("group"), "profile"), "groups")
    while open_.count() > local:
        mean = F.col("s") / F.least(F.col("size_a") * F.col("size_b"), top * F.least("size_a", "size_b"))
        key = F.struct((-mean).alias("m"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        able = open_.where((mean >= least) & ((F.col("profile_a") < 0) | (F.col("profile_b") < 0))).withColumn("k", key)
        best = able.select(F.explode(F.array("a", "b")).alias("g"), "k").groupBy("g").agg(F.min("k").alias("k"))
        won = best.groupBy("k").agg(F.count("*").alias("n")).where("n = 2").select("k.x", "k.y")
        moves = cut(won.select(F.col("y").alias("was"), F.col("x").alias("now")), "moves")
        if moves.isEmpty():
            break
        facts = open_.select(F.col("a").alias("g"), F.col("size_a").alias("size"), F.col("profile_a").alias("p")).union(open_.select("b", "size_b", "profile_b")).distinct()
        to = facts.join(moves.withColumnRenamed("was", "g"), "g", "left").withColumn("now", F.coalesce("now", "g"))
        to = cut(to.join(to.groupBy("now").agg(F.sum("size").alias("sum"), F.max("p").alias("own")), "now").select("g", "now", "sum", "own"), "sizes")
        side = lambda x: to.select(F.col("g").alias(x), F.col("now").alias(f"now_{x}"), F.col("sum").alias(f"size_{x}"), F.col("own").alias(f"profile_{x}"))
        next_ = open_.select("a", "b", "s").join(side("a"), "a").join(side("b"), "b").where("now_a <> now_b and (profile_a < 0 or profile_b < 0)")
        turn = F.col("now_a") > F.col("now_b")
        pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
        next_ = next_.select(pick("now_a", "now_b").alias("a"), pick("now_b", "now_a").alias("b"), "s", pick("size_a", "size_b").alias("size_a"), pick("size_b", "size_a").alias("size_b"), pick("profile_a", "profile_b").alias("profile_a"), pick("profile_b", "profile_a").alias("profile_b"))
        open_ = cut(next_.groupBy("a", "b").agg(F.sum("s").alias("s"), *[F.first(c).alias(c) for c in ("size_a", "size_b", "profile_a", "profile_b")]), "edges")
        moved = groups.join(to.select(F.col("g").alias("group"), "now", "own"), "group", "left")
        groups = cut(moved.select("node", F.coalesce("now", "group").alias("group"), F.greatest("profile", F.coalesce("own", none)).alias("profile")), "groups")
    rest = _in_one_task(open_, least, top).select(F.col("node").alias("group"), F.col("group").alias("now"), F.col("profile").alias("own"))
    done = groups.join(rest, "group", "left")
    return cut(done.select("node", F.coalesce("now", "group").alias("group"), F.greatest("profile", F.coalesce("own", none)).alias("profile")), "grouped")


class Names(NamedTuple):
    """What the linkage works on: typed spellings and people with the numbers of their names, pairs kept, groups."""

    forms: DataFrame
    people: DataFrame
    edges: DataFrame
    groups: DataFrame


def prepared(profiles: DataFrame, typed: DataFrame, threshold: float = THRESHOLD, least: float = MERGE, top: int = TOP, local: int = LOCAL_EDGES) -> Names:
    """profiles has (person_id, full_name), typed has (name, name_en)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, " ".join(f"{x},{x},0,{x[0]}" for x in p if x)) for i, n in zip(b["person_id"], b["full_name"]) if isinstance(n, str) and (p := profile_name(n))]
            yield pd.DataFrame(rows, columns=["person_id", "c1"])

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(c1=[canonical(x) for x in b["name"]], c2=[canonical(x) for x in b["name_en"]])

    people = cut(profiles.select("person_id", "full_name").where("person_id is not null and full_name is not null").distinct().mapInPandas(read, "person_id long, c1 string"), "people")
    forms = cut(typed.select("name", "name_en").distinct().mapInPandas(spell, "name string, name_en string, c1 string, c2 string"), "forms")
    nodes = people.select("c1", F.lit("").alias("c2"), F.lit(True).alias("profile")).union(forms.select("c1", "c2", F.lit(False))).distinct()
    nodes = Stage(nodes.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "profile"), "names").df
    every = cut(similar_names(nodes, threshold), "pairs")
    # The best partners of each name: profiles by cost, as the check asks for the two cheapest, typed names by cosine.
    by_cost = Window.partitionBy("a").orderBy("cost", F.col("cosine").desc(), "b")
    seeds = every.where("profile").withColumn("_r", F.row_number().over(by_cost)).where(F.col("_r") <= top).drop("_r")
    by_cosine = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    both = every.where("not profile").select("a", "b", "cosine")
    best = both.union(both.select(F.col("b"), F.col("a"), "cosine")).withColumn("_r", F.row_number().over(by_cosine)).where(F.col("_r") <= top)
    others = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("profile"), "cosine").distinct()
    edges = cut(seeds.unionByName(others, allowMissingColumns=True), "kept")
    number = lambda x: nodes.where("profile" if x else "not profile")
    forms = cut(forms.join(number(False).select("node", "c1", "c2"), ["c1", "c2"]).select("node", "name", "name_en"), "numbered")
    people = cut(people.join(number(True).select("node", "c1"), "c1").select("node", "person_id"), "numbered")
    return Names(forms, people, edges, grouped_names(edges, least, top, local))


def link_names(profiles: DataFrame, typed: DataFrame, threshold: float = THRESHOLD, least: float = MERGE, top: int = TOP, local: int = LOCAL_EDGES) -> DataFrame:
    """(name, name_en, person_id) for distinct typed (name, name_en); profiles has (person_id, full_name)."""
    names = prepared(profiles, typed, threshold, least, top, local)
    fit = names.edges.where(F.col("profile") & F.col("sure") & (F.col("cost") <= MAX_COST)).select("a", "b", "cost")
    # One profile explains the name best; at most `top` rows a name.
    fit = fit.withColumn("least", F.min("cost").over(Window.partitionBy("a"))).where("cost <= least + 0.05")
    sole = fit.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1")
    linked = sole.join(names.groups.select(F.col("node").alias("a"), F.col("profile").alias("b")), ["a", "b"]).select(F.col("a").alias("node"), "b")
    alone = names.people.groupBy(F.col("node").alias("b")).agg(F.min("person_id").alias("person_id"), F.countDistinct("person_id").alias("n")).where("n = 1")
    return names.forms.join(linked, "node").join(alone, "b").select("name", "name_en", "person_id")


def name_groups(profiles: DataFrame, typed: DataFrame) -> DataFrame:
    """(name, name_en, class_id, n_links): the group of every typed name, under its first name, and how many names it is alike to."""
    names = prepared(profiles, typed)
    degree = names.edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = names.forms.join(names.groups.select("node", "group"), "node", "left").join(degree, "node", "left")
    found = found.select("name", "name_en", F.coalesce("group", "node").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = found.groupBy("group").agg(F.min(F.when(F.col("name") != "", F.col("name")).otherwise(F.col("name_en"))).alias("class_id"))
    return salted_join(found, first, ["group"], "inner", F.xxhash64("name", "name_en")).select("name", "name_en", "class_id", "n_links")


def unlinked_records(persons: DataFrame, authorships: DataFrame, supervisors: DataFrame) -> DataFrame:
    """(src, rec_id, rec_seq, name, name_en) of the records that name nobody in persons by id."""
    blank = F.lit("")
    a = authorships.where("person_id is null").select(F.lit("authorships").alias("src"), F.col("publication_id").alias("rec_id"), F.col("position").cast("long").alias("rec_seq"), F.coalesce("display_name", blank).alias("name"), F.coalesce("display_name_en", blank).alias("name_en"))
    s = supervisors.where("person_id is not null").join(persons.select("person_id").distinct(), "person_id", "left_anti").select(F.lit("thesis_supervisors").alias("src"), F.col("thesis_id").cast("string").alias("rec_id"), F.col("person_id").alias("rec_seq"), F.coalesce("display_name", blank).alias("name"), blank.alias("name_en"))
    return cut(a.unionByName(s).where("name <> '' or name_en <> ''").distinct(), "records")


def linked_records(persons: DataFrame, authorships: DataFrame, supervisors: DataFrame) -> DataFrame:
    """(src, rec_id, rec_seq, person_id) of the records without a profile whose name means one."""
    records = unlinked_records(persons, authorships, supervisors)
    links = link_names(persons, records)
    # a name can be that of many records
    return salted_join(records, links, ["name", "name_en"], "inner", F.xxhash64("src", "rec_id", "rec_seq")).select("src", "rec_id", "rec_seq", "person_id").distinct()
