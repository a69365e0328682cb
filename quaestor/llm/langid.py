"""Missing or wrong language labels, and languages of the segments of mixed texts.

One interpolated Kneser-Ney character model a language (`kneser_ney`).  The models
start from a short text a language that is part of this module, and are then fitted on
all stored texts with a label, of which only those are used that the first models give,
with a clear margin, the language of their label.  Words are counted where the texts
are; the driver gets a row a language and word.  A fifth of the texts, by the hash of
their key, is held out for the bounds.

A word's cost in a language is its cross-entropy.  A text is cut into segments by the
cheapest path over its words, where a change of language costs SWITCH nats.  Each
segment has the language of lowest length-normalised cross-entropy and a confidence:
the posterior of that language over the segment, times how far the cross-entropy is
inside what held-out text of the language shows.  Beyond that bound the segment is
rejected as "und".  Russian and Ukrainian in Latin letters have models of their own.

Defined results: null and blank texts and texts without letters have no segments and
language null; rows are independent; a publication that repeats counts once; equal
costs go to the language first in LANGUAGES; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.kneser_ney import KneserNey, _points
from quaestor.operators.skew import spread

LANGUAGES = ("ru", "en", "de", "fr", "es", "uk")
SWITCH, PASSAGE, HELD_OUT = 9.0, 5, 5
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CHUNK_CHARS = 1_000_000  # characters of texts that are scored together when models are fitted
LONGEST = 40  # letters that are scored at once; longer runs are scored in pieces

#: First letters of the names a label may use for a language.
LABELS = {"ru": ("рус", "rus", "ru"), "en": ("анг", "eng", "en"), "de": ("нем", "ger", "deu", "de"), "fr": ("фра", "fre", "fra", "fr"), "es": ("исп", "spa", "esp", "es"), "uk": ("укр", "ukr", "uk", "ua")}

#: Seed texts, written for this module.
SEEDS = {
    "ru": "в этой статье мы рассматриваем, как общество и государство влияют на развитие науки и образования. авторы показывают, что результаты исследования зависят от того, какие методы были выбраны и каким образом проводился анализ данных. кроме того, следует отметить, что для решения этой задачи необходимо учитывать опыт других стран, а также особенности культуры, языка и экономики региона. таким образом, можно сделать вывод о том, что новая модель объясняет поведение рынка лучше, чем прежняя теория. однако вопрос о том, почему это происходит, остаётся открытым. при этом они были бы рады, если бы кто-нибудь ещё проверил эти расчёты. человек, который хочет понять свою историю, должен читать книги, говорить с людьми и думать о будущем. мы полагаем, что городская среда определяет качество жизни, хотя не все согласны с этим мнением.",
    "en": "in this paper we consider how society and the state influence the development of science and education. the authors show that the results of the study depend on which methods were chosen and on the way the data were analysed. moreover, it should be noted that solving this problem requires taking into account the experience of other countries as well as the features of culture, language and economy of the region. thus we can conclude that the new model explains the behaviour of the market better than the previous theory. however, the question of why this happens remains open. people who want to understand their history should read books, talk with others and think about the future. we believe that the urban environment shapes the quality of life, although not everyone would agree with that view.",
    "de": "in diesem beitrag betrachten wir, wie die gesellschaft und der staat die entwicklung der wissenschaft und der bildung beeinflussen. die autoren zeigen, dass die ergebnisse der untersuchung davon abhängen, welche methoden gewählt wurden und auf welche weise die daten ausgewertet worden sind. außerdem ist zu beachten, dass für die lösung dieser aufgabe die erfahrungen anderer länder sowie die besonderheiten der kultur, der sprache und der wirtschaft einer region berücksichtigt werden müssen. daher können wir schließen, dass das neue modell das verhalten des marktes besser erklärt als die frühere theorie. die frage, warum das geschieht, bleibt jedoch offen. wer seine geschichte verstehen will, sollte bücher lesen, mit menschen sprechen und über die zukunft nachdenken. wir glauben, dass das städtische umfeld die lebensqualität prägt, obwohl nicht alle dieser meinung sind.",
    "fr": "dans cet article, nous étudions comment la société et l'état influencent le développement de la science et de l'éducation. les auteurs montrent que les résultats de la recherche dépendent des méthodes qui ont été choisies et de la manière dont les données ont été analysées. en outre, il faut noter que pour résoudre ce problème il est nécessaire de tenir compte de l'expérience des autres pays ainsi que des particularités de la culture, de la langue et de l'économie de la région. ainsi, nous pouvons conclure que le nouveau modèle explique mieux le comportement du marché que la théorie précédente. cependant, la question de savoir pourquoi cela se produit reste ouverte. celui qui veut comprendre son histoire doit lire des livres, parler avec les gens et penser à l'avenir. nous croyons que le milieu urbain détermine la qualité de la vie, bien que tous ne soient pas d'accord.",
    "es": "en este artículo estudiamos cómo la sociedad y el estado influyen en el desarrollo de la ciencia y de la educación. los autores muestran que los resultados de la investigación dependen de los métodos que fueron elegidos y de la manera en que se analizaron los datos. además, hay que señalar que para resolver este problema es necesario tener en cuenta la experiencia de otros países, así como las particularidades de la cultura, la lengua y la economía de la región. por lo tanto, podemos concluir que el nuevo modelo explica mejor el comportamiento del mercado que la teoría anterior. sin embargo, la cuestión de por qué sucede esto sigue abierta. quien quiere comprender su historia debe leer libros, hablar con la gente y pensar en el futuro. creemos que el entorno urbano determina la calidad de la vida, aunque no todos están de acuerdo con esta opinión.",
    "uk": "у цій статті ми розглядаємо, як суспільство і держава впливають на розвиток науки та освіти. автори показують, що результати дослідження залежать від того, які методи було обрано і яким чином проводився аналіз даних. крім того, слід зазначити, що для розв'язання цього завдання необхідно враховувати досвід інших країн, а також особливості культури, мови та економіки регіону. таким чином, можна зробити висновок про те, що нова модель пояснює поведінку ринку краще, ніж попередня теорія. однак питання про те, чому це відбувається, залишається відкритим. людина, яка хоче зрозуміти свою історію, повинна читати книги, говорити з людьми й думати про майбутнє. ми вважаємо, що міське середовище визначає якість життя, хоча не всі погоджуються з цією думкою.",
}

#: Latin letters for Cyrillic ones.
_CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ"
_LATIN = ("a", "b", "v", "g", "d", "e", "yo", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "yu", "ya", "i", "yi", "ye", "g")
_ROMAN = str.maketrans(dict(zip(_CYRILLIC, _LATIN)))


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Identifier:
    """The models of all languages and what held-out text of each looks like."""

    def __init__(self, texts: dict[str, list[str]], counts: dict[str, Counter] | None = None):
        """texts and counts: what the models are fitted on, as texts and as how often each word occurs."""
        own = {k: Counter(w[i : i + LONGEST] for t in v for w in _words(t) for i in range(0, len(w), LONGEST)) for k, v in texts.items()}
        for k, words in (counts or {}).items():
            for w, n in words.items():
                for i in range(0, len(w), LONGEST):
                    own[k][w[i : i + LONGEST]] += n
        self.models = [(i, KneserNey(own[k])) for i, k in enumerate(LANGUAGES)]
        for k in ("ru", "uk"):
            roman: Counter = Counter()
            for w, n in own[k].items():
                if (r := w.translate(_ROMAN)) != w:
                    roman[r] += n
            self.models.append((LANGUAGES.index(k), KneserNey(roman)))
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(LANGUAGES)), np.float32)
        self.letters = np.zeros(0, np.float32)
        # cross-entropy a letter beyond which a language is rejected, and its spread
        self.bound = np.full(len(LANGUAGES), 4.2, np.float32)
        self.spread = np.full(len(LANGUAGES), 0.4, np.float32)

    def calibrate(self, held: dict[str, tuple[int, float, float, float]]) -> "Identifier":
        """Sets the rejection bound of each language from texts the models were not fitted on.

        held: number of texts, and sum, sum of squares and maximum of their cross-entropies a letter.
        """
        for i, k in enumerate(LANGUAGES):
            n, total, squares, most = held.get(k, (0, 0.0, 0.0, 0.0))
            if n >= 8:
                self.spread[i] = max(0.15, max(0.0, squares / n - (total / n) ** 2) ** 0.5)
                self.bound[i] = most + 3 * self.spread[i]
        return self

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of `table` of the words; words not met before are scored together."""
        known = self.known
        fresh = list({w for w in words if w not in known})
        if fresh:
            # a run of letters longer than LONGEST is scored in pieces, all of them
            pieces = [(j, w[i : i + LONGEST]) for j, w in enumerate(fresh) for i in range(0, len(w), LONGEST)]
            scores, letters = np.zeros((len(fresh), len(LANGUAGES)), np.float32), np.zeros(len(fresh), np.float32)
            for a in range(0, len(pieces), 20_000):
                part = pieces[a : a + 20_000]
                owner = np.array([j for j, _ in part])
                pts = _points([w for _, w in part])
                s = np.full((len(part), len(LANGUAGES)), -np.inf, np.float32)
                for i, m in self.models:
                    s[:, i] = np.maximum(s[:, i], m.score(pts))
                np.add.at(scores, owner, s)
                np.add.at(letters, owner, np.array([len(w) + 1 for _, w in part], np.float32))
            for w in fresh:
                known[w] = len(known)
            self.table, self.letters = np.concatenate([self.table, scores]), np.concatenate([self.letters, letters])
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def split(self, docs: list[list[str]]) -> list[np.ndarray]:
        """`ids` of each document; the words of all are scored together."""
        flat = self.ids([w for d in docs for w in d])
        ends = np.cumsum([0, *map(len, docs)])
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def forget(self, above: int = 400_000) -> None:
        """Bounds the memory of kept words."""
        if len(self.known) > above:
            self.known, self.table, self.letters = {}, self.table[:0], self.letters[:0]

    def judge(self, ids: np.ndarray) -> tuple[str, float]:
        """Language of one segment and its confidence; "und" if no language fits."""
        s, n = self.table[ids].sum(0, dtype=np.float64), float(self.letters[ids].sum())
        i = int(s.argmax())
        # letters of a text are not independent: the evidence counts at a fifth
        z = np.exp((s - s[i]) / 5.0)
        excess = (-s[i] / n - self.bound[i]) / self.spread[i]
        sure = 1.0 / (1.0 + np.exp(min(50.0, excess)))
        return (LANGUAGES[i] if excess < 6 else "und"), round(float(sure / z.sum()), 4)

    def paths(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Language number of every word of every text, by the cheapest path."""
        out: list = [None] * len(docs)
        order = np.argsort([len(x) for x in docs], kind="stable")
        k = len(LANGUAGES)
        a = 0
        while a < len(order):
            longest = len(docs[order[min(len(order), a + 512) - 1]])
            own = order[a : a + max(1, min(512, 400_000 // max(1, longest)))]
            a += len(own)
            t_n = max(len(docs[i]) for i in own)
            if not t_n:
                for i in own:
                    out[i] = np.zeros(0, np.int8)
                continue
            e = np.zeros((t_n, len(own), k), np.float32)
            for j, i in enumerate(own):
                e[: len(docs[i]), j] = self.table[docs[i]]
            back = np.empty((t_n, len(own), k), np.int8)
            best = e[0]
            stay = np.arange(k, dtype=np.int8)
            for t in range(1, t_n):
                top = best.argmax(1)
                jump = np.take_along_axis(best, top[:, None], 1) - SWITCH
                move = jump > best
                back[t] = np.where(move, top[:, None], stay)
                best = np.where(move, jump, best) + e[t]
            path = np.empty((t_n, len(own)), np.int8)
            cur, rows = best.argmax(1), np.arange(len(own))
            for t in range(t_n - 1, -1, -1):
                path[t] = cur
                if t:
                    cur = back[t, rows, cur]
            for j, i in enumerate(own):
                out[i] = path[: len(docs[i]), j]
        return out


def label_language(label: Column) -> Column:
    """Language that a label names, or null."""
    word = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"[^\p{L}]", ""))
    out = F.lit(None).cast("string")
    for lang, heads in LABELS.items():
        hit = F.lit(False)
        for h in heads:
            hit = hit | (word.startswith(h) if len(h) > 2 else word == h)
        out = F.when(hit, lang).otherwise(out)
    return out


def _labelled(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(lang, t, held) of all texts whose label names a language."""
    rows = spread(df.select(key, text, label)).select(label_language(F.col(label)).alias("lang"), F.col(text).alias("t"), (F.pmod(F.xxhash64(F.col(key)), F.lit(HELD_OUT)) == 0).alias("held"))
    return rows.where("lang is not null and length(trim(t)) >= 40")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str]]]:
    """(lang, text) pairs by about CHUNK_CHARS characters."""
    own: list[tuple[str, str]] = []
    size = 0
    for batch in batches:
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own.append((lang, t))
            size += len(t)
            if size >= CHUNK_CHARS:
                yield own
                own, size = [], 0
    if own:
        yield own


def _confirmed(model: Identifier, rows: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Language and words of the texts to which the models give, with a clear margin, the language of their label."""
    model.forget()
    docs = [_words(t) for _, t in rows]
    ids = model.split(docs)
    return [(lang, d) for (lang, _), d, w, path in zip(rows, docs, ids, model.paths(ids)) if len(w) >= 4 and (path == LANGUAGES.index(lang)).all() and model.judge(w)[1] > 0.3]


def _counted(rows: list[DataFrame], model: Identifier) -> dict[str, Counter]:
    """How often each word occurs in the confirmed texts that are not held out."""
    held = rows[0].sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            words: Counter = Counter()
            for lang, d in _confirmed(held.value, chunk):
                words.update((lang, w) for w in d)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in words], pa.string()), "word": pa.array([w for _, w in words], pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    each = [r.where("not held").select("lang", "t").mapInArrow(count, "lang string, word string, n long") for r in rows]
    out: dict[str, Counter] = {k: Counter() for k in LANGUAGES}
    for lang, w, n in functools.reduce(DataFrame.union, each).groupBy("lang", "word").agg(F.sum("n")).collect():  # a row a language and word
        out[lang][w] = n
    return out


def _held_out(rows: list[DataFrame], model: Identifier, fitted: Identifier) -> dict[str, tuple[int, float, float, float]]:
    """What `calibrate` asks for, of the held-out texts that `model` confirms."""
    both = rows[0].sparkSession.sparkContext.broadcast((model, fitted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own = both.value
        for chunk in _chunks(batches):
            own.forget()
            some = [(lang, d) for lang, d in _confirmed(first, chunk) if len(d) >= PASSAGE]
            x = [-float(own.table[w, LANGUAGES.index(lang)].sum() / own.letters[w].sum()) for (lang, _), w in zip(some, own.split([d for _, d in some]))]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang for lang, _ in some], pa.string()), "x": pa.array(x, pa.float64())})

    each = [r.where("held").select("lang", "t").mapInArrow(score, "lang string, x double") for r in rows]
    got = functools.reduce(DataFrame.union, each).groupBy("lang").agg(F.count("*"), F.sum("x"), F.sum(F.col("x") * F.col("x")), F.max("x")).collect()
    return {r[0]: tuple(r[1:]) for r in got}


def fit(labelled: list[tuple[DataFrame, str, str, str]]) -> Identifier:
    """Models from the seeds and from all texts of (table, key, text, label)."""
    rows = [_labelled(*part) for part in labelled]
    seeds = {k: [v] for k, v in SEEDS.items()}
    model = Identifier(seeds)
    for _ in range(2 if rows else 0):
        fitted = Identifier(seeds, _counted(rows, model))
        model = fitted.calibrate(_held_out(rows, model, fitted))
    return model


_SEGMENTS = "array<struct<lang: string, start: int, end: int, words: int, confidence: double>>"


def segments_of(model: Identifier, texts: list[str | None]) -> list[list[dict]]:
    """Segments of each text; start and end are places of characters in it."""
    model.forget()
    spots = [[(m.start(), m.end()) for m in WORD.finditer(t)] if t else [] for t in texts]
    docs = model.split([[t[a:b].lower() for a, b in s] for t, s in zip(texts, spots)])
    out = []
    for spot, own, path in zip(spots, docs, model.paths(docs)):
        segments = []
        if len(path):
            first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            last = np.r_[first[1:], len(path)]
            for a, b in zip(first, last):
                lang, sure = model.judge(own[a:b])
                if lang != "und":
                    lang = LANGUAGES[path[a]]
                segments.append({"lang": lang, "start": spot[a][0], "end": spot[b - 1][1], "words": int(b - a), "confidence": sure})
        out.append(segments)
    return out


def identify(df: DataFrame, columns: list[str], model: Identifier) -> DataFrame:
    """Adds <column>_segments for each text column."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_SEGMENTS)
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held.value
        for batch in batches:
            yield pd.Series(segments_of(own, [x if isinstance(x, str) else None for x in batch]))

    return spread(df).withColumns({f"{c}_segments": segment(F.col(c)) for c in columns})


def main_language(segments: Column) -> Column:
    """The language with the most words, as struct(lang, confidence)."""
    best = F.array_max(F.transform(segments, lambda s: F.struct(s["words"].alias("w"), s["confidence"].alias("c"), s["lang"].alias("l"))))
    return F.struct(best["l"].alias("lang"), best["c"].alias("confidence"))


def models_for(publications: DataFrame, documents: DataFrame | None) -> Identifier:
    parts = [(publications, "id", "title", "language")]
    if documents is not None:
        parts.append((documents, "doc_id", "text", "lang"))
    return fit(parts)


def _segmented(publications: DataFrame, documents: DataFrame | None) -> DataFrame:
    rows = publications.select("id", "title", "language", "abstract_ru", "abstract_en").where(F.col("id").isNotNull())
    return identify(rows, ["title", "abstract_ru", "abstract_en"], models_for(publications, documents))


def _foreign(field: str, lang: str) -> Column:
    """Passages of a field in another language than its own."""
    found = F.filter(F.col(f"{field}_segments"), lambda s: (s["words"] >= PASSAGE) & (s["lang"] != lang) & (s["lang"] != "und"))
    named = F.transform(found, lambda s: F.struct(F.lit(field).alias("field"), s["lang"].alias("lang")))
    return F.coalesce(named, F.array().cast("array<struct<field:string,lang:string>>"))


def _segment_rows(field: str) -> Column:
    return F.transform(F.col(f"{field}_segments"), lambda s: F.struct(F.lit(field).alias("field"), s["start"].alias("start"), s["end"].alias("end"), s["lang"].alias("lang"), s["confidence"].alias("confidence")))


def label_cases(publications: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(publication_id, field, lang): wrong or missing labels, and passages in another language than the field's."""
    seg = _segmented(publications, documents)
    title = main_language(F.col("title_segments"))["lang"]
    wrong = F.when(title.isNotNull() & ~F.coalesce(label_language(F.col("language")) == title, F.lit(False)), F.array(F.struct(F.lit("language").alias("field"), title.alias("lang")))).otherwise(F.array().cast("array<struct<field:string,lang:string>>"))
    parts = [wrong, _foreign("abstract_ru", "ru"), _foreign("abstract_en", "en")]
    cases = seg.select("id", F.explode(F.concat(*parts)).alias("c"))
    return cases.select(F.col("id").alias("publication_id"), "c.field", "c.lang").distinct()


def publication_languages(publications: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row a publication's title and one a segment of its abstracts: (publication_id, field, start, end, lang, confidence)."""
    seg = _segmented(publications, documents)
    head = main_language(F.col("title_segments"))
    rows = [F.array(F.struct(F.lit("title").alias("field"), F.lit(0).alias("start"), F.length("title").alias("end"), head["lang"].alias("lang"), head["confidence"].alias("confidence"))), _segment_rows("abstract_ru"), _segment_rows("abstract_en")]
    got = seg.select("id", F.explode(F.concat(*rows)).alias("c"))
    return got.select(F.col("id").alias("publication_id"), "c.*").distinct()
