import numpy as np
import pytest

from quaestor.llm.kneser_ney import KneserNey, _points
from quaestor.llm.langid import LANGUAGES, SEEDS, Identifier, fit, label_cases, label_language, publication_languages, segments_of

RU = "Показано, что рынок меняет среду, а новая модель объясняет поведение людей в городе. "
EN = "The authors claim that the new model explains how people behave in the city and why. "
FR = "Les auteurs montrent que la méthode dépend de la culture et de la langue du pays. "
UK = "Автори показують, що нова модель пояснює поведінку людей у місті та державі. "
COLS = "id string, title string, language string, abstract_ru string, abstract_en string, lang string, field string"


@pytest.fixture(scope="module")
def model():
    return fit([])


def pubs(spark, *rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLS)


def test_probabilities_sum_to_at_most_one():
    m = KneserNey({"abab": 3, "abc": 2, "b": 1})
    ends = [f"ab{c}" for c in "abcdefgh"]
    assert np.exp(m.score(_points(["ab"]))).sum() < 1 and np.exp(m.score(_points(ends))).sum() < 1


def test_seen_words_are_likelier():
    m = KneserNey({"модель": 5, "рынок": 5})
    a, b = m.score(_points(["модель", "qwxzjk"]))
    assert a > b


@pytest.mark.parametrize(("text", "lang"), [(RU, "ru"), (EN, "en"), (FR, "fr"), (UK, "uk")])
def test_segments_of_one_language(model, text, lang):
    s = segments_of(model, [text * 3])[0]
    assert [x["lang"] for x in s] == [lang] and s[0]["confidence"] > 0.3


def test_mixed_text_is_cut_where_the_language_changes(model):
    text = RU + FR + RU
    s = segments_of(model, [text])[0]
    assert [x["lang"] for x in s] == ["ru", "fr", "ru"] and text[s[1]["start"] : s[1]["end"]].startswith("Les auteurs")


def test_borrowed_terms_and_empty_texts(model):
    got = segments_of(model, [RU + "(deep learning models) " + RU, None, "", "12 345 —", "слово " * 30_000])
    assert not any(x["words"] >= 5 and x["lang"] != "ru" for x in got[0]) and got[1] == got[2] == got[3] == [] and got[4][0]["words"] == 30_000


def test_romanised_russian_is_russian(model):
    s = segments_of(model, ["Avtory pokazyvayut, chto novaya model obyasnyaet povedenie rynka luchshe, chem prezhnyaya teoriya."])[0]
    assert {x["lang"] for x in s} == {"ru"}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("рус", "Русский ", "RUS", "англ", "und", None, "", "—", "Deutsch?", "uk", "исп")], "x string")
    assert [r[0] for r in df.select(label_language(df.x)).collect()] == ["ru", "ru", "ru", "en", None, None, None, None, "de", "uk", "es"]


def test_cases(spark):
    df = pubs(spark, ("1", RU, "рус", RU, EN), ("2", RU, "en", RU + FR, None), ("3", EN, None, None, EN + RU), ("4", " ", "en", "", ""), ("2", RU, "en", RU + FR, None), (None, EN, "ru", None, None))
    got = sorted(tuple(r) for r in label_cases(df).collect())
    assert got == [("2", "abstract_ru", "fr"), ("2", "language", "ru"), ("3", "abstract_en", "ru"), ("3", "language", "en")]


def test_every_segment_has_language_and_confidence(spark):
    rows = publication_languages(pubs(spark, ("1", RU, "рус", RU + FR, EN))).collect()
    assert {(r.field, r.lang) for r in rows} == {("title", "ru"), ("abstract_ru", "ru"), ("abstract_ru", "fr"), ("abstract_en", "en")} and all(0 <= r.confidence <= 1 for r in rows)
    assert label_cases(pubs(spark, ("1", RU, "рус", RU, EN)).where("id = 'x'")).count() == 0


def test_seeds_cover_the_languages():
    assert set(SEEDS) == set(LANGUAGES)


def test_a_run_of_letters_is_scored_to_its_end():
    model = Identifier({k: [v] for k, v in SEEDS.items()})
    a, b = "экономическаядинамикарынкатруда" * 2, "theeconomicdynamicsofthelabourmarketandthestate" * 6
    whole, head, tail = model.ids([a[:40] + b, a[:40], b])
    assert model.letters[whole] == pytest.approx(model.letters[head] + model.letters[tail], abs=len(b) / 40 + 1)
    assert LANGUAGES[int(model.table[whole].argmax())] == "en" and LANGUAGES[int(model.table[head].argmax())] == "ru"


def test_models_are_fitted_on_all_texts_and_whole(spark):
    plain = "in this paper we consider how society and the state influence the development of science " + "and education of the region " * 60
    rows = [(i, plain + "zorblatting" * (i % 20 == 1), "en") for i in range(400)]  # in a few texts, far from their beginning
    model = fit([(spark.createDataFrame(rows, "id long, text string, lang string"), "id", "text", "lang")])
    w = model.ids(["zorblatting"])
    assert -model.table[w, LANGUAGES.index("en")].sum() / model.letters[w].sum() < 1.5
