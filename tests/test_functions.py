import math

import pytest
from pyspark.sql import functions as F

from quaestor.functions import html, nested, profile_text, text, vector
from quaestor.plans.samples import PAGE


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(c.alias("y")).head()[0]


X = F.col("x")


@pytest.mark.parametrize(("raw", "want"), [(" a\t b \n", "a b"), (None, ""), ("", ""), ("  ", "")])
def test_clean_whitespace(spark, raw, want):
    assert one(spark, text.clean_whitespace(X), raw) == want


def test_clean_text_null(spark):
    assert one(spark, text.clean_text(X), None) is None and one(spark, text.clean_text(X), "") is None and one(spark, text.strip(X), "  a \t") == "a"


@pytest.mark.parametrize(("url", "want"), [("https://x.org/staff/12?a=1", 12), ("https://x.org/org/persons/7", 7), ("https://x.org/people/7", None), ("https://x.org/staff/abc", None), (None, None)])
def test_person_id_from_url(spark, url, want):
    assert one(spark, text.person_id_from_url(X), url) == want


def test_narrow_and_tail_ids(spark):
    assert one(spark, text.supervisor_id_from_url(X), "/staff/5") is None and one(spark, text.supervisor_id_from_url(X), "/org/persons/5") == 5
    assert one(spark, text.numeric_tail(X), "https://x.org/a/5/?q#f") == 5 and one(spark, text.numeric_tail(X), "https://x.org/a5") is None


@pytest.mark.parametrize(("u", "want"), [("http://a", "http://a"), ("/x", "https://b/x"), ("x", "https://b/x"), ("", None), (None, None)])
def test_absolutize(spark, u, want):
    assert one(spark, text.absolutize(X, "https://b"), u) == want


@pytest.mark.parametrize(("raw", "want"), [("A, B,  C:", ["A", "B", "C"]), ("руководитель департамента, профессор:", ["руководитель департамента", "профессор"]), ("", []), (":", []), (None, [])])
def test_position_titles(spark, raw, want):
    assert one(spark, text.position_titles(X), raw) == want and profile_text.position_titles(raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1, 2 | 3;4/5", ["1", "2", "3", "4", "5"]), (None, []), (" , ", [])])
def test_phones(spark, raw, want):
    assert one(spark, text.phone_list(X), raw) == want and profile_text.phone_parts(raw) == want


@pytest.mark.parametrize(("q", "value", "hit"), [("рын", "Новый РЫНОК", True), ("a_c", "xabcx", True), ("a%c", "a123c", True), ("a\\c", "xa\\cx", True), ("a\\c", "xacx", False)])
def test_wildcards_of_users_count(spark, q, value, hit):
    assert one(spark, text.contains_ci(X, q), value) is hit


def test_wildcards_escaped(spark):
    assert one(spark, text.contains_ci(X, "a_c", escape=True), "abc") is False and one(spark, text.contains_ci(X, "50%", escape=True), "до 50% и") is True


def test_trigram_similarity(spark):
    sim = lambda a, b: one(spark, text.trigram_similarity(X, F.lit(b)), a)
    assert sim("word", "word") == 1 and sim("word", "two words") == pytest.approx(4 / 11) and sim("", "") == 0 and sim("a-b", "b a") == 1 and sim("кот", "xyz") == 0


@pytest.mark.parametrize(("t", "want"), [("привет мир", "ru"), ("hello world", "en"), ("привет world", "mixed"), ("12 34", "ru"), ("", "ru"), ("аааа" + "b", "mixed"), ("аааааааа" + "b", "ru")])
def test_script_language(spark, t, want):
    assert one(spark, text.script_language(X), t) == want


def test_tags(spark):
    assert one(spark, text.normal_tag(X), "  «Учёт  и аудит»,") == "учет и аудит"
    assert one(spark, text.numeric_ratio(X), "2020") == 1 and one(spark, text.numeric_ratio(X), "") == 0 and one(spark, text.numeric_ratio(X), "ab12") == 0.5
    assert one(spark, text.names_organisation(X), "рана") is False and one(spark, text.names_organisation(X), "отдел ран") is True and one(spark, text.names_organisation(X), "школы россии") is True
    assert one(spark, text.without_substrings(X), ["обучение", "машинное обучение", "сеть", "сеть"], "array<string>") == ["машинное обучение", "сеть"]
    assert one(spark, text.word_ngrams(X, 2), ["a", "b", "c"], "array<string>") == ["a b", "b c"] and one(spark, text.word_ngrams(X, 4), ["a"], "array<string>") == []


@pytest.mark.parametrize(("raw", "want"), [("Факультет компьютерных наук", "компьютерных наук"), ("Институт статистики им. Е. М. Иванова", "статистики"), ("ВШЭ", ""), (None, ""), ("Высшая школа права", "права")])
def test_topical_unit(spark, raw, want):
    assert one(spark, text.topical_unit(X), raw) == want


@pytest.mark.parametrize(("q", "want"), [("Иванов", True), ("Иванов И.", True), ("Иванов И.И.", True), ("иванов", True), ("рын", False), ("теория графов", False), ("Иванов Иван Иванович Младший", False), ("", False)])
def test_looks_like_name(q, want):
    assert text.looks_like_name(q) is want


def test_display(spark):
    assert one(spark, text.grouped_number(X), 1234567, "long") == "1 234 567" and one(spark, text.display_time(X.cast("timestamp")), None) == "—"
    assert one(spark, text.display_time(X.cast("timestamp"), True), "2025-01-02 03:04:05") == "2025-01-02 03:04:05 UTC"


@pytest.mark.parametrize(("raw", "want"), [("Премия (2010–2012 гг.)", ("Премия", 2010, 2012)), ("Медаль, (2015)", ("Медаль", 2015, None)), ("Без года", ("Без года", None, None)), ("", ("", None, None))])
def test_awards(raw, want):
    assert tuple(profile_text.award_fields(raw).values()) == want


def test_grants_and_editorial():
    g = profile_text.grant_fields("Тема. Номер: 15-01, 2015 г. – 2017 г.")
    assert (g["number"], g["years"]) == ("15-01", {"start": 2015, "end": 2017})
    assert profile_text.grant_fields("Тема (2023–2026 гг.)") == {"text": "Тема (2023–2026 гг.)", "number": None, "years": {"start": 2026, "end": 2026}}
    assert profile_text.grant_fields("Проект 2019–2021")["years"] == {"start": 2019, "end": 2021} and profile_text.grant_fields("x")["years"] is None
    e = profile_text.editorial_fields("С 2012 г.: журнал «Право и  жизнь»")
    assert (e["start_year"], e["journal"]) == (2012, "Право и жизнь")


@pytest.mark.parametrize(("raw", "want"), [
    ("2001", [("2001", "")]), ("с 01.2001 г. по", [("01.2001 г.", "")]), ("2001-2005: А; 2006 - по настоящее время Б", [("2001-2005", "А"), ("2006 - по настоящее время", "Б")]),
    ("12001 и 20012 и 1.2.2001", []), ("2010 г. – н.в. Декан", [("2010 г. – н.в.", "Декан")]), ("2015 гость", [("2015", "гость")]), ("Отчёт2001 год", [("2001", "")])])
def test_periods(raw, want):
    got = [(raw[a:b], raw[b:c].strip(" ,.;:—–-")) for (a, b), c in zip(profile_text.periods(raw), [x for x, _ in profile_text.periods(raw)[1:]] + [None])]
    assert [y for y, _ in got] == [y for y, _ in want]


def test_experience():
    f = profile_text.experience_entries
    assert f("09.2010–2014 г. Доцент; 2015 – н.в. Профессор") == [{"years": "09.2010–2014 г.", "position": "Доцент"}, {"years": "2015 – н.в.", "position": "Профессор"}]
    assert f("Банк, 2005 Аналитик") == [{"years": "2005", "position": "Банк Аналитик"}] and f("Просто текст") == [{"years": "", "position": "Просто текст"}] and f(None) == []


@pytest.mark.parametrize(("raw", "year", "want"), [
    ("2015: Форум (Москва). Доклад: О рынке", None, (2015, "Форум", "Москва", "О рынке")), ("2015: Форум. Доклад: О рынке", None, (2015, "Форум", None, "О рынке")),
    ("2015. Форум (Москва).", None, (2015, "Форум", "Москва", None)), ("2015: Форум", None, (2015, "Форум", None, None)), ("Форум", None, (None, "Форум", None, None)),
    ("Форум (Тула). Доклад: X", 2011, (2011, "Форум", "Тула", "X")), ("Форум. Доклад: X", 2011, (2011, "Форум", None, "X")), ("Форум (Тула)", 2011, (2011, "Форум", "Тула", None)), ("", 2011, (2011, None, None, None))])
def test_conferences(raw, year, want):
    assert tuple(profile_text.conference_fields(raw, year).values()) == want


POS = "array<struct<title:string,units:array<struct<name:string,url:string>>>>"


@pytest.mark.parametrize(("title", "want"), [("Доцент", True), ("Академический руководитель", True), ("академическая руководительница", True), ("менеджер", False), (None, False)])
def test_teaches(spark, title, want):
    assert one(spark, nested.teaches(X), [(title, [])], POS) is want


def test_nested(spark):
    p = [("доцент", [(" Кафедра А ", None), ("Б", None)]), (None, None), ("x", [("Б", None), (None, None)])]
    assert one(spark, nested.extra_units(X, F.lit("Кафедра А")), p, POS) == ["Б"] and one(spark, nested.primary_unit(X), p, POS) == " Кафедра А "
    assert one(spark, nested.works_in(X, "кафедра"), p, POS) is True and one(spark, nested.works_in(X, "в"), None, POS) is False and one(spark, nested.primary_unit(X), [], POS) is None


def test_matched_topics(spark):
    df = spark.createDataFrame([(["теория графов", "графы", "a"], ["граф", "линейный график"]), (["граф 1", "граф 2", "граф 3"], ["график"]), (None, None)], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(nested.matched_topics("по граф", F.col("a"), F.col("b"))).collect()]
    assert got == [["теория графов", "графы", "линейный график"], ["граф 1", "граф 2", "граф 3"], []]
    assert df.select(nested.matched_topics("на", F.col("a"), F.col("b"))).head()[0] == []


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0])], "id int, v array<float>")
    ok = [r.id for r in df.where(vector.usable(F.col("v"), 2)).collect()]
    assert ok == [1, 2, 3]
    c = df.where("id = 2").select(vector.cosine(F.col("v"), vector.constant([1, 0]))).head()[0]
    assert c == pytest.approx(math.sqrt(0.5))
    near = vector.vector_top_k(df, "id", "v", [1.0, 0.0], 5).collect()
    assert [(r.id, r.score) for r in near] == [(1, 1.0), (3, 1.0), (2, 0.707107)] and vector.vector_top_k(df, "id", "v", [1.0, 0.0], 5, 2).head().id == 2
    assert df.where("id = 5").select(vector.cosine(F.col("v"), F.col("v"))).head()[0] is None
    assert [one(spark, vector.score_tier(X), s, "double") for s in (0.6, 0.45, 0.3, 0.29, None)] == ["strong", "medium", "weak", None, None]


def test_page_sections(spark):
    pages = spark.createDataFrame([("https://x.org/staff/1", PAGE), ("https://x.org/staff/42", "<p>нет разметки"), ("u", None)], "url string, html string")
    r = {x.url: x for x in html.parse_pages(pages).collect()}
    p = r["https://x.org/staff/1"]
    assert (p.person_id, p.full_name, p.avatar, p.languages) == (55, "Иванов Иван", "https://portal.example.org/a.jpg", ["английский", "немецкий"])
    assert (p.contacts.phones, p.contacts.address, p.contacts.hours) == ("123 | 456", "Мира, 1", "пн 10-12")
    assert p.research_ids == {"ID": "77", "Реестр": "https://portal.example.org/y"} and (p.managers[0].person_id, p.managers[0].role) == (9, "декан")
    assert [x.title for x in p.positions] == ["доцент", "профессор"] and p.positions[1].units[0].name == "Кафедра"
    assert (p.degrees[0].year, p.degrees[0].text) == (2001, "Кандидат") and p.interests[0].label == "рынок" and [(e.year, e.text) for e in p.extra_education] == [(2010, "Курс А"), (2010, "Курс Б")]
    assert p.awards == ["Медаль (2015)"] and p.work_experience == ["2001–2005: Банк"]
    assert (p.courses[0].title, p.courses[0].academic_year, p.courses[0].meta, p.courses[0].language, len(p.courses)) == ("Право", "2024/2025", "Бакалавриат; 1 курс", "рус", 1)
    assert (p.grants[0].number, p.grants[0].years.start) == ("7", 2015) and p.editorial_staff[0].journal == "Журнал"
    assert [(c.year, c.title, c.location, c.talk_title) for c in p.conferences] == [(2014, "Форум", "Тула", "X"), (2014, "Съезд", None, None), (None, "Круг", None, None)]
    assert (p.patents[0].title, p.patents[0].number.url, p.patents[0].year, p.patents[0].authors) == ("Способ", "https://portal.example.org/p", 2019, ["А", "Б", "В"])
    assert r["https://x.org/staff/42"].person_id == 42 and r["https://x.org/staff/42"].positions == [] and r["u"].person_id is None


def test_second_layouts():
    two = html.profile('<div class="main__inner"><div class="b-person-data" tab-node="conferences"><ul><li class="li2"><p class="text">Форум, 2014 г.<p class="text">Доклад: О рынке<p class="text">Съезд</ul></div><div class="b-person-data" tab-node="grants"><ol><li>Тема (2023–2026)</ol></div></div>')
    assert [(c["year"], c["talk_title"]) for c in two["conferences"]] == [(2014, "О рынке"), (None, None)] and two["grants"][0]["years"] == {"start": 2023, "end": 2026}
