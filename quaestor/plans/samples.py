"""A profile page and service items in small, with what is read from them.

The queries over them check page parsing and JSON reading against values written by hand.
"""

from __future__ import annotations

PAGE = """<div class="l-extra js-mobile_menu_content is-desktop"><div><div class="person-avatar" style="background:url('/a.jpg')"></div>
<dl class="main-list-language-knowledge-level"><dt>Языки<dd>английский<dd> немецкий </dl>
<dl class="main-list"><dt>Контакты</dt><dd>Телефон:<br>123, 456</dd><dd class="address-with-hours">Адрес: Мира, 1 Время присутствия: пн 10-12</dd></dl>
<dl class="person-extra-indent"><dd><span class="b">ID</span>: <a href="/x">77</a></dd><dd><a href="/y">Реестр</a></dd></dl>
<dl class="colleagues"><dd><a href="/org/persons/9">Петров</a><span class="grey">декан</span></dd></dl>
<dl class="person-extra-indent-timetable"><dd><a class="link" href="/tt">Расписание</a></dd></dl></div></div>
<script data-person-id="55"></script><div class="main__inner"><h1 class="person-caption"> Иванов  Иван </h1>
<ul class="employment-add"><li><span class="person-appointment-title">доцент, профессор:</span><a class="link" href="/u">Кафедра</a><li><i>без должности</i></ul>
<ul class="person-employment-addition"><li>Начал работать в 2003 году.</ul>
<div class="b-person-data" tab-node="sci-degrees1"><div class="g-list_closer"><div class="with-indent"><div class="person-list-hangover">2001</div>Кандидат</div></div></div>
<div class="b-person-data" tab-node="sci-intrests"><a class="tag" href="/t">рынок</a></div>
<div class="b-person-data" tab-node="additional_education"><p><strong>2010</strong></p><ul><li>Курс А<li>Курс Б</ul></div>
<div class="b-person-data" tab-node="awards"><ul class="g-list"><li>- Медаль (2015)</ul></div>
<div class="b-person-data" tab-node="experience"><div class="with-indent"><p class="text">2001–2005 Банк</p></div></div>
<div class="edu-courses"><h2>Курсы 2024/2025</h2><ul class="g-list"><li><a class="link" href="/edu/courses/1">Право</a> (Бакалавриат; 1 курс) <span class="language-label">рус</span></li><li><span class="edu-courses-archive-toogle">архив</span></li></ul></div>
<h2>Гранты и проекты</h2><div><p class="text">Тема. Номер: 7, 2015 г.</p></div><h2>Участие в редколлегиях</h2><div><p class="text">С 2012 г.: «Журнал»</p></div>
<div class="b-person-data" tab-node="conferences"><ul class="g-list_closer"><li class="li2"><div class="person-list-hangover">2014</div><p>Форум (Тула). Доклад: X</p></li><li class="li2"><p>Съезд</p></li><li class="li2"><div class="person-list-hangover">??</div><p>Круг</p></li></ul></div>
<div class="b-person-data" tab-node="patents"><table class="patent_table"><tr class="patent_table__item"><td data-title="Наименование РИД">Способ<td data-title="Номер РИД"><a href="/p">N1</a><td data-title="Сведения о регистрации">от 01.02.2019<td data-title="Авторы">А, Б; В</tr></table></div></div>"""

URL = "https://x.org/staff/1"

#: (section, value): what the page says, a nested value as JSON without its nulls.
SECTIONS = [
    ("person_id", "55"), ("full_name", "Иванов Иван"), ("avatar", "https://portal.example.org/a.jpg"), ("languages", '["английский","немецкий"]'),
    ("contacts", '{"phones":"123 | 456","address":"Мира, 1","hours":"пн 10-12","timetable_url":"https://portal.example.org/tt"}'),
    ("research_ids", '{"ID":"77","Реестр":"https://portal.example.org/y"}'),
    ("managers", '[{"person_id":9,"name":"Петров","url":"https://portal.example.org/org/persons/9","role":"декан"}]'),
    ("positions", '[{"title":"доцент","units":[{"name":"Кафедра","url":"https://portal.example.org/u"}]},{"title":"профессор","units":[{"name":"Кафедра","url":"https://portal.example.org/u"}]}]'),
    ("notes", '["Начал работать в 2003 году."]'), ("degrees", '[{"year":2001,"text":"Кандидат"}]'), ("interests", '[{"label":"рынок","url":"https://portal.example.org/t"}]'),
    ("extra_education", '[{"year":2010,"text":"Курс А"},{"year":2010,"text":"Курс Б"}]'), ("awards", '["Медаль (2015)"]'), ("work_experience", '["2001–2005: Банк"]'),
    ("courses", '[{"title":"Право","url":"https://portal.example.org/edu/courses/1","academic_year":"2024/2025","language":"рус","meta":"Бакалавриат; 1 курс"}]'),
    ("grants", '[{"text":"Тема. Номер: 7, 2015 г.","number":"7","years":{"start":2015,"end":2015}}]'), ("editorial_staff", '[{"text":"С 2012 г.: «Журнал»","start_year":2012,"journal":"Журнал"}]'),
    ("conferences", '[{"description":"Форум (Тула). Доклад: X","links":[],"year":2014,"title":"Форум","location":"Тула","talk_title":"X"},{"description":"Съезд","links":[],"year":2014,"title":"Съезд"},{"description":"Круг","links":[],"title":"Круг"}]'),
    ("patents", '[{"title":"Способ","number":{"text":"N1","url":"https://portal.example.org/p"},"registration":{"text":"от 01.02.2019"},"authors":["А","Б","В"],"year":2019}]'),
]

#: Lines of profile pages and what their normalisers make of them.
LINES = [
    ("position_titles", "доцент, профессор:,", '["доцент", "профессор"]'), ("phone_parts", "12-34; 56 / 78|9", '["12-34", "56", "78", "9"]'),
    ("experience_entries", "Банк 09.2010–2014 г. Доцент; 2015 – н.в. Профессор", '[{"years": "09.2010–2014 г.", "position": "Банк Доцент"}, {"years": "2015 – н.в.", "position": "Профессор"}]'),
    ("conference_fields", "2015: Форум (Москва). Доклад: О рынке", '{"year": 2015, "title": "Форум", "location": "Москва", "talk_title": "О рынке"}'),
    ("conference_fields", "2015. Форум (Москва).", '{"year": 2015, "title": "Форум", "location": "Москва", "talk_title": null}'),
    ("conference_fields", "Форум без года", '{"year": null, "title": "Форум без года", "location": null, "talk_title": null}'),
    ("award_fields", "Премия (2010–2012 гг.)", '{"title": "Премия", "year_from": 2010, "year_to": 2012}'), ("award_fields", "Медаль, (2015)", '{"title": "Медаль", "year_from": 2015, "year_to": null}'),
    ("grant_fields", "Проект 2019–2021", '{"text": "Проект 2019–2021", "number": null, "years": {"start": 2019, "end": 2021}}'),
    ("editorial_fields", "С 2012 г.: журнал «Право»", '{"text": "С 2012 г.: журнал «Право»", "start_year": 2012, "journal": "Право"}'),
]

PUBLICATIONS = [
    """{"id": "p1", "title": "О рынке", "type": "ARTICLE", "year": 2021, "language": {"name": "рус"}, "createdAt": "2021-05-01T10:20:30Z", "annotation": {"ru": "&lt;p&gt;Текст &amp; разбор&lt;/p&gt;", "en": " "},
        "description": {"api": "<i>Журнал</i> права", "main": "Цитата &#8212; 1"}, "publisher": {"title": {"ru": "Дом  книги"}},
        "documents": {"DOI": {"href": "https://doi.example.org/10.1/x"}, "DOCUMENT": {"href": "/d/1.pdf"}, "COVER": {"href": "/c.png"}},
        "authorsByType": {"author": [{"id": "55", "title": {"ru": "Иванов Иван", "en": " Ivan Ivanov "}, "href": "/staff/55", "enVersionStatus": 2}, "Без карточки", {"id": "x9", "title": "Петров &amp; Ко", "altName": "П."}, {"altName": "Третий"}],
            "sci_editor": [{"id": "7", "title": {"en": "Ed Itor"}, "href": "https://x.org/7", "enVersionStatus": "2"}], "cmn_editor": [{"id": "8", "title": "Редактор", "enVersionStatus": "2"}], "translator": [{"title": {"ru": "", "en": "Trans Lator"}}]}}""",
    '{"id": "p2", "title": null, "type": "POEM", "year": "2020", "language": "англ", "createdAt": "вчера"}',
    '{"title": "без номера"}', "не JSON",
]

#: (id, field, value) of every field that is set.
PUBLICATION_FIELDS = [
    ("p1", "title", "О рынке"), ("p1", "type", "ARTICLE"), ("p1", "year", "2021"), ("p1", "language", "рус"), ("p1", "created_at", "2021-05-01 10:20:30"), ("p1", "abstract_ru", "Текст & разбор"),
    ("p1", "venue", "Журнал права"), ("p1", "citation", "Цитата — 1"), ("p1", "publisher", "Дом книги"), ("p1", "doi_url", "https://doi.example.org/10.1/x"), ("p1", "document_url", "https://pubs.example.org/d/1.pdf"), ("p1", "cover_url", "https://pubs.example.org/c.png"),
    ("p1", "editors", '[{"display_name":"Редактор","is_hse_person":false,"position":0},{"person_id":7,"display_name":"Ed Itor","display_name_en":"Ed Itor","href":"https://x.org/7","is_hse_person":true,"position":1}]'),
    ("p1", "translators", '[{"display_name":"Trans Lator","display_name_en":"Trans Lator","is_hse_person":false,"position":0}]'),
    ("p2", "title", ""), ("p2", "type", "OTHER"), ("p2", "language", "англ"), ("p2", "editors", "[]"), ("p2", "translators", "[]"),
]

#: (publication_id, position, person_id, display_name, display_name_en, href, is_hse_person)
AUTHORSHIPS = [("p1", 0, 55, "Иванов Иван", "Ivan Ivanov", "https://portal.example.org/staff/55", True), ("p1", 2, None, "Петров & Ко", None, None, False), ("p1", 3, None, "Третий", None, None, False)]

THESES = [
    '{"id": 31, "title": " Тема ", "year": 2020, "level": "Магистр", "student": "С. С.", "learnProgram": {"title": "Право", "url": "/pr"}, "orgUnit": {"title": "Факультет"}, "hasEnVersion": true, "supervisors": [{"url": "https://x.org/org/persons/55", "name": "Иванов"}, {"url": "/staff/9", "name": "Не тот путь"}, {"name": "Без пути"}]}',
    '{"id": 32, "title": "Вторая", "year": "2019"}', '{"id": 33, "title": " "}', '{"id": "x", "title": "Без номера"}',
]
#: (thesis_id, title, year, level, student, program, program_url, org_unit, has_en_version)
THESIS_ROWS = [(31, "Тема", 2020, "Магистр", "С. С.", "Право", "/pr", "Факультет", True), (32, "Вторая", None, None, None, None, None, None, False)]
SUPERVISORS = [(31, 55, "Иванов")]

#: Tags of a person of this name, and what the rules leave of them.
TAGS_OF = "Иванов Иван"
TAGS = ["«Теория графов»", "стаж 15 лет", "интересы экономика труда", "иванов методы", "школы россии", "для рынка", "2020 году научно", "12.05.2020 год", "опыт работы в банке", "кот", "университет", "новые методы", "машинное обучение - сети", None, " "]
TAGS_KEPT = ["теория графов", "экономика труда", "машинное обучение-сети"]

#: (name, text, entities, rejects) and its topics.
TEXT_ABOUT = ("Вершинина Анна", "Вершинина Анна: сетевой анализ рынка. Вершинина Анна: сетевой анализ рынка.", ["Эконометрика панелей"], ["рынка вершинина"])
TOPICS = "сетевой анализ рынка|эконометрика панелей"  # 2 * (0.2 + 3 * 0.1) is more than an entity counts


def literal(v) -> str:
    """A value as SQL."""
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"


def rows_sql(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"
