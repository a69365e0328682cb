"""Invented sentences with personal data in six languages, for training the tagger.

Names, streets and numbers are put together from the short lists below by rule, so the
tagger meets shapes and not a fixed stock.  `invented` gives (text, spans); a span is
(start, end, kind) with the kinds of `pii_model.KINDS`.  A third of the sentences hold
nothing personal but look as if they did: titles, institutions, rooms, grants, pages.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

#: Given names (men, women) and what surnames are made of (beginnings, ends).
_GIVEN = {
    "ru": ("Иван Пётр Павел Фёдор Никита Илья Антон Денис Роман Тимур Егор Глеб Лев Олег Юрий Игорь Сергей Андрей Николай Григорий Виталий Дмитрий Максим Борис Вадим Константин Владимир Руслан".split(), "Анна Мария Дарья Софья Юлия Наталья Ольга Елена Ирина Татьяна Светлана Людмила Галина Вера Надежда Екатерина Ксения Полина Алина Виктория Лариса Тамара Марина Евгения".split()),
    "en": ("James Robert Michael William David Richard Joseph Charles Daniel Matthew Andrew Peter George Edward Oliver Henry Arthur Simon Philip Martin Walter Kevin Brian Adam".split(), "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Karen Nancy Margaret Alice Helen Laura Rachel Julia Grace Charlotte Olivia Hannah Amy Rebecca Diana Ruth".split()),
    "de": ("Hans Peter Wolfgang Michael Werner Thomas Andreas Stefan Dieter Uwe Bernd Frank Matthias Markus Karl Heinrich Lukas Felix Jonas Tobias Günter Jörg Sven".split(), "Ursula Monika Karin Renate Helga Brigitte Andrea Claudia Susanne Birgit Heike Katrin Julia Lena Hannah Greta Marie Johanna Ingrid Bärbel Grit Anke".split()),
    "fr": ("Jean Michel Philippe Alain Bernard André Nicolas Laurent Luc Étienne Hugo Louis Antoine Mathieu Olivier Rémi Gérard Jacques Marc Guy Thierry Yves Émile".split(), "Marie Isabelle Catherine Nathalie Sylvie Anne Camille Élise Manon Chloé Hélène Juliette Margaux Aurélie Céline Françoise Brigitte Agnès Odile Inès".split()),
    "es": ("Juan Manuel Antonio Francisco Javier Miguel Ángel Pedro Luis Alberto Diego Sergio Pablo Andrés Jorge Rafael Ramón Víctor Óscar Iván Tomás Álvaro Raúl".split(), "Carmen Ana Isabel Dolores Pilar Teresa Rosa Cristina Marta Laura Sofía Paula Raquel Beatriz Silvia Inés Nuria Alicia Julia Begoña Ángela Irene".split()),
    "uk": ("Олександр Сергій Володимир Микола Іван Василь Петро Юрій Віктор Олег Тарас Богдан Остап Павло Дмитро Роман Максим Євген Назар Степан Кирило Ярослав".split(), "Олена Тетяна Людмила Ірина Світлана Марія Юлія Катерина Ганна Галина Надія Ольга Вікторія Софія Христина Лариса Соломія Зоряна Дарина Любов Віра".split()),
}
_SURNAME = {
    "ru": ("Авер Бель Вороб Голуб Давыд Ерм Жар Зайц Ив Калин Лаз Мак Ник Орл Пан Род Сав Тар Уль Фом Хар Цвет Чер Шум Щерб Яков Бахт Дроб Крас Медвед Лих Сед Гонч".split(), "ов ев ин ёв енин кин ков ской ский ович енко ук ян яев ихин".split()),
    "en": ("Ash Black Brad Cal Dun East Fair Graf Hart Hold King Lang Mar Nor Old Pres Red Stan Thorn Under Wal West Win York Bur Cran Eller Mont Whit Hend".split(), "ley ford man son wood by well ton ham field er ington worth ers dale acre ell".split()),
    "de": ("Acker Berg Bau Dorn Eich Feld Grün Hart Kauf Lang Linden Müll Neu Ober Rich Schön Stein Sturm Wald Weiß Ziegl Brück Fisch Kell Lehm Schrö Kraus Kör".split(), "mann er bach berg meier stein el ke hardt ner ing ler hoff feld der".split()),
    "fr": ("Mar Ber Du Le Ro Gau Bel Char Del Fon Gir Lam Mon Per Riv Sau Tho Val Ver Bou Cou Dela Fou Gui Mer Pel Bau Rous Lef".split(), "tin nard rand blanc ssel tier mont pentier court taine ault bert voisin elle in eau ier ois evre".split()),
    "es": ("Alv Ben Cab Dom Esp Fern Garc Herr Ibañ Jim Lóp Mend Nav Ort Per Quir Rod Sánch Torr Urb Vel Zam Gonz Mart Ram Mor Cast Gut".split(), "ez arez ero ales ado illa era ano ega eda arro ínez eño ón ándiz".split()),
    "uk": ("Бонд Вас Гнат Данил Зах Іван Кравч Лев Мель Ник Онищ Пав Рома Сав Ткач Федор Хом Чор Шев Юрч Яким Ковал Петр Гонч Ост Мороз".split(), "енко чук ук ський ишин юк ко ак ець аренко ів ич".split()),
}
_PLACE = {
    "ru": "Садовая Полевая Лесная Школьная Набережная Речная Весенняя Зелёная Парковая Морская Горная Озёрная Заводская Советская Центральная Каменная Большая Малая Новая Старая Липовая Сиреневая Трудовая Почтовая Вокзальная Московская".split(),
    "en": "Mill Church Oak Victoria Green Park Station London Bridge Castle King Queen Spring Chestnut Maple Garden Hill North South Market Abbey Cedar Willow Field River Harbour".split(),
    "de": "Bahnhof Schul Garten Kirch Wald Berg Mühlen Schiller Goethe Ring Birken Eichen Post Markt Brunnen Wiesen Friedrich Kaiser Dorf Buchen See Park Ufer Kastanien Tannen Rosen".split(),
    "fr": "Liberté République Gare Église Moulin Marché École Fontaine Château Pont Victoire Poste Jardin Soleil Mairie Chapelle Forge Tilleuls Lilas Roses".split(),
    "es": "Real Nueva Alta Libertad Constitución España Sol Luna Iglesia Fuente Molino Reyes Castilla Andalucía Olmo Rosal Puente Estación Jardín Olivo Sevilla Granada".split(),
    "uk": "Садова Польова Лісова Шкільна Набережна Зелена Паркова Гірська Соборна Київська Центральна Молодіжна Вишнева Весняна Козацька Замкова Ринкова Поштова Лугова Дніпровська Хутірська".split(),
}
#: Sentences with a place for a find of a kind, and some without any.
_FRAMES = {
    "ru": {
        "name": "Автор доклада — {}, кафедра права.|Обращайтесь к секретарю: {}.|По словам {}, спрос растёт.|Руководитель: {}|Рецензент {} отметил новизну.|Благодарим {} за помощь с архивом.|{} и {} написали отчёт.|Отв. {}, тел. внутренний.|Книга {} вышла в свет.|На семинаре выступит {}.|Лекцию читает {} (с 10 до 12).|Спасибо {} за советы.|Курс ведут {}, {}.|доц. {} принимает по средам",
        "address": "Наш адрес: {}.|Офис находится на {}, вход со двора.|Приходите на {} в среду.|101000, Москва, {}, корп. 2.|Корпус по адресу {}, кв. 14.|Встреча пройдёт по адресу {}, третий этаж.|Занятия идут здесь: {}, ауд. 305.|Проживает: г. Тверь, {}, стр. 1",
        "phone": "Тел.: {}.|Звоните {} с 10 до 18.|Телефон {}, доб. 12.|Справки по телефону {}.|моб. {}|Номер для связи {} или почта.", "email": "Почта: {}.|Пишите на {} до пятницы.|E-mail {}, отвечаем в течение недели.|Адрес для заявок — {}|Связаться можно так: {} или по телефону.",
        "id": "ИНН {}, КПП не указан.|Паспорт {} выдан в 2010 году.|СНИЛС {}.|В договоре стоит ИНН {}.|паспорт серия и номер {}, действителен|Страховой номер {} указан в анкете.",
        "": "Курс «Теория Графов» читают с 1998 года.|Грант РФФИ № 18-010-00123 завершён.|Грант РНФ № 19-18-00456 продлён до 2023 года.|Московский Государственный Университет открыт в 1755 году.|Методы Машинного Обучения рассмотрены на страницах 120–134.|Аудитория 412, группа 231, семестр 2.|Рег. № 2019661234 от 01.02.2019.|ISBN 978-5-7598-1234-5, 320 с.|Новая Экономическая Политика длилась до 1928 года.|Российская Академия Наук и Центральный Банк подписали договор.|Том 12, выпуск 3, с. 45–67.|Проект 22-28-01234 поддержан."},
    "en": {
        "name": "Please contact {} before Monday.|The keynote was given by {} of the law department.|{} and {} wrote the report.|As {} noted, rates changed.|Speak with {} or leave a message.|Our guest is {}, an economist.|Prof. {} teaches the course.|Thanks to {} for comments.|Author: {}|Supervised by {} since 2014.|{} wrote about Applied Methods.|Ask {} about it.",
        "address": "Our office is at {}, next to the station.|Send the parcel to {} and ring twice.|She lives at {}.|Visit us: {}, London.|The archive moved to {} last year.|Meet at {}, second floor.|Address: {}, flat 3",
        "phone": "Call {} for details.|Phone: {}.|Tel. {}, ext. 12.|Dial {} after noon.|leave a message on {}.|Mobile {} or e-mail.", "email": "Write to {} if the link is broken.|E-mail: {}.|Contact {} before Monday.|Send it to {} or call.|Questions go to {}, please.|Reach me at {}",
        "id": "TIN {} was printed on the form.|Passport {} was cancelled.|Insurance number {} is needed.|His tax number TIN {} was wrong.|passport no {}, valid until 2030|INN {} belongs to the institute.",
        "": "The Learning Methods course has 48 pages.|New York and San Francisco grew fast.|Modern Public Finance was printed in 2001.|The Central Bank of Norway met in Room 404.|Grant No. 14-05-00321 ended.|Applied Statistics starts in March.|ISBN 978-0-262-03384-8.|The New Economic History seminar meets on Friday.|Chapter 12 holds 3 tables on pages 45-67.|Machine Learning and Data Mining are taught in English.|World Trade Organization rules changed in 1995."},
    "de": {
        "name": "Bitte wenden Sie sich an {}.|Die Arbeit von {} wurde ausgezeichnet.|{} und {} leiten den Kurs.|Der Vortrag von {} beginnt um 18 Uhr.|Wir danken {} für die Durchsicht.|Ansprechpartner: {}|Frau {} berät am Montag.|Herr {} lehrt seit 2009.|Laut {} bleibt die Nachfrage schwach.|Redaktion: {}, zweiter Stock.",
        "address": "Das Sekretariat befindet sich in der {}, zweiter Stock.|Neue Adresse: {}, Hinterhaus.|Das Institut liegt am {}.|Besuchen Sie uns: {}, 10115 Berlin.|Er wohnt {}.|Post an {}, 50667 Köln",
        "phone": "Rufen Sie {} an.|Telefon: {}.|Tel. {}, App. 12.|unter {} erreichbar.|Mobil {} oder per Mail.", "email": "Schreiben Sie an {}.|E-Mail: {}.|Kontakt {} bis Freitag.|Senden Sie den Text an {}, bitte.",
        "id": "Passport {} ist abgelaufen.|Steuernummer TIN {} steht im Vertrag.",
        "": "Die Deutsche Bank fördert das Projekt seit 2015.|Kapitel 3 behandelt die Soziale Marktwirtschaft auf 25 Seiten.|Der Kurs Politische Ökonomie beginnt im Mai.|Das Statistische Bundesamt zählte 2011.|Raum 305, Gruppe 12.|Die Technische Universität München und das Max-Planck-Institut forschen.|Im Neuen Museum hängt die Alte Sammlung.|Angewandte Statistik und Maschinelles Lernen sind Pflicht.|Im Jahr 2004 stieg die Zahl auf 1250.|Nach der Reform wuchs der Handel."},
    "fr": {
        "name": "Veuillez contacter {} avant lundi.|L'exposé de {} a été très suivi.|{} et {} dirigent le cours.|Merci à {} pour sa relecture.|Selon {}, la demande reste faible.|{} enseigne depuis 2004.|Responsable : {}|Mme {} reçoit le mardi.|M. {} a rédigé le rapport.|Le livre de {} est paru.",
        "address": "Le bureau se trouve au {}, deuxième étage.|Nouvelle adresse : {}.|Rendez-vous {}, 75002 Paris.|Il habite {}.|Envoyez le colis au {} avant midi.",
        "phone": "Appelez le {} le matin.|Téléphone : {}.|Tél. {}, poste 12.|au {} ou par courriel.|joignable au {}", "email": "Écrivez à {} avant lundi.|Courriel : {}.|Contact {} ou par téléphone.|Adressez le texte à {}, merci.",
        "id": "Le passport {} a expiré.|Numéro TIN {} au contrat.",
        "": "La Banque centrale a publié son rapport en 2019.|Le chapitre 7 compte 30 pages et 4 figures.|Le séminaire Histoire Économique reprend en octobre.|L'Université Paris Nanterre ouvre en septembre.|Théorie des Jeux et Statistique Appliquée sont enseignées.|La Cour des Comptes a siégé en 2012.|Salle 305, groupe 12.|Le Conseil National publie le tome 3.|Les Nouvelles Frontières du Droit, p. 45-67.|Selon nos données, la Politique Agricole a changé."},
    "es": {
        "name": "Póngase en contacto con {}.|La ponencia de {} fue muy comentada.|{} y {} dirigen el curso.|Gracias a {} por la revisión.|Según {}, los precios suben.|{} enseña desde 2011.|Responsable: {}|La doctora {} atiende los martes.|El libro de {} salió ayer.",
        "address": "La oficina está en la {}, segundo piso.|Vive en la {}.|Nueva dirección: {}.|Estamos en {}, 28013 Madrid.|Envíe el paquete a {} antes del lunes.",
        "phone": "Llame al {} por la tarde.|Teléfono: {}.|Tel. {}, ext. 12.|en el {} o por correo.|Móvil {}", "email": "Escriba a {} antes del lunes.|Correo: {}.|Contacto {} o por teléfono.|Envíe el texto a {}, gracias.",
        "id": "El passport {} caducó.|Número TIN {} del contrato.",
        "": "El Banco Central publicó su informe en 2018.|El capítulo 5 tiene 40 páginas.|El seminario Teoría Política empieza en marzo.|La Universidad Autónoma abrió en 1968.|Estadística Aplicada y Economía Pública son obligatorias.|El Ministerio de Cultura firmó en 2012.|Aula 305, grupo 12.|Nueva Historia Económica, págs. 45-67.|Según nuestros datos, la Unión Europea creció.|El Tribunal Supremo dictó la sentencia 123."},
    "uk": {
        "name": "Зверніться до секретаря: {}.|Доповідь {} тривала годину.|{} і {} написали звіт.|Дякуємо {} за допомогу.|Керівник — {}, рецензента ще немає.|Відповідальна особа: {}|За словами {}, попит зростає.|Курс веде {}.|Книга {} вийшла торік.",
        "address": "Адреса кафедри: {}.|Інститут розташований за адресою {}.|Приходьте на {}, другий поверх.|01001, Київ, {}, корп. 2.|Мешкає: {}, кв. 14",
        "phone": "Тел.: {}.|Дзвоніть за номером {}.|Телефон {}, дод. 12.|Довідки за телефоном {}.|моб. {}", "email": "Пишіть на {} до середи.|Пошта: {}.|Адреса для заявок — {}|Зв'язок: {} або телефон.",
        "id": "ІПН {} вказано в анкеті.|Паспорт {} видано у 2010 році.|ИНН {} зазначено в договорі.",
        "": "Національний Банк України змінив ставку у 2016 році.|Курс «Економічна Теорія» читають у п'ятому семестрі.|Розділ 4 має 36 сторінок.|Київський Національний Університет засновано у 1834 році.|Аудиторія 305, група 12.|Методи Машинного Навчання, с. 45–67.|Верховна Рада ухвалила закон 1234.|Нова Економічна Політика тривала довго."},
}
_LANGS = tuple(_FRAMES)


def _declined(word: str, case: str, female: bool) -> str:
    """A Russian or Ukrainian name part in a case (n, g, d, i), by its ending."""
    if case == "n":
        return word
    i = "gdi".index(case)
    for end, forms in (("ский", ("ского", "скому", "ским")), ("ський", ("ського", "ському", "ським")), ("ская", ("ской", "ской", "ской")), ("ська", ("ської", "ській", "ською"))):
        if word.endswith(end):
            return word[: -len(end)] + forms[i]
    if word.endswith(("ова", "ева", "ёва", "ина")) and female:
        return word[:-1] + "ой"
    if word[-1] == "а":
        return word[:-1] + ("ы", "е", "ой")[i]
    if word[-1] == "я":
        return word[:-1] + ("и", "е", "ей")[i]
    if female or word[-1] in "оеуиіь":
        return word
    if word[-1] == "й":
        return word[:-1] + ("я", "ю", "ем")[i]
    return word + (("а", "у", "ым") if word.endswith(("ов", "ев", "ёв", "ин")) else ("а", "у", "ом"))[i]


def _surname(r: random.Random, lang: str, female: bool) -> str:
    word = r.choice(_SURNAME[lang][0]) + (r.choice(("", "", "а", "о", "е", "и")) + r.choice(_SURNAME[lang][0]).lower() if r.random() < 0.35 else "") + r.choice(_SURNAME[lang][1])
    if lang == "fr" and r.random() < 0.1 or lang == "en" and r.random() < 0.08:
        word = r.choice(("O'", "Mc", "d'", "D'")) + word
    if female and lang in ("ru", "uk"):
        word = re.sub("ский$", "ская", re.sub("ський$", "ська", word))
        word += "а" if word.endswith(("ов", "ев", "ёв", "ин")) else ""
    return word


def _name(r: random.Random, lang: str, case: str = "n") -> str:
    female = r.random() < 0.5
    given, surname = r.choice(_GIVEN[lang][female]), _surname(r, lang, female)
    first = given[0] + "."
    if lang in ("ru", "uk"):
        father = re.sub("[аяйьо]$", "", r.choice(_GIVEN[lang][0]))
        middle = father + (("овна", "евна") if female else ("ович", "евич"))[r.random() < 0.3] if lang == "ru" else father + ("івна" if female else "ович")
        s, g, m = (_declined(x, case, female) for x in (surname, given, middle))
        k = father[0] + "."
        return r.choice((f"{s} {g} {m}", f"{s} {g}", f"{g} {s}", f"{g} {m} {s}", f"{g} {m}", f"{s} {first} {k}", f"{s} {first}{k}", f"{first} {k} {s}", f"{first}{k} {s}", f"{s} {first}", f"{first} {s}"))
    if r.random() < 0.15:
        given += r.choice("- ") + r.choice(_GIVEN[lang][female])
    if lang == "es" and r.random() < 0.25 or r.random() < 0.05:
        surname += r.choice("- " if lang == "es" else "-") + _surname(r, lang, female)
    return r.choice((f"{given} {surname}",) * 5 + (f"{first} {surname}", f"{first} {surname}", f"{given} {r.choice('ABCDEHJKLMPRST')}. {surname}", f"{surname}, {given}", f"{surname} {first}"))


def _address(r: random.Random, lang: str) -> str:
    n = str(r.randint(1, 250 if r.random() < 0.2 else 80)) + (r.choice("абвгд" if lang in ("ru", "uk") else "abcdB") if r.random() < 0.15 else "")
    place = r.choice(_PLACE[lang])
    if lang in ("ru", "uk"):
        ru = lang == "ru"
        house = r.choice((f", д. {n}", f", {n}", f" {n}", f", дом {n}", f" д. {n}") if ru else (f", {n}", f" {n}", f", буд. {n}"))
        if r.random() < 0.4:
            place = _declined(_surname(r, lang, False), "g", False)
            kind = r.choice("ул. улица пр. проспект пер. переулок наб. набережная набережной бульвар пл. площадь шоссе улице".split() if ru else "вул. вулиця просп. проспект пров. провулок бульвар площа наб.".split())
            return f"{kind} {place}{house}"
        if r.random() < 0.3:
            kind = r.choice("ул. улица улице наб. набережная площадь".split() if ru else "вул. вулиця площа".split())
            return f"{place} {kind}{house}"
        if r.random() < 0.3:
            man = place[:-2] + r.choice(("ий", "ый") if ru else ("ий",))
            kind = r.choice("проспект переулок бульвар пер. пр-т проезд".split() if ru else "проспект провулок бульвар".split())
            return f"{man} {kind}{house}"
        return f"{r.choice('ул. улица ул улице'.split() if ru else 'вул. вулиця вул'.split())} {place}{house}"
    person = f"{r.choice(_GIVEN[lang][0])} {_surname(r, lang, False)}"
    if lang == "en":
        return f"{n} {r.choice((place, place, f'{place} {r.choice(_PLACE[lang])}', _surname(r, lang, False)))} {r.choice('Street Road Lane Avenue Drive Square Close Way St Rd Ave Court Terrace'.split())}"
    if lang == "de":
        if r.random() < 0.2:
            return f"{r.choice(('Am', 'An der', 'Unter den', 'Im'))} {place}{r.choice(('weg', 'platz', 'ufer', 'hof'))} {n}"
        return f"{r.choice((place, _surname(r, lang, False)))}{r.choice(('straße', 'strasse', 'weg', 'allee', 'gasse', 'platz', 'str.', 'ring', 'damm'))} {n}"
    if lang == "fr":
        kind = r.choice("rue avenue boulevard place impasse allée quai chemin rue".split())
        return f"{n}{r.choice((' ', ' ', ', '))}{kind} {r.choice((f'de la {place}', f'du {place}', f'des {place}', place, person, _surname(r, lang, False)))}"
    kind = r.choice(("calle", "avenida", "plaza", "paseo", "C/", "Avda.", "camino", "Calle"))
    return f"{kind} {r.choice((place, f'de {place}', f'de la {place}', f'del {place}', person))}{r.choice((' ', ', ', ' nº '))}{n}"


def _digits(r: random.Random, shape: str) -> str:
    return re.sub("9", lambda _: str(r.randint(0, 9)), shape)


def _phone(r: random.Random, lang: str) -> str:
    shapes = {
        "ru": "+7 (999) 999-99-99|8 (999) 999-99-99|+79999999999|8 999 999 99 99|8-999-999-99-99|(999) 999-99-99|+7 999 999-99-99|89999999999|8 800 999-99-99", "en": "+44 20 9999 9999|+1 (999) 999-9999|(999) 999-9999|999-999-9999|+44 1999 999999|+1 999 999 9999|020 9999 9999",
        "de": "+49 30 999999|+49 (89) 9999-9|+49 89 9999 9999|030 99999999|0170 9999999|+49 999 9999999|+49 30 9999999", "fr": "+33 1 99 99 99 99|01 99 99 99 99|+33 (0)4 99 99 99 99|06.99.99.99.99|+33 6 99 99 99 99",
        "es": "+34 91 999 99 99|+34 999 99 99 99|91 999 99 99 99|+34 699 999 999|+34 999 999 999", "uk": "+380 44 999 99 99|+380 (67) 999-99-99|(044) 999-99-99|067 999 99 99|+380999999999|0 800 999 999"}
    return _digits(r, r.choice(shapes[lang].split("|")))


def _email(r: random.Random, lang: str) -> str:
    word = lambda: "".join(r.choice(("ka", "lo", "mi", "ren", "sto", "vel", "info", "pra", "dek", "ana", "ti", "or")) for _ in range(r.randint(1, 3)))
    local = r.choice((word(), f"{word()}.{word()}", f"{word()}_{r.randint(1, 99)}", f"{r.choice('abcdefgiklmnprst')}.{word()}", f"{word()}-{word()}"))
    host, end = r.choice(("univer", "college", "uni-test", "mail", "library", "hochschule", "universidad", "bibliotheque", "institute", word())), r.choice(("example", "org", "ru", "com", "edu", "de", "fr", "es", "net"))
    kind = r.random()
    if kind < 0.7:
        return f"{local}@{host}.{end}"
    at, dot = ("собака", "точка") if lang in ("ru", "uk") and r.random() < 0.6 else ("at", "dot")
    if kind < 0.8:
        return f"{local} {at} {host} {dot} {end}"
    a, b = r.choice(("[]", "()"))
    return f"{local} {a}{at}{b} {host} {a}{dot}{b} {end}" if r.random() < 0.6 else f"{local}{a}{at}{b}{host}.{end}"


def _id(r: random.Random, frame: str) -> str:
    if re.search("(?i)паспорт|passport", frame):
        return _digits(r, r.choice(("9999 999999", "99 99 999999", "99 99 № 999999", "9999999999")))
    if re.search("(?i)снилс|страхов|insurance", frame):
        return _digits(r, r.choice(("999-999-999 99", "99999999999", "999 999 999 99")))
    return _digits(r, r.choice(("9999999999", "9999999999", "999999999999")))


def _sentence(r: random.Random, lang: str) -> tuple[str, list[tuple[int, int, int]]]:
    kind = r.choices(("name", "address", "phone", "email", "id", ""), (34, 20, 6, 10, 4, 26))[0]
    frame = r.choice(_FRAMES[lang][kind].split("|"))
    text, spans = "", []
    pieces = frame.split("{}")
    for n, piece in enumerate(pieces):
        text += piece
        if n + 1 < len(pieces):
            if kind == "name":
                case = "g" if re.search("словам |Благодарим |Книга |Доповідь |до секретаря", piece) else "d" if re.search("Спасибо |Дякуємо |секретарю", piece) and r.random() < 0.7 else "n"
                find = _name(r, lang, case)
                find = find.upper() if r.random() < 0.04 else find
            else:
                find = _address(r, lang) if kind == "address" else _phone(r, lang) if kind == "phone" else _email(r, lang) if kind == "email" else _id(r, piece)
            end = len(text) + len(find)
            cut = 1 if find[-1] == "." and kind not in ("name",) else 0
            spans.append((len(text), end - cut, ("email", "phone", "id", "address", "name").index(kind)))
            text += find
    return text, spans


def invented(n: int, seed: int, around: list[str] = ()) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """n texts of one to four sentences of one language; `around`: sentences without personal data to stand between them."""
    r = random.Random(seed)
    for _ in range(n):
        lang = r.choice(_LANGS)
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            if around and r.random() < 0.3:
                text += r.choice(around) + " "
            one, own = _sentence(r, lang)
            spans += [(a + len(text), b + len(text), k) for a, b, k in own]
            text += one + r.choice((" ", " ", "\n", "; ", " · "))
        yield text.rstrip(), spans
