import numpy as np

from quaestor.llm.pii import find_pii, pii_finds
from quaestor.llm.pii_model import SYMBOLS, WINDOW, find, tagger, windows
from quaestor.llm.pii_train import given_names, marked

TEXT = "Показано, что рынок меняет среду. E-mail: kraskripov_96@staff.example.com. Тел.: +7 (537) 597-21-01. Живёт по адресу ул. Полынная, д. 11, корп. 2. Руководитель: Дарья Денисовна Драгляднина. СНИЛС 944-438-596 49."


def test_finds_each_kind(spark):
    df = spark.createDataFrame([(1, TEXT, "m")], "doc_id long, text string, masked string")
    got = {(r.kind, r.pii_value) for r in pii_finds(df).collect()}
    assert got == {("email", "kraskripov96staffexamplecom"), ("phone", "75375972101"), ("address", "улполыннаяд11"), ("name", "дарьяденисовнадрагляднина"), ("id_number", "94443859649")}


def test_masked_text_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, TEXT, "m"), (2, None, "m"), (3, "", "m"), (4, "Ничего личного здесь нет.", "m")], "doc_id long, text string, masked string")
    got = {r.doc_id: r.masked for r in find_pii(df).collect()}
    assert got[1].startswith("Показано, что рынок меняет среду. E-mail: [EMAIL]. Тел.: [PHONE]. Живёт по адресу [ADDRESS], корп. 2. Руководитель: [NAME]. СНИЛС [ID_NUMBER].")
    assert got[2] is None and got[3] == "" and got[4] == "Ничего личного здесь нет."


def test_numbers_that_are_no_case(spark):
    text = "рег. № 012000167916. ISBN 978-0-00-041674-4. Грант № 03-31-82843. doi 10.99999/jt.2000.60100, 2010-2014, 2015–2019, ауд. 343, 12:10-13:30."
    assert pii_finds(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 0


def test_long_text_is_tagged_to_its_end(spark):
    filler = "Экономический рынок формирует когнитивное управление. " * 4000
    df = spark.createDataFrame([(1, filler + TEXT)], "doc_id long, text string")
    assert pii_finds(df).count() == 5


def test_overlapping_windows_agree_with_a_wide_view():
    dense = "; ".join(f"Краскрипов Олег Тимофеевич, kraskripov_{k}@staff.example.com" for k in range(10, 40))
    spots = windows([dense])[1]
    assert len(spots) > 5 and all(b - a <= WINDOW for _, a, b, _ in spots)
    found = find([dense], tagger())[0]
    emails = [dense[a:b] for a, b, k in found if k == 0]
    assert len(emails) >= 29 and all(e.endswith("@staff.example.com") for e in emails)


def test_every_character_is_read_by_the_tagger():
    texts = ["Экономический рынок формирует когнитивное управление. " * 40, "", "x", "И. о. декана: смотри стр. 5", TEXT]
    spots = windows(texts)[1]
    for k, text in enumerate(texts):
        assert {p for n, a, b, _ in spots if n == k for p in range(a, b)} == set(range(len(text)))


def test_labels_are_the_best_path():
    model, r = tagger(), np.random.default_rng(3)
    ids, mask = r.integers(1, SYMBOLS, (40, 12)), np.arange(40)[:, None] < r.integers(5, 41, 12)
    got, e = model.decode(ids, mask), model.emissions(ids, mask)[0]
    for j in range(12):
        best, ways = model.p["st"] + e[0, j], []
        for t in range(1, int(mask[:, j].sum())):
            s = best[:, None] + model.p["tr"]
            ways.append(s.argmax(0))
            best = s.max(0) + e[t, j]
        path = [best.argmax()]
        for way in reversed(ways):
            path.append(way[path[-1]])
        assert got[: len(path), j].tolist() == path[::-1]


def test_texts_read_at_once_have_the_windows_they_have_alone():
    texts = [TEXT, "", "Ничего личного здесь нет.", TEXT[40:], "x", "Рынок меняет среду. " * 30 + TEXT]
    ids, spots = windows(texts)
    for k, text in enumerate(texts):
        alone = windows([text])
        assert [(a, b) for n, a, b, _ in spots if n == k] == [(a, b) for _, a, b, _ in alone[1]]
        for n, a, b, start in spots:
            assert n != k or (ids[start + a : start + b] == alone[0][a:b]).all()


def test_grammar_labels(spark):
    given = given_names(["Словчеров Егор Вадимович", "Oscar Melparink"])
    text = "Критерий Шертунешева дал 6,31. Докладчик — Н.Г. Голквичев. Contact: Melparink, Oscar."
    assert [text[a:b] for a, b, _ in marked(text, given)] == ["Н.Г. Голквичев", "Melparink, Oscar"]


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, TEXT)], "doc_id long, text string")
    assert pii_finds(df).count() == 10
    assert pii_finds(df.where("doc_id < 0")).count() == 0
