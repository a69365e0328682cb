import random

import numpy as np
import pytest

from quaestor.llm.names import Weights, _judged, _Lexicon, _Rows, _usual, agreement, canonical, grams_of, grouped_names, link_names, linkage, linked_records, name_groups, parts_of, profile_name, similar_names

PEOPLE = [(1, "Словчеров Егор Вадимович"), (2, "Бохмерихлова Лариса Фёдоровна"), (3, "БОХМЕРИХЛОВА  Лариса Егоровна"), (4, "Oscar Melparink"), (5, "Жальмаригнина Людмила"), (6, "Словчеров Николай Петрович"), (7, None), (8, "Одно"), (9, ""), (10, "Тарвимов-Щердилин Михаил Евграфович"), (11, "Jan van der Berg")]


def linked(spark, *names):
    p = spark.createDataFrame(PEOPLE, "person_id long, full_name string").selectExpr("*", "'x' as name", "1 as w")
    t = spark.createDataFrame([(n, e) for n, e in names], "name string, name_en string")
    return {(r.name, r.name_en): r.person_id for r in link_names(p, t).collect()}


VARIANTS = [
    ("словчеров егор вадимович", "", 1), ("Словчеров Е. В.", "", 1), ("Е.В.Словчеров", "", 1), ("СловчеровЕВ", "", 1), ("Slovcherov, Egor", "", 1),
    ("Cлoвчepoв Егор", "", 1), ("Бохмерихлова Лариса Фёдоровна", "Larisa Bokhmerikhlova", 2), ("Boxmerixlova Larisa Egorovna", "", 3),
    ("Melparink O.", "", 4), ("Словчеров Коля", "", 6), ("", "Egor Slovcherov", 1),
    ("Тарвимов Щердилин Михаил Евграфович", "", 10), ("Тарвимов-Щердилин М. Е.", "", 10), ("Berg, Jan", "", 11), ("J. van der Berg", "", 11), ("Лмитрий Словчеров", "", None), ("Словчеров Бгор Вадимович", "", 1)]
NOBODY = ["Словчеров Иван Вадимович", "Словчеров", "Бохмерихлова Лариса", "Бохмерихлова Л.", "Петров Егор Вадимович", "", "А. Б. В. Г.", "Словчеров Егор Вадимович Третий", "12 34"]


@pytest.fixture(scope="module")
def links(spark):
    return linked(spark, *[(n, e) for n, e, _ in VARIANTS], *[(n, "") for n in NOBODY])


@pytest.mark.parametrize(("name", "en", "who"), VARIANTS)
def test_variants(links, name, en, who):
    assert links.get((name, en)) == who


@pytest.mark.parametrize("name", NOBODY)
def test_no_link(links, name):
    assert (name, "") not in links


def test_exchanged_letters(spark):
    assert linked(spark, ("Слочверов Егор", "")) == {("Слочверов Егор", ""): 1}


def test_english_spelling_may_contradict(spark):
    assert linked(spark, ("Словчеров Е.", "Elena Slovcherova")) == {}


def test_records_of_both_tables(spark):
    p = spark.createDataFrame(PEOPLE[:6], "person_id long, full_name string")
    a = spark.createDataFrame([("a", 1, None, "Словчеров Егор", None), ("a", 1, None, "Словчеров Егор", None), ("b", 2, 1, "Словчеров Егор", None), ("c", 3, None, None, None)], "publication_id string, position int, person_id long, display_name string, display_name_en string")
    s = spark.createDataFrame([(10, 99, "Melparink, Oscar"), (11, 1, "Словчеров Егор"), (12, 98, None)], "thesis_id long, person_id long, display_name string")
    got = sorted(tuple(r) for r in linked_records(p, a, s).collect())
    assert got == [("authorships", "a", 1, 1), ("thesis_supervisors", "10", 99, 4)]
    assert linked_records(p.where("person_id < 0"), a, s).count() == 0
    assert linked_records(p, a.where("position < 0"), s.where("thesis_id < 0")).count() == 0


@pytest.fixture(scope="module")
def nodes(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice(["ба", "ров", "кин", "ми", "ла", "нов", "ска"]) for _ in range(n)).title()
    given = [word(2) for _ in range(6)]
    names = list({f"{word(3)} {r.choice(given)} {r.choice(given)}" for _ in range(90)})
    rows = [(i, canonical(n), "", i % 3 == 0) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "node long, c1 string, c2 string, profile boolean"), rows


@pytest.mark.parametrize("block", [8192, 7])
def test_similarity_join_loses_no_pair(nodes, block):
    df, rows = nodes
    grams = {i: grams_of((a, b)) for i, a, b, _ in rows}
    usual, more = _usual()
    count = usual.copy()
    for g in grams.values():
        count[g] += 1
    weights = Weights(count, more + len(rows))
    want = {}
    for i, _, _, p in rows:
        for j, _, _, q in rows:
            if i < j and not (p and q):
                w = [weights.of(grams[x]) for x in (i, j)]
                shared = np.intersect1d(grams[i], grams[j])
                cosine = (weights.of(shared) ** 2).sum() / np.sqrt((w[0] ** 2).sum() * (w[1] ** 2).sum())
                if cosine >= 0.42:
                    want[frozenset((i, j))] = cosine
    got = similar_names(df, 0.42, block, judged=False).collect()
    assert len(got) == len(want) > 60
    assert all(abs(want[frozenset((r.a, r.b))] - r.cosine) < 1e-6 for r in got)
    profile = {r[0]: r[3] for r in rows}
    assert all(not profile[r.a] and profile[r.b] == r.profile for r in got)


def naive(n, edges, profile, least, top):
    """Average linkage that merges the nearest pair of groups, one at a time."""
    groups = {i: [i] for i in range(n)}
    own = {i: profile[i] for i in range(n)}
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b and not (own[a] >= 0 and own[b] >= 0):
                    s = sum(edges.get((min(x, y), max(x, y)), 0) for x in groups[a] for y in groups[b])
                    na, nb = len(groups[a]), len(groups[b])
                    mean = s / min(na * nb, top * min(na, nb))
                    if s and mean >= least and (best is None or mean > best[0]):
                        best = mean, a, b
        if best is None:
            return {x: g for g, xs in groups.items() for x in xs}, {x: own[g] for g, xs in groups.items() for x in xs}
        _, a, b = best
        groups[a] += groups.pop(b)
        own[a] = max(own[a], own.pop(b))


@pytest.fixture(scope="module")
def graph():
    r = random.Random(9)
    n = 24
    profile = [i if i >= 20 else -1 for i in range(n)]
    edges = {(i, j): round(0.3 + r.random() * 0.7, 6) for i in range(20) for j in range(i + 1, n) if r.random() < 0.3}
    return n, edges, profile


def test_linkage_equals_merging_one_pair_at_a_time(graph):
    n, edges, profile = graph
    a, b = (np.array([e[k] for e in edges]) for k in (0, 1))
    group, own = linkage(a, b, np.array(list(edges.values())), np.ones(n), np.array(profile), 0.25, 32)
    want = naive(n, edges, profile, 0.25, 32)
    assert dict(enumerate(group.tolist())) == want[0] and dict(enumerate(own.tolist())) == want[1]


@pytest.mark.parametrize("local", [0, 20, 10_000])
def test_rounds_over_joins_equal_one_task(spark, graph, local):
    n, edges, profile = graph
    df = spark.createDataFrame([(i, j, profile[j] >= 0, c) for (i, j), c in edges.items()], "a long, b long, profile boolean, cosine double")
    got = {r.node: (r.group, r.profile) for r in grouped_names(df, 0.25, 32, local).collect()}
    want = naive(n, edges, profile, 0.25, 32)
    assert got == {i: (want[0][i], want[1][i]) for i in got} and len(got) == len({x for e in edges for x in e})


def test_many_spellings_of_one_person_with_few_partners_kept(spark):
    r = random.Random(2)
    full = "Словчеров Егор Вадимович"
    typed = {full[:k] + c + full[k:] for k in range(3, 9) for c in "аекн"} | {full, "Словчеров Е. В."}
    p = spark.createDataFrame(PEOPLE, "person_id long, full_name string")
    t = spark.createDataFrame([(n, "") for n in sorted(typed, key=lambda _: r.random())], "name string, name_en string")
    assert {x.name: x.person_id for x in link_names(p, t, top=3).collect()} == dict.fromkeys(typed, 1)


def test_people_without_a_profile_are_grouped(spark):
    t = spark.createDataFrame([("Ларгемовский Пётр", ""), ("Лагремовский Пётр", "Pyotr Largemovsky"), ("Ларгемовский П.", ""), ("Нурбосин Олег", ""), ("", "")], "name string, name_en string")
    got = {r.name: (r.class_id, r.n_links) for r in name_groups(spark.createDataFrame(PEOPLE, "person_id long, full_name string"), t).collect()}
    assert len({got[x] for x in ("Ларгемовский Пётр", "Лагремовский Пётр", "Ларгемовский П.")}) == 1
    assert got["Нурбосин Олег"] == ("Нурбосин Олег", 0) and len({g for g, _ in got.values()}) == 3


def test_parts():
    assert [(p.text, p.short) for p in parts_of("Иванов И.И.")[1:]] == [("i", True), ("i", True)] and profile_name("Егор") is None
    assert agreement(parts_of("Словчеров Егор"), *profile_name("Словчеров Егор Вадимович")) == (0, True)


@pytest.mark.parametrize(("typed", "profile", "sure"), [
    ("Janna Vadrolarova", "Вадроларова Жанна Евгеньевна", True), ("Вадроларова Яна", "Вадроларова Жанна Евгеньевна", None), ("Вадроларова Я.", "Вадроларова Жанна Евгеньевна", None), ("J. Vadrolarova", "Вадроларова Жанна Евгеньевна", True),
    ("Бохмерихлова Лариса Фёдоровна", "Бохмерихлова Лариса Егоровна", None), ("Вебзолина Н.", "Вебзодлина Надежда Глебовна", False), ("Вебзолина Надежда", "Вебзодлина Надежда Глебовна", True), ("Kaxloxlov Aleksey", "Кахлохлов Алексей Александрович", True)])
def test_agreement(typed, profile, sure):
    got = agreement(parts_of(typed), *profile_name(profile))
    assert (got and got[1]) == sure


def test_contradictions_are_seen_before_pairs_are_judged_one_by_one():
    r = random.Random(6)
    given = ["Егор", "Юлия", "Жанна", "Janna", "Яна", "Мария", "Марина", "Саша", "Александр", "Gustav", "Ли", "Анна-Мария", "Константин", "Максим", "Maxim"]
    father = ["Вадимович", "Юрьевна", "Яковлевна", "Ильинична", "Аллаевна", "В.", "Ю.", ""]

    def slip(x):
        k = r.randrange(len(x) + 1)
        return r.choice([x, x, x[:k] + x[k + 1 :], x[:k] + r.choice("аяюжk") + x[k:], x[:k] + x[k : k + 2][::-1] + x[k + 2 :]])

    def typed():
        g, f, s = r.choice(given), r.choice(father), slip(r.choice(["Словчеров", "Словчерова", "Юяров", "Bjarjanov", "Ли Бохмеров"]))
        g, f = r.choice([slip(g), g[0] + "."]), f and slip(f)
        return r.choice([f"{s} {g} {f}", f"{g} {f} {s}", s])

    forms = [(canonical(typed()), canonical(typed()) if r.random() < 0.2 else "") for _ in range(500)]
    forms += [(" ".join(f"{x},{x},0,{x[0]}" for x in p if x), "") for _ in range(150) if (p := profile_name(f"{slip('Словчеров')} {slip(r.choice(given))} {r.choice(father[:5])}"))]
    rows = object.__new__(_Rows)
    rows.forms, rows.profile, rows.lexicon = forms, np.arange(len(forms)) >= 500, _Lexicon()
    rows.form = np.full((len(forms), 2), -2)
    i, j = np.triu_indices(len(forms), 1)
    i, j = (x[~(rows.profile[i] & rows.profile[j])] for x in (i, j))
    can = rows.possible(i, j)
    true = np.array([_judged(rows, x, y) is not None for x, y in zip(i.tolist(), j.tolist())])
    assert true.sum() > 1000 and not (true & ~can).any()
    assert (can & ~true).sum() < 0.15 * (~true).sum()
