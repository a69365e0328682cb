import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quaestor.functions import vector
from quaestor.operators import paging
from quaestor.operators.predicates import check_query, check_range, has_publications, where_all
from quaestor.operators.skew import broadcast_if_small, salted_join
from quaestor.plans import api, enrich, ingest, jobs
from quaestor.plans.api import Catalog
from quaestor.session import ready
from quaestor.sources import web
from quaestor.sources.tables import NotFound, exists, point, require
from quaestor.streaming.refresh import SnapshotStore, refresh

ITEM = {"id": 5, "title": "T", "type": "BOOK", "year": 2020, "language": {"name": "ru"}, "createdAt": "2024-01-02T03:04:05Z", "annotation": {"ru": "<p>A&nbsp;&amp; B</p>", "en": " "},
        "description": {"api": "V", "main": "C"}, "publisher": {"title": {"ru": "P"}}, "documents": {"DOI": {"href": "/d"}, "COVER": {"href": "https://c"}},
        "authorsByType": {"author": [{"id": "7", "title": {"ru": "Иванов", "en": "Ivanov "}, "href": "/org/persons/7", "enVersionStatus": "2"}, "bad", {"id": "x1", "title": "Петров &amp; Ко"}, {"altName": "Alt"}],
                          "cmn_editor": [{"id": 8, "title": {"en": "Ed"}, "href": "/e", "enVersionStatus": 2}], "sci_editor": ["no", {"id": 9, "title": "Ed2"}]}}


def raw(spark, *items):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False),) for x in items], "raw string")


def test_publication_payload(spark):
    r = ingest.publications_from_json(raw(spark, ITEM)).head()
    assert (r.id, r.type, r.year, r.language, r.abstract_ru, r.abstract_en, r.venue, r.publisher) == ("5", "BOOK", 2020, "ru", "A & B", None, "V", "P")
    assert r.created_at == datetime(2024, 1, 2, 3, 4, 5) and r.doi_url == "https://pubs.example.org/d" and r.cover_url == "https://c" and r.document_url is None
    assert [(e.person_id, e.display_name, e.is_hse_person, e.position) for e in r.editors] == [(8, "Ed", True, 0), (None, "Ed2", False, 1)] and r.translators == []


def test_publication_payload_odd_items(spark):
    got = {r.id: r for r in ingest.publications_from_json(raw(spark, {"id": "a", "year": "2020", "type": "odd", "language": "en"}, {"title": "no id"}, "not json", {"id": 2, "year": 2020.5, "createdAt": "bad"})).collect()}
    assert set(got) == {"a", "2"} and got["a"].year is None and got["a"].type == "OTHER" and got["a"].language == "en" and got["a"].title == "" and got["2"].year is None and got["2"].created_at is None


def test_authorship_payload_keeps_places(spark):
    got = sorted((r.position, r.person_id, r.display_name, r.display_name_en) for r in ingest.authorships_from_json(raw(spark, ITEM)).collect())
    assert got == [(0, 7, "Иванов", "Ivanov"), (2, None, "Петров & Ко", None), (3, None, "Alt", None)]


def test_theses(spark):
    t = {"id": 3, "title": " Тема ", "year": 2021, "learnProgram": {"title": "Pr", "url": "u"}, "orgUnit": {"title": "O"}, "hasEnVersion": True, "supervisors": [{"url": "https://x/org/persons/4", "name": "N"}, {"url": "/staff/5"}]}
    rows = raw(spark, t, {"id": "3x", "title": "a"}, {"id": 4, "title": " "})
    got = ingest.theses_from_json(rows).collect()
    assert [(r.thesis_id, r.title, r.program, r.org_unit, r.has_en_version) for r in got] == [(3, "Тема", "Pr", "O", True)]
    assert [tuple(r) for r in ingest.supervisors_from_json(rows).collect()] == [(3, 4, "N")]


def test_publications_total_counts_items_once(spark):
    df = raw(spark, ITEM, {"id": 6, "authorsByType": {"cmn_editor": [{"id": 7}]}}, {"id": 8, "authorsByType": {"author": [{"id": 7}, {"id": 7}]}}).withColumn("person_id", F.lit(7))
    assert ingest.publications_total(df).head().publications_total == 2


def test_upsert_rules(spark):
    cur = spark.createDataFrame([("p", 0, None, "old", "e"), ("p", 1, 5, "old", "e")], "publication_id string, position int, person_id long, display_name string, display_name_en string")
    inc = spark.createDataFrame([("p", 0, 7, "new", "E"), ("p", 1, 8, "new", None), ("p", 2, 99, "new", "E")], cur.schema)
    people = spark.createDataFrame([(5,), (7,), (8,)], "person_id long")
    nxt = ingest.upsert_authorships(cur, inc, people)
    want = [("p", 0, 7, "old", "E"), ("p", 1, 5, "old", None), ("p", 2, None, "new", "E")]
    assert sorted(tuple(r) for r in nxt.collect()) == want
    assert sorted(tuple(r) for r in ingest.upsert_authorships(nxt, inc, people).collect()) == want


def test_upsert_keeps_columns_it_does_not_have(spark):
    cur = spark.createDataFrame([(1, "a", "tags")], "person_id long, full_name string, tags string")
    nxt = ingest.upsert(cur, spark.createDataFrame([(1, None), (2, "b")], "person_id long, full_name string"), ["person_id"])
    assert sorted(tuple(r) for r in nxt.collect()) == [(1, None, "tags"), (2, "b", None)]


def test_replace_sync_write_back_and_links(spark):
    cur = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "person_id long, title string")
    got = ingest.replace_by_person(cur, spark.createDataFrame([(1, "z")], cur.schema), spark.createDataFrame([(1,), (3,)], "person_id long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "z"), (2, "c")]
    tgt = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    src = spark.createDataFrame([(1, "n"), (2, None), (3, "s")], "id long, v string")
    assert sorted(tuple(r) for r in ingest.sync_columns(tgt, src, "id", ["v"], "v").collect()) == [(1, "n"), (2, "y")]
    sup = ingest.upsert_supervisors(spark.createDataFrame([(1, 1, "old")], "thesis_id long, person_id long, display_name string"), spark.createDataFrame([(1, 2, "n"), (1, 9, "u")], "thesis_id long, person_id long, display_name string"), spark.createDataFrame([(1,), (2,)], "person_id long"))
    assert sorted(tuple(r) for r in sup.collect()) == [(1, 1, "old"), (1, 2, "n")]
    ids = ingest.with_course_ids(cur, F.col("title")).orderBy("id").collect()
    assert [r.title for r in ids] == ["a", "b", "c"] and len({r.id for r in ids}) == 3


def test_filter_tags(spark):
    tags = ["«Теория графов»", "стаж 15 лет", "интересы экономика труда", "иванов методы", "школы россии", "для рынка", "2020 году научно", "12.05.2020 год", "опыт работы в банке", "кот", "университет", "новые методы", "машинное обучение - сети", None, " "]
    df = spark.createDataFrame([(1, t, "Иванов Иван") for t in tags], "k int, tag string, name string").withColumn("k", F.struct("k", "name"))
    assert {r.tag for r in enrich.filter_tags(df, "k", "tag", "k.name").collect()} == {"теория графов", "экономика труда", "машинное обучение-сети"}


def test_rank_tags_and_the_lost_score(spark):
    df = spark.createDataFrame([(1, "анализ данных", 0.9), (1, "Анализ данных", 0.3), (1, "сетевой рынок", 0.8), (1, "рынок", 0.99)], "k int, tag string, score double")
    assert enrich.rank_tags(df, "k").head().tags == ["анализ данных", "сетевой рынок"]
    base = lambda t: "сетевая модель рынка" if t == "сетевой рынок" else t
    assert enrich.rank_tags(df.where("tag <> 'рынок'"), "k", lemmatise=base).head().tags == ["анализ данных", "сетевая модель рынка"]


def test_topics_need_fifty_characters(spark):
    df = spark.createDataFrame([(1, "коротко"), (2, "сетевой анализ городского рынка труда и сетевой анализ миграции населения")], "k int, t string")
    got = {r.k: r.tags for r in enrich.extract_topics(df, "k", "t").collect()}
    assert got[1] == [] and any("сетевой анализ" in t for t in got[2])


def test_embedding_and_mmr(spark):
    df = spark.createDataFrame([("рынок труда",), ("рынка труда",), ("квантовая физика",), (None,), (" ",)], "t string").select(enrich.embed(F.col("t")).alias("v"))
    v = [r.v for r in df.collect()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert len(v[0]) == 384 and dot(v[0], v[0]) == pytest.approx(1, abs=1e-4) and dot(v[0], v[1]) > dot(v[0], v[2]) and v[3] is None and v[4] is None
    assert enrich.mmr([[1, 0], [1, 0], [0, 1]], [0.9, 0.8, 0.5], 2) == [0, 2]


def test_jobs(spark):
    at = lambda m: datetime(2025, 1, 1, 0, m)
    e = jobs.event(spark, "a", at(0), "queued", total=8).union(jobs.event(spark, "a", at(5), "running", processed=1)).union(jobs.event(spark, "a", at(9), "done", processed=5)).union(jobs.event(spark, "b", at(3), "queued", total=0))
    got = {r.job_id: r for r in jobs.latest(e).withColumn("p", jobs.progress(F.col("processed"), F.col("total"))).collect()}
    assert (got["a"].status, got["a"].processed, got["a"].total, got["a"].started_at, got["a"].finished_at, got["a"].p) == ("done", 5, 8, at(0), at(9), 62.5)
    assert got["b"].finished_at is None and got["b"].p is None and [r.job_id for r in jobs.recent(jobs.latest(e)).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="unknown"):
        jobs.event(spark, "a", at(0), "odd")


def test_paged_reader_stops():
    def service(pages):
        seen = []
        return (lambda n: (seen.append(n), {"result": pages[n - 1]})[1]), seen
    full = {"items": [1, 2], "more": True}
    for pages, n in (([full, {"items": [3], "more": False}], 2), ([full, {"items": [], "more": True}], 2), ([dict(full, remaining=0)], 1), ([{}], 1)):
        ask, seen = service(pages)
        list(web.paged_items(ask))
        assert len(seen) == n
    ask, seen = service([full] * 9)
    assert list(web.paged_items(ask, 3)) == [1, 2] * 3
    assert web.plain_items({"success": False, "data": [1]}) == [] and web.plain_items({"success": True, "data": [1]}) == [1]


def test_stored_answers_and_frontier(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"result": {"items": [{"id": 1}, {"id": 2}]}}))
    assert sorted(r.raw for r in web.stored_answers(spark, str(tmp_path / "1.json")).collect()) == ['{"id":1}', '{"id":2}']
    (tmp_path / "2.json").write_text(json.dumps({"success": False, "data": [{"id": 1}]}))
    assert web.stored_theses(spark, str(tmp_path / "2.json")).count() == 0
    links = spark.createDataFrame([("u1", "c1", 3), ("u2", "c1", 1), ("u1", "c2", 2), (None, "c", 0)], "url string, campus string, n int")
    assert [tuple(r) for r in web.frontier(links, "n").collect()] == [("u2", 1, "c1"), ("u1", 2, "c2")] and web.frontier(links, "n", 1).count() == 1
    assert web.enum_table(spark, {"A": "a"}).count() == 1


def test_pages_are_the_whole_order(spark):
    df = spark.range(53).withColumn("x", F.when(F.col("id") % 5 > 0, F.col("id") % 7))
    order = [F.col("x").desc_nulls_first(), F.col("id").asc()]
    every = [r.id for p in range(1, 7) for r in paging.page_of(df, order, p, 10).collect()]
    assert every == [r.id for r in df.orderBy(*order).collect()]
    p = paging.paginate(df, order, 6, 10)
    assert (p.count, p.last_page, p.next_page, p.previous_page) == (53, 6, None, 5) and paging.page_links("http://a/b?page=6&q=x", p) == (None, "http://a/b?q=x&page=5")
    assert paging.one_more(df, order, 5, 10)[1] is True and paging.one_more(df, order, 6, 10)[1] is False


def test_concatenated_page_equals_two_slices(spark):
    a = spark.createDataFrame([(f"a{i}", i) for i in range(7)], "k string, s int")
    b = spark.createDataFrame([(f"b{i}", i) for i in range(9)], "k string, s int")
    parts = [(a, [F.col("s").desc()]), (b, [F.col("s").asc()])]
    line = [f"a{i}" for i in range(6, -1, -1)] + [f"b{i}" for i in range(9)]
    for page in range(1, 6):
        assert [r.k for r in paging.concatenated_page(parts, page, 4).collect()] == line[(page - 1) * 4 : page * 4]


def test_validation_and_lookups(spark, small_dir):
    c = Catalog(spark, small_dir)
    with pytest.raises(ValueError, match="ordering"):
        api.list_persons(c, ordering="odd")
    with pytest.raises(ValueError, match="characters"):
        check_query("a")
    with pytest.raises(ValueError, match="from"):
        check_range("limit", 51, 1, 50)
    with pytest.raises(NotFound):
        require(c.persons, "person_id", -1)
    assert point(c.persons, "person_id", -1).count() == 0 and exists(c.persons, F.col("person_id") > 0) and ready(spark) == "ok"
    assert has_publications("odd") == [] and len(has_publications("true")) == 1
    assert where_all(c.campuses).count() == 4 and api.resolve_campus(c, "нет такого") is None and api.home(c, "x") == {} and "people" in api.home(c)
    assert set(api.home(c, "Словчеров")) >= {"names", "publications", "courses"} and next(iter(api.home(c, "Словчеров"))) == "names"
    assert api.news(c, source="portal").count() == 0


def test_salted_join_equals_plain(spark):
    left = spark.range(500).withColumn("k", F.when(F.col("id") < 400, 1).otherwise(F.col("id")))
    right = spark.createDataFrame([(1, "hot"), (450, "x")], "k long, v string")
    for how in ("inner", "left", "left_semi"):
        got = salted_join(left, right, ["k"], how, F.col("id"))
        want = left.join(right, "k", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert "BroadcastHashJoin" in left.join(broadcast_if_small(right), "k")._jdf.queryExecution().executedPlan().toString()


def test_refresh_applies_each_file_once(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, v int").schema
    store = SnapshotStore(spark, str(tmp_path / "store"), schema)
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: refresh(spark, str(tmp_path / "in"), schema, store, lambda a, b: ingest.upsert(a, b, ["id"]), str(tmp_path / "cp"))
    assert store.read().count() == 0
    put(0, [("a", 1), ("b", 1)])
    go()
    put(1, [("b", 2), ("c", 2)])
    go()
    go()
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_stages_are_read_again_and_dropped(spark):
    from quaestor.plans.lineage import Stage, cut, shared_folder

    folder = shared_folder(spark)
    assert shared_folder(spark) == folder and spark.conf.get("spark.checkpoint.dir")
    s = Stage(spark.range(10), "t")
    assert s.path.startswith(folder) and s.df.count() == 10
    s.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        s.df.count()
    assert sorted(r.id for r in cut(spark.range(3)).collect()) == [0, 1, 2]


def test_spread_only_where_partitions_are_few(spark):
    from quaestor.operators.skew import spread

    cores = spark.sparkContext.defaultParallelism
    assert "Exchange" in spread(spark.range(0, 100, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in spread(spark.range(0, 100, 1, cores))._jdf.queryExecution().executedPlan().toString()


def test_directory_crawl_skips_pages_that_fail(spark):
    pages = {
        "https://x.org/dir/": '<div class="abc-filter__letter"><a href="?udept=1&l=A">А</a><a>-</a></div><div class="abc-filter__letter"><a href="?udept=1&l=B">Б</a></div>',
        "https://x.org/dir/?udept=7&l=A": '<div class="content__person-text"><a href="/staff/2">2</a><a href="/staff/1">1</a><a href="/staff/2">2</a></div>',
        "https://x.org/dir/?udept=8&l=A": '<div class="content__person-text"><a href="/staff/1">1</a></div>',
        "https://x.org/dir/?udept=8&l=B": '<div class="content__person-text"><a href="/staff/3">3</a></div><a href="/other">x</a>',
        "https://x.org/dir/?udept=1&l=B": '<div class="content__person-text"><a href="/staff/9">9</a></div>',
    }

    def fetch(url, payload):
        if url not in pages:
            raise OSError("gone")
        return pages[url]

    one = lambda *a: [(r.url[-1], r.campus_id) for r in web.crawl_directory(spark, "https://x.org/dir/", *a, fetch=fetch).collect()]
    assert one(["7", "8"]) == [("2", "7"), ("1", "7"), ("3", "8")] and one(["7", "8"], None, 2) == [("2", "7"), ("1", "7")]
    assert one(["8"], "Б") == [("3", "8")] and one() == [("9", None)] and web.of_unit("https://x.org/?l=A", "7") == "https://x.org/?l=A"


def test_readers_go_on_after_a_failure(monkeypatch):
    def http(url, payload=None):
        if url.endswith("/2") or (payload or {}).get("authorId") == 2:
            raise OSError("down")
        return json.dumps({"success": True, "data": [{"id": 1}]} if payload is None else {"result": {"items": [{"id": 5}], "more": False}})

    monkeypatch.setattr(web, "http", http)
    theses = web.ThesisSource({"url": "https://x.org/{}", "ids": "1,2,3"}).reader(None)
    assert [r for p in theses.partitions() for r in theses.read(p)] == [(1, '{"id": 1}'), (3, '{"id": 1}')]
    papers = web.PublicationSource({"url": "https://x.org/", "ids": "2,3"}).reader(None)
    assert [r for p in papers.partitions() for r in papers.read(p)] == [(3, '{"id": 5}')]


def test_own_names_and_rejects_are_no_topics(spark):
    text_ = "Анна Мирославовна Вершинина. " + "Сетевой анализ рынка. Вершинина и Эконометрика Города. " * 3
    df = spark.createDataFrame([(1, "Вершинина Анна Мирославовна", text_, ["эконометрика"])], "k int, name string, t string, no array<string>")
    plain = enrich.extract_topics(df, "k", "t").head().tags
    named = enrich.extract_topics(df, "k", "t", person_name="name", rejects="no").head().tags
    assert any("вершинина" in t for t in plain) and named
    assert not any(w in t for t in named for w in ("вершинина", "мирославовна", "анна", "эконометрика"))


def test_context_keeps_the_newest_distinct_titles(spark):
    rows = spark.createDataFrame([(1, 1, " A ", "2020"), (2, 1, "B", "2021"), (3, 1, "A", "2022"), (4, 1, "C", None), (5, 1, " ", "2023"), (6, None, "D", "2023")], "id int, person_id long, title string, academic_year string")
    got = enrich.newest_titles(rows, "person_id", "academic_year", "id", "title", 2, "t").collect()
    assert [(r.person_id, r.t) for r in got] == [(1, ["A", "B"])] and enrich.newest_titles(rows, "person_id", "academic_year", "id", "title", 9, "t").head().t == ["A", "B", "C"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_counted_salting_equals_plain(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, id int")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k % 2 = 1")
    got = salted_join(left, right, ["k"], how, F.col("id"), counted="n", hot_rows=20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right.drop("n"), ["k"], how).collect()))


def test_index_finds_nine_of_ten_of_the_nearest(spark, tmp_path):
    import numpy as np

    from quaestor.operators.vector_index import build_index, search_index

    pubs = spark.read.parquet("/root/testdata/sf0.1/publications.parquet").select("id", "embedding").dropDuplicates(["id"])
    lists = build_index(pubs, "id", "embedding", str(tmp_path / "i"))
    x = pubs.where(vector.usable(F.col("embedding"))).toPandas().sort_values("id")
    v = np.array(x.embedding.tolist())
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, hit = x.id.to_numpy(), 0
    asked = range(0, len(v), len(v) // 12)
    for q in asked:
        got = {r.id for r in search_index(spark, str(tmp_path / "i"), "id", "embedding", v[q].tolist(), 10).select("id").collect()}
        hit += len(got & set(ids[np.argsort(-(v @ v[q]), kind="stable")[:10]]))
    assert lists > 8 and hit >= 0.9 * 10 * len(asked)
    every = search_index(spark, str(tmp_path / "i"), "id", "embedding", v[0].tolist(), 10, None).collect()
    assert [r.id for r in every] == [r.id for r in vector.vector_top_k(pubs, "id", "embedding", v[0].tolist(), 10).collect()]


def test_index_of_nothing(spark, tmp_path):
    from quaestor.operators.vector_index import build_index, search_index

    none = spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, embedding array<float>")
    build_index(none, "id", "embedding", str(tmp_path / "e"))
    assert search_index(spark, str(tmp_path / "e"), "id", "embedding", [0.1] * 384, 3).count() == 0


def test_stages_can_be_dropped(spark):
    from quaestor.plans import lineage

    stage = lineage.Stage(spark.range(3), "x")
    assert stage.df.count() == 3 and lineage.drop_stages(spark) >= 1
    with pytest.raises(Exception):
        stage.df.count()


def test_topics_by_likeness_and_variety(spark):
    df = spark.createDataFrame([(1, "сетевой анализ городского рынка труда и сетевой анализ миграции населения"), (2, None), (3, "коротко")], "k int, t string")
    got = {r.k: r.tags for r in enrich.extract_topics(df, "k", "t", embedder=enrich.hash_embed).collect()}
    assert got[2] == got[3] == [] and any("рынка" in t for t in got[1]) and any("миграции" in t for t in got[1])
    few = enrich.embedded_candidates(df.where("k = 1"), "k", "t", enrich.hash_embed, 3).collect()
    assert len(few) == 3 and all(0 < r.score <= 1 for r in few)


def test_start_and_cancel(spark):
    at = datetime(2026, 1, 1)
    log = jobs.start(spark, "j", at, limit_count=5)
    assert jobs.cancel(log, "j", datetime(2026, 1, 2)).head().status == "cancelling"
    log = log.union(jobs.event(spark, "j", datetime(2026, 1, 2), "cancelling"))
    assert jobs.cancel(log, "j", datetime(2026, 1, 3)).count() == 0
    with pytest.raises(ValueError):
        jobs.cancel(log.union(jobs.event(spark, "j", datetime(2026, 1, 4), "cancelled")), "j", datetime(2026, 1, 5))
    with pytest.raises(LookupError):
        jobs.cancel(log, "x", at)
