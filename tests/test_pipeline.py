import json

from quaestor import schemas
from quaestor.plans import pipeline
from quaestor.plans.samples import PAGE


def start(spark):
    now = {t: schemas.empty(spark, t) for t in schemas.COLUMNS}
    people = spark.createDataFrame([(7, "Старый", "c7", ["tag"]), (55, "Прежний", "c1", ["keep"])], "person_id long, full_name string, campus_id string, interests_extracted array<string>")
    courses = spark.createDataFrame([(1, 55, "Старый курс"), (2, 7, "Чужой курс")], "id int, person_id long, title string")
    return {**now, "persons": schemas.conform(people, "persons"), "courses": schemas.conform(courses, "courses")}


def items(spark):
    a = {"id": 1, "title": "T", "year": 2020, "authorsByType": {"author": [{"id": 55, "title": {"ru": "Иванов"}}, {"id": 404, "title": "Никто"}]}}
    return spark.createDataFrame([(55, json.dumps(a)), (55, json.dumps(a)), (55, '{"title": "no id"}')], "person_id long, raw string")


def test_profiles(spark):
    pages = spark.createDataFrame([("https://x.org/staff/55", PAGE, None), ("https://x.org/none", "<p>", None)], "url string, html string, campus_id string")
    got = pipeline.ingest_profiles(start(spark), pages, items(spark))
    p = {r.person_id: r for r in got["persons"].collect()}
    assert set(p) == {7, 55} and p[55].full_name == "Иванов Иван" and p[55].campus_id == "c1" and p[55].interests_extracted == ["keep"] and p[7].full_name == "Старый"
    assert p[55].publications_total == 2 and p[55].education.degrees[0].year == 2001 and p[55].grants[0].year == 2015
    assert [(r.id, r.year) for r in got["publications"].collect()] == [("1", 2020)]
    assert sorted((r.position, r.person_id) for r in got["authorships"].collect()) == [(0, 55), (1, None)]
    assert sorted((r.person_id, r.title) for r in got["courses"].collect()) == [(7, "Чужой курс"), (55, "Право")]


def test_theses_and_whom_to_ask(spark):
    now = start(spark)
    t = {"id": 3, "title": "Тема", "supervisors": [{"url": "/org/persons/55", "name": "N"}, {"url": "/org/persons/404"}]}
    rows = spark.createDataFrame([(55, json.dumps(t)), (404, json.dumps({"id": 4, "title": "Чужая"})), (55, json.dumps({"id": 5, "title": " "}))], "person_id long, raw string")
    got = pipeline.ingest_theses(now, rows)
    assert [r.thesis_id for r in got["theses"].collect()] == [3] and [(r.thesis_id, r.person_id) for r in got["thesis_supervisors"].collect()] == [(3, 55)]
    assert pipeline.unsupervised(got).count() == 0  # nobody has a position here


def test_enrichment(spark):
    now = start(spark)
    pub = spark.createDataFrame([("1", "Сетевой анализ городского рынка труда и сетевой анализ миграции населения"), ("2", "")], "id string, title string")
    got = pipeline.enrich_all({**now, "publications": schemas.conform(pub, "publications")})
    rows = {r.id: r for r in got["publications"].collect()}
    assert rows["1"].topics and len(rows["1"].embedding) == 384 and rows["2"].topics == [] and rows["2"].embedding is None
    assert {r.person_id: (r.interests_extracted, r.embedding) for r in got["persons"].collect()} == {7: ([], None), 55: ([], None)}


def test_versions_go_up_and_down(spark):
    for name in schemas.COLUMNS:
        for v in range(1, schemas.LATEST + 1):
            df = schemas.empty(spark, name, v)
            assert schemas.conform(df, name).schema.names == schemas.schema(name).names
    old = spark.createDataFrame([("1", "t")], "id string, title string")
    r = schemas.conform(old, "publications").head()
    assert r.type == "OTHER" and r.editors == [] and r.topics == [] and "topics" not in schemas.conform(schemas.conform(old, "publications"), "publications", 2).columns


def test_results_as_json(spark):
    df = spark.createDataFrame([(1, "n")], "person_id long, full_name string")
    got = json.loads(schemas.as_json(df, "person_summary").head().json)
    assert got["person_id"] == 1 and got["campus_name"] is None and list(got)[0] == "person_id"
