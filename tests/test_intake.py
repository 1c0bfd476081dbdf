import json

import pytest
from pyspark.sql import functions as F

from letterloom.operators import intake
from letterloom.operators.records import split_valid, validate_records
from letterloom.schemas import AUTHOR_STYLE, GENERATION_OUTPUT, USER_PROFILE


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.example.com/jobs/12/", "example_com_jobs_12"),
        ("HTTPS://WWW.Example.com/Jobs?id=1", "example_com_Jobs"),
        ("https://example.com/Jobs?id=2#top", "example_com_Jobs"),
        ("http://user:secret@example.com:8080/a//b", "example_com_a_b"),
        ("https://example.com", "example_com"),
        ("https://example.com/für/x y", "example_com_f_C3_BCr_x_20y"),
        ("https://example.com/" + "a" * 200, ("example_com_" + "a" * 200)[:80]),
        ("https://example.com/" + "a" * 67 + "/b", "example_com_" + "a" * 67 + "_"),
        ("https://example.com/p/../q", "example_com_p_q"),
    ],
)
def test_url_key(spark, url, key):
    assert one(spark, url, intake.url_key) == key


def test_url_key_of_a_bad_url_is_repeatable(spark):
    first, again = (one(spark, "not a url", intake.url_key) for _ in range(2))
    assert first == again
    assert first.startswith("fetched_job_")


@pytest.mark.parametrize(
    ("company", "title", "slug"),
    [
        ("Acme Inc.", "Planner (m/f)", "acme_inc_planner_m_f"),
        ("É", "ö", "unnamed"),
        ("__", "x", "x"),
    ],
)
def test_job_slug(spark, company, title, slug):
    made = one(spark, company, lambda c: intake.job_slug(c, F.lit(title)))
    assert made == slug
    assert one(spark, made, lambda c: intake.slug(c)) == slug


def test_routes_are_case_sensitive(spark):
    names = ["http://a", "https://a", "HTTP://a", "a.txt", " https://a"]
    df = spark.createDataFrame([(n,) for n in names], "source string")
    routes = [r["route"] for r in intake.route_sources(df, "source").collect()]
    assert routes == ["url", "url", "file", "file", "file"]


def test_pages_of_forty_nine_characters_are_too_short(spark):
    rows = [(200, " \n" + "x" * 49 + " "), (200, "x" * 50), (299, "x" * 50), (301, "x" * 99), (200, None)]
    df = spark.createDataFrame(rows, "status int, body string")
    reasons = [r["reject_reason"] for r in intake.accept_pages(df).collect()]
    assert reasons == ["too short or empty", None, None, "HTTP 301", "too short or empty"]


def test_page_text(spark):
    html = (
        "<html><head><style>p{}</style><script>var a='<p>';</script></head><nav><a>Home</a></nav>"
        "<!-- note --><p>Fish &amp; chips&nbsp;&lt;now&gt;</p>\n<b>x</b></html>"
    )
    assert one(spark, html, intake.page_text) == "Fish & chips <now> x"


def test_hidden_names_are_dropped_and_others_kept(spark):
    df = spark.createDataFrame([(n,) for n in [".x", "_x", "a.pdf", "B.PDF"]], "name string")
    assert [r[0] for r in intake.visible_only(df, "name").collect()] == ["_x", "a.pdf", "B.PDF"]


def profile(**changes):
    record = {
        "name": "A", "email": "a@b.c", "summary": "s", "skills": ["x"],
        "experience": [{
            "title": "t", "company": "c", "location": "", "start_date": "", "end_date": "", "bullets": ["b"],
        }],
        "education": [{"degree": "d", "school": "s", "graduation_year": 2000.5}],
    }
    record.update(changes)
    return json.dumps({k: v for k, v in record.items() if v is not ...})


RECORDS = [
    (profile(), []),
    (profile(hobby="x"), []),
    (profile(phone="1"), []),
    (profile(phone=None), [("$.phone", "wrong type", "null")]),
    (profile(email=...), [("$.email", "missing", "undefined")]),
    (profile(skills="x"), [("$.skills", "wrong type", "string")]),
    (
        profile(skills=["x", 1, True]),
        [("$.skills[1]", "wrong type", "number"), ("$.skills[2]", "wrong type", "boolean")],
    ),
    (
        profile(experience=[{"title": "t", "company": "c", "location": "", "start_date": "", "bullets": {}}]),
        [
            ("$.experience[0].end_date", "missing", "undefined"),
            ("$.experience[0].bullets", "wrong type", "object"),
        ],
    ),
    (
        profile(education=[{"degree": "d", "school": "s", "graduation_year": "2000"}]),
        [("$.education[0].graduation_year", "wrong type", "string")],
    ),
    ("[1]", [("$", "wrong type", "array")]),
    ("{", [("$", "not JSON", "text")]),
]


def test_validation(spark):
    rows = [(i, text) for i, (text, _) in enumerate(RECORDS)]
    df = spark.createDataFrame(rows, "id int, json string")
    found = {}
    for r in validate_records(df, "json", USER_PROFILE, ["id"]).collect():
        found.setdefault(r["id"], []).append((r["path"], r["problem"], r["found"]))
    assert found == {i: problems for i, (_, problems) in enumerate(RECORDS) if problems}
    valid, invalid = split_valid(df, "json", USER_PROFILE)
    assert {r["id"] for r in valid.collect()} == {0, 1, 2}
    assert {r["id"] for r in invalid.collect()} == set(range(3, len(RECORDS)))


def test_unknown_keys_are_dropped(spark):
    df = spark.createDataFrame([(profile(hobby="x"),)], "json string")
    valid, _ = split_valid(df, "json", USER_PROFILE)
    assert "hobby" not in valid.select(F.to_json("record")).first()[0]


def test_nested_and_map_schemas(spark):
    rows = [
        (1, '{"cover_letter": "a", "resume_content": "b"}'),
        (2, '{"cover_letter": "a", "resume_content": "b", "template_variables": {"X": 1}}'),
    ]
    df = spark.createDataFrame(rows, "id int, json string")
    found = validate_records(df, "json", GENERATION_OUTPUT, ["id"]).collect()
    assert [(r["id"], r["path"]) for r in found] == [(2, "$.template_variables.X")]
    style = spark.createDataFrame([(1, '{"voice_profile": {}}')], "id int, json string")
    paths = {r["path"] for r in validate_records(style, "json", AUTHOR_STYLE, ["id"]).collect()}
    assert "$.resume_structure_preferences" in paths
    assert "$.voice_profile.tone" in paths


def test_dry_run(spark):
    samples = spark.createDataFrame([(1, "resume"), (1, "cover_letter"), (2, "cover_letter")], "applicant_id int, kind string")
    requests = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, True)], "applicant_id int, posting_found boolean")
    profiles = spark.createDataFrame([(4, True), (5, False)], "applicant_id int, is_valid boolean")
    rows = {r["applicant_id"]: r for r in intake.dry_run_report(samples, requests, profiles).collect()}
    assert [rows[i]["reason"] for i in range(1, 6)] == [
        "", "no profile and no resumes", "job posting not found", "", "invalid profile",
    ]
    assert [rows[i]["will_extract"] for i in range(1, 6)] == [True, False, False, False, False]
