import random

import pytest
from pyspark.sql import functions as F

from letterloom.operators import extract, profile


@pytest.mark.parametrize(
    ("raw", "date"),
    [
        ("1998-10", "1998-10"),
        ("1998", "1998-01"),
        ("Oct 1998", "1998-10"),
        ("october 1998", "1998-10"),
        ("Sept. 2001", "2001-09"),
        ("07/2001", "2001-07"),
        (" Present ", "present"),
        ("now", "present"),
        ("1998-13", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_role_date(spark, raw, date):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(profile.role_date(F.col("x"))).first()[0] == date


def test_overlapping_roles_count_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), s := rng.randrange(300), s + rng.randrange(40), rng.random() < 0.1) for _ in range(400)]
    df = spark.createDataFrame(rows, "applicant_id int, start_m int, end_m int, is_current boolean")
    months = {}
    for person, start, end, current in rows:
        months.setdefault(person, set()).update(range(start, max(end, 320) if current else end))
    got = {r["applicant_id"]: r["n_months"] for r in profile.page_budget(df, 320).collect()}
    assert got == {p: len(m) for p, m in months.items()}


@pytest.mark.parametrize(("months", "pages"), [(83, 1), (84, 2)])
def test_page_budget_turns_at_seven_years(spark, months, pages):
    df = spark.createDataFrame([(1, 0, months, False)], "applicant_id int, start_m int, end_m int, is_current boolean")
    assert profile.page_budget(df, 0).first()["max_pages"] == pages
    assert profile.page_budget(df, 0, has_template=True).first()["max_pages"] == 1


def test_bullets_that_only_start_alike_all_stay(spark):
    rows = [(1, "Reduced cost of the cloud"), (1, "Reduced cost of the call centre"), (1, "reduced, cost"), (1, "!"), (1, None)]
    df = spark.createDataFrame(rows, "role_id int, text string")
    got = {r["text"] for r in profile.merge_bullets(df).collect()}
    assert got == {"Reduced cost of the cloud", "Reduced cost of the call centre", "!", None}


def test_the_longest_version_of_a_bullet_stays(spark):
    rows = [(1, "Led a team of 5"), (1, "Led a team of 5 engineers"), (1, "Led a team of 5"), (1, "Other"), (2, "Other")]
    df = spark.createDataFrame(rows, "role_id int, text string")
    got = {(r["role_id"], r["text"]) for r in profile.merge_bullets(df).collect()}
    assert got == {(1, "Led a team of 5 engineers"), (1, "Other"), (2, "Other")}


def test_newest_value_wins(spark):
    rows = [(1, "city", "A", 1, 1), (1, "city", "B", 3, 2), (1, "city", "C", 3, 1), (1, "phone", "x", 1, 9)]
    df = spark.createDataFrame(rows, "applicant_id int, field string, value string, ts int, id int")
    got = profile.latest_wins(df, ["applicant_id", "field"], ["ts", "id"])
    assert {(r["field"], r["value"]) for r in got.collect()} == {("city", "B"), ("phone", "x")}


def test_contacts(spark):
    text = "Jo Doe, jo.doe@mail.example.org, +49 (170) 123-4567, https://www.linkedin.com/in/jo-doe"
    row = profile.contacts(spark.createDataFrame([(1, text), (2, "none")], "id int, text string")).collect()
    assert tuple(row[0])[1:] == ("jo.doe@mail.example.org", "+49 (170) 123-4567", "https://www.linkedin.com/in/jo-doe")
    assert tuple(row[1])[1:] == ("", "", "")


def test_roles_and_education_of_a_text(spark):
    text = (
        "Jo Doe\nExperience:\n- Dev | Acme | Rome | 1998 to present\n- Ops | Beta | 07/2001 to 2003-01\n"
        "Education:\n- BSc, Physics, Some School, 2004\n- MSc, Other School, 2006.5\n- no year here"
    )
    df = spark.createDataFrame([(1, text)], "id int, text string")
    roles = [tuple(r) for r in profile.role_rows(df, ["id"]).collect()]
    assert roles == [(1, "Jo Doe", "Dev", "Acme", "Rome", "1998", "present"), (1, "Jo Doe", "Ops", "Beta", "", "07/2001", "2003-01")]
    schools = [tuple(r) for r in profile.education_rows(df, ["id"]).collect()]
    assert schools == [(1, "BSc, Physics", "Some School", 2004, True), (1, "MSc", "Other School", 2006, False)]


def test_skills_are_grouped_above_eight(spark):
    rows = [(1, f"s{i}") for i in range(8)] + [(2, f"s{i}") for i in range(9)]
    skills = spark.createDataFrame(rows, "applicant_id int, skill string")
    categories = spark.createDataFrame([("s0", "Tools")], "skill string, category string")
    got = profile.group_skills(skills, categories).collect()
    assert {r["category"] for r in got if r["applicant_id"] == 1} == {""}
    assert {r["category"] for r in got if r["applicant_id"] == 2} == {"Tools", "Other"}


POSTING = """Title: Staff Engineer
Company: Acme
Location: Munich, Germany
Team: Platform
Salary: €60k–€75k
Hiring manager: Ms Doe
About: We ship. Our users matter! It is fun. And more. You lead people.
Responsibilities:
- Build A
- Run B
Required:
- Python
- SQL
Preferred:
- SQL
- Spark
Hybrid work is possible."""


def test_a_posting(spark):
    df = spark.createDataFrame([(1, POSTING), (2, "Title: X")], "id int, text string")
    rows = df.select(extract.job_context(F.col("text")).alias("j")).collect()
    job, bare = rows[0]["j"], rows[1]["j"]
    assert job["job_title"] == "Staff Engineer"
    assert job["company_description"] == "We ship. Our users matter! It is fun."
    assert job["team_or_department"] == "Platform"
    assert job["key_responsibilities"] == ["Build A", "Run B"]
    assert job["required_skills"] == ["Python", "SQL"]
    assert job["preferred_skills"] == ["Spark"]
    assert job["culture_signals"] == ["We ship.", "Our users matter!"]
    assert job["seniority_level"] == "Staff — title includes Staff; mentions leading others"
    assert job["remote_policy"] == "Hybrid"
    assert job["salary_range"] == "€60k–€75k"
    assert bare["salary_range"] == bare["remote_policy"] == bare["team_or_department"] == "Not specified"
    assert bare["required_skills"] == []
    pay = extract.salary_range(df, ["id"]).first()
    assert (pay["salary_low"], pay["salary_high"], pay["currency"]) == (60000.0, 75000.0, "EUR")
    greetings = [r["greeting"] for r in extract.salutation(df, ["id"]).collect()]
    assert greetings == ["Dear Ms Doe,", "Dear Hiring Manager,"]


def test_a_section_of_very_many_items_needs_no_stack(spark):
    text = "Required:\n" + "\n".join(f"- item {i}" for i in range(30_000))
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(F.size(extract.items(F.col("text"), "Required"))).first()[0] == 30_000
