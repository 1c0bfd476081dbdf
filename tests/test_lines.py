"""Postings as people write them: each form that once gave an empty record or lost lines."""

import pytest
from pyspark.sql import functions as F

from letterloom.operators import extract, lines, profile
from letterloom.plans import phases

MARKDOWN = """# Senior Planner
Acme GmbH - Oslo

**About us**
We value ownership. Our team is small.

**Requirements**
* C++
* .NET

## Nice to have
1. Go
2. C++
"""


def facts(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return df.select(lines.posting_facts(F.col("text")).alias("f")).first()["f"]


def test_a_markdown_posting(spark):
    df = spark.createDataFrame([(1, MARKDOWN)], "id int, text string")
    row = phases.ingest(df).first()
    job = row["job_context"]
    assert (job.job_title, job.company_name, job.location, row["job_slug"]) == (
        "Senior Planner", "Acme GmbH", "Oslo", "acme_gmbh_senior_planner",
    )
    assert (job.required_skills, job.preferred_skills) == (["C++", ".NET"], ["Go"])
    assert job.culture_signals == ["We value ownership.", "Our team is small."]
    assert job.seniority_level.startswith("Senior")


@pytest.mark.parametrize(
    ("text", "pay", "low", "high"),
    [
        ("Compensation: $120k-150k", "$120k-150k", 120_000.0, 150_000.0),
        ("Title: x\nYou get €50.000 – €60.000.", "You get €50.000 – €60.000.", 50_000.0, 60_000.0),
        ("Title: x\n- £30,000", "£30,000", 30_000.0, None),
        ("Title: x", "Not specified", None, None),
    ],
)
def test_pay(spark, text, pay, low, high):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    row = extract.salary_range(df, ["id"]).first()
    assert (row.salary_range, row.salary_low, row.salary_high) == (pay, low, high)


@pytest.mark.parametrize(
    "heading", ["Requirements (must):", "Requirements: (must)", "## Requirements", "**Requirements:**", "__requirements__", "Must-have skills"]
)
@pytest.mark.parametrize("item", ["1. Go", "2) Go", "(3) Go", "– Go", "* Go", "• Go", "  - Go"])
def test_headings_and_items(spark, heading, item):
    got = facts(spark, f"Title: x\n{heading}\nYou bring:\n\n{item}\n".replace("You bring:", "You bring this."))
    assert got.required == ["Go"]
    assert [u.value for u in got.unread] == ["You bring this."]


def test_what_is_left_over(spark):
    text = "Planner at Acme\nPerks\nBenefits:\n- tea\nRequired:\n- Go\nand more\n- lost\n12. May is the day"
    got = facts(spark, text)
    assert (got.job_title, got.company_name, got.required) == ("Planner", "Acme", ["Go"])
    assert [(u.no, u.value) for u in got.unread] == [(2, "Perks"), (4, "tea"), (7, "and more"), (8, "lost"), (9, "May is the day")]


def test_empty_and_long_texts(spark):
    for text in (None, "", "\n \n"):
        got = facts(spark, text)
        assert (got.job_title, got.required, got.unread) == ("", [], [])
    got = facts(spark, "Title: x\nRequired:\n" + "- item\n" * 20_000 + "end " * 50_000)
    assert len(got.required) == 20_000 and len(got.unread) == 1


@pytest.mark.parametrize(
    ("line", "role", "degree"),
    [
        ("- Planner | Acme | Oslo | 1998-10 to present", ("Planner", "Acme", "Oslo", "1998-10", "present"), None),
        ("* Planner at Acme (1998 – 2001)", ("Planner", "Acme", "", "1998", "2001"), None),
        ("1. Planner, Acme, Oslo, May 1998 - today", ("Planner", "Acme", "Oslo", "May 1998", "today"), None),
        ("• Lead · Acme · 03/1998 until 2001", ("Lead", "Acme", "", "03/1998", "2001"), None),
        ("– Lead | Acme | 1996 to", ("Lead", "Acme", "", "1996", ""), None),
        ("- BSc in Maths, School of Oslo, 2004", None, ("BSc in Maths", "School of Oslo", 2004)),
        ("2) MSc, Some School, 2000 – 2004", None, ("MSc", "Some School", 2004)),
        ("* BSc, hons, School (2004)", None, ("BSc, hons", "School", 2004)),
        ("- Led a team of 5 at Acme", None, None),
        ("- Python, SQL", None, None),
    ],
)
def test_resume_lines(spark, line, role, degree):
    df = spark.createDataFrame([(1, f"Ann\r\n{line}\nplain, text, 2004"), (2, None)], "id int, text string")
    roles = [tuple(r)[2:] for r in profile.role_rows(df, ["id"]).collect()]
    degrees = [tuple(r)[1:4] for r in profile.education_rows(df, ["id"]).collect()]
    assert (roles, degrees) == ([role] if role else [], [degree] if degree else [])
    assert profile.unread_items(df, ["id"]).count() == (not role and not degree)
