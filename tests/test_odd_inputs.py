"""Inputs that once ended a job or were lost: repeated facts, pages without a status, odd references."""

import pytest
from pyspark.sql import functions as F

from letterloom.operators import intake, voice
from letterloom.plans import phases


def test_facts_given_twice_or_without_a_name(spark):
    rows = [(1, "fact", "", "city", "Oslo"), (1, "fact", "", "city", "Bergen"), (1, "fact", "", None, "x"),
            (1, "fact", "", "phone", None), (1, "name", "", "Ann", ""), (2, "role", "7", "Planner", "")]
    items = spark.createDataFrame(rows, "applicant_id int, section string, ref string, item string, detail string")
    got = {r.applicant_id: r.profile for r in phases.profile_records(items).collect()}
    assert got[1].facts == {"city": "Oslo", "phone": None}
    assert (got[1].name, got[2].facts) == ("Ann", {})


def test_a_page_without_a_status_is_turned_away(spark):
    rows = [(None, "x" * 60), (204, "x" * 60), (404, "x" * 60), (200, None), (200, "x")]
    got = intake.accept_pages(spark.createDataFrame(rows, "status int, body string")).collect()
    reasons = ["HTTP status unknown", None, "HTTP 404", "too short or empty", "too short or empty"]
    assert [r.reject_reason for r in got] == reasons


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("&#8211; &eacute; &#x41; &mdash; &#X1F600;", "– é A — 😀"),
        ("a&nbsp;b&#160;c &amp;lt; &#38;lt; &lt;p&gt;", "a b c &lt; &lt; <p>"),
        ("&unknown; &#0; &#xD800; &#9999999; &; & &amp", "&unknown; &#0; &#xD800; &#9999999; &; & &amp"),
        ("", ""),
        (None, None),
    ],
)
def test_character_references(spark, text, shown):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(intake.decoded(F.col("t"))).first()[0] == shown
    if text:
        assert df.select(intake.page_lines(F.col("t"))).first()[0] == shown.strip()


def test_an_author_without_a_finished_sentence(spark):
    df = spark.createDataFrame([("a", "no end"), ("b", "One. Two three."), ("c", None)], "author_id string, text string")
    got = {r.author_id: (r.n_sentences, r.mean_words) for r in voice.sentence_profile(df).collect()}
    assert got == {"a": (0, None), "b": (2, 1.5), "c": (0, None)}
