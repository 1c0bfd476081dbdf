"""Work that is done once: list lines, gathered bullets and texts that many rows share."""

import random

from pyspark.sql import functions as F

from letterloom.functions.text import strip
from letterloom.operators import profile
from letterloom.operators.lines import ITEM
from letterloom.plans import phases

RESUME = "A\n- Cook at Works F (1998-01 – 2003-05)\n- BSc in X, School of Y (1999)\n- Led a team of 3"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_not_matched_again_for_each_field(spark):
    df = spark.createDataFrame([(1, RESUME), (2, None), (3, "")], "role_id int, text string")
    roles, degrees = profile.role_rows(df, ["role_id"]), profile.education_rows(df, ["role_id"])
    assert [tuple(r) for r in roles.collect()] == [(1, "A", "Cook", "Works F", "", "1998-01", "2003-05")]
    assert [tuple(r) for r in degrees.collect()] == [(1, "BSc in X", "School of Y", 1999, True)]
    assert [tuple(r) for r in profile.unread_items(df, ["role_id"]).collect()] == [(1, "Led a team of 3")]
    # the regular expression of the whole line: once to ask and once for each of the five fields
    assert plan_of(roles).count("^(.+?)(?: at |, )") <= 6
    used = roles.selectExpr("concat(title, company, start, end, title, company, start, end) AS all")
    assert plan_of(used).count("^(.+?)(?: at |, )") <= 6


def test_list_lines_lose_the_space_at_their_ends(spark):
    rnd = random.Random(1)
    signs = [*"-*1).( \t\x85ab•\ufeff\x0b\u2028", "- ", "1) "]
    texts = [("".join(rnd.choice(signs) for _ in range(rnd.randrange(9))),) for _ in range(5000)]
    apart = F.transform(F.split("text", r"\r?\n|\r"), lambda line: strip(F.regexp_extract(strip(line), ITEM, 1)))
    read = spark.createDataFrame(texts, "text string").select(
        "text", F.filter(apart, lambda i: i != "").alias("a"), profile._list_items(F.col("text")).alias("b")
    )
    assert read.filter("a != b").collect() == []
    assert read.filter("size(b) > 0").count() > 100


def test_bullets_are_gathered_once(spark):
    rows = [(1, "Led a"), (1, "led a team"), (1, "Led"), (None, "Led"), (None, "Led a"), (2, "Led a"), (2, "--"), (1, None)]
    merged = profile.merge_bullets(spark.createDataFrame(rows, "role_id int, text string"))
    assert plan_of(merged).count("regexp_extract_all") <= 1
    assert {(r.role_id, r.version) for r in merged.collect()} == {
        (1, "led a team"), (None, "led"), (None, "led a"), (2, "led a"), (2, ""), (1, None)
    }


def test_equal_postings_are_read_once(spark, monkeypatch):
    text = "Title: Planner\nCompany: Acme\nRequired:\n- x"
    rows = [(i, text) for i in range(5)] + [(5, text + "y"), (6, None), (7, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    plain = {str(r) for r in phases.ingest(df).collect()}
    read, ingest = [], phases.ingest
    monkeypatch.setattr(phases, "ingest", lambda postings: (read.append(postings.count()), ingest(postings))[1])
    assert {str(r) for r in phases.ingest_distinct(df).collect()} == plain
    assert read == [3]
