import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from letterloom.functions import text as X
from letterloom.operators import checks, voice


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.repartition(1).orderBy("i").select(expression(F.col("x"))).collect()]


TEXTS = st.lists(st.text(alphabet="ab .!?\n\t;é", max_size=40), min_size=1, max_size=30)
QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(TEXTS)
def test_sentences_measured_in_linear_time_are_the_same(spark, values):
    got = column(
        spark, values, lambda x: F.transform(X.sentence_bodies(x), X.sentence_words)
    )
    wanted = [[len(re.findall(r"\S+", s)) for s in re.findall(r"[^.!?]+[.!?]+", v)] for v in values]
    assert got == wanted


@QUICK
@given(TEXTS, st.integers(1, 4))
def test_ngrams(spark, values, n):
    def runs(v):
        words = re.findall(r"[^\W_]+", v.lower())
        return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]

    assert column(spark, values, lambda x: X.ngrams(X.tokens(x), n)) == [runs(v) for v in values]


def test_strip_takes_all_kinds_of_space(spark):
    assert column(spark, ["﻿ \t a b \n"], X.strip) == ["a b"]


def test_a_long_text_without_an_end_mark_is_quick(spark):
    assert column(spark, ["word " * 200_000], lambda x: F.size(X.sentence_bodies(x))) == [0]


def test_a_long_list_of_numbers_needs_no_stack(spark):
    text = ",".join(["12"] * 50_000)
    assert column(spark, [text], lambda x: F.size(X.find_all(x, X.NUMBER))) == [1]


def test_phrase_counts(spark):
    text = "Leverage the data; we LEVERAGE. results-driven, a testament to it"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = checks.forbidden_hits(df, ["leverage", "testament to", "results-driven", "delve"]).collect()
    assert {tuple(r) for r in got} == {(1, "leverage", 2), (1, "testament to", 1), (1, "results-driven", 1)}


@pytest.mark.parametrize(
    ("text", "opener"), [("  «Dear Ms X», hi", "dear ms"), ("One", ""), ("", ""), ("a-b c", "a b")]
)
def test_opener(spark, text, opener):
    assert column(spark, [text], voice.opener) == [opener]


def test_concatenated_parts_make_up_the_whole(spark):
    docs = [("a", i, f"f{i}", "x" * (i % 7)) for i in range(200)] + [("b", 500, "g", "only")]
    df = spark.createDataFrame(docs, "author_id string, doc_id long, name string, text string")
    parts = voice.concat_samples(df, "name", "doc_id", max_chars=300).collect()
    for author in ("a", "b"):
        mine = sorted((p["part_no"], p["text"]) for p in parts if p["author_id"] == author)
        whole = "\n\n".join(f"--- Sample: {n} ---\n{t}" for k, _, n, t in docs if k == author)
        assert "\n\n".join(t for _, t in mine) == whole
    assert len(parts) > 5


def test_absent_words_need_a_chance_where_one_is_named(spark):
    rows = [("a", "we lead teams"), ("a", "delve"), ("b", "nothing")]
    df = spark.createDataFrame(rows, "author_id string, text string")
    got = voice.absent_words(df, ["delve", "leadership"], {"leadership": ["lead"]}).collect()
    assert {tuple(r) for r in got} == {("a", "leadership"), ("b", "delve")}


def test_recurring_patterns(spark):
    rows = [("a", "in my last role in my last role"), ("a", "In my last job"), ("b", "in my last role")]
    df = spark.createDataFrame(rows, "author_id string, text string")
    got = {(r["author_id"], r["phrase"]): r["n_docs"] for r in voice.recurring_patterns(df, 3).collect()}
    assert got == {("a", "in my last"): 2}


def test_section_order_falls_back(spark):
    rows = [("a", "Skills: x\nSummary: y"), ("a", "Skills: x\nSummary: y"), ("a", "Summary: y"), ("b", "none")]
    df = spark.createDataFrame(rows, "author_id string, text string")
    got = voice.section_order(df, ["Summary", "Skills"]).collect()
    assert {tuple(r) for r in got} == {
        ("a", "Skills, Summary", False),
        ("b", "Summary, Experience, Education, Skills", True),
    }
