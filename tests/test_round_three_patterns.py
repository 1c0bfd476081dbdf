"""Recurring phrases are counted in arrays before the shuffle, and each phrase once a document."""

import random
import re
from collections import Counter

import pytest

from letterloom.operators import voice


@pytest.mark.parametrize(("n", "at_once"), [(1, 1 << 22), (3, 1 << 22), (3, 40), (5, 1)])
def test_phrases_against_counting(spark, monkeypatch, n, at_once):
    monkeypatch.setattr(voice, "BYTES_AT_ONCE", at_once)
    rng = random.Random(n)
    words = ["a", "B", "ß", "İx", "日本", "9", "𝒳", "d"]
    texts = [rng.choice(["", " ", "--"]).join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = [(rng.choice(["x", "y", None]), t) for t in [*texts, *texts[:40], "", "--", " a ", None]]
    df = spark.createDataFrame(rows, "author_id string, text string").repartition(3)
    lowered = {r["t"]: r["low"] for r in df.selectExpr("text AS t", "lower(text) AS low").collect()}
    expected = Counter()
    for author, text in rows:
        found = [w for w in re.findall(r"[^\W_]+", lowered[text] or "")]
        if text and "İ" in text:  # lower case has a combining dot, which is no letter
            found = [w for w in re.findall(r"[^\W_]+", lowered[text].replace("̇", " "))]
        expected.update({(author, " ".join(found[i : i + n])) for i in range(len(found) - n + 1)})
    got = voice.recurring_patterns(df, n, keep_weak=True)
    assert {(r["author_id"], r["phrase"]): r["n_docs"] for r in got.collect()} == dict(expected)
    strong = voice.recurring_patterns(df, n).collect()
    assert {(r["author_id"], r["phrase"]) for r in strong} == {k for k, v in expected.items() if v >= 2}
    assert {r["signal"] for r in strong} <= {"reliable"}


def test_no_table_of_all_phrases_before_the_shuffle(spark):
    df = spark.createDataFrame([("x", "a b c d"), ("x", "a b c")], "author_id string, text string")
    plan = voice.recurring_patterns(df)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(author_id") :]
    assert "HashAggregate" not in below and "array_distinct" not in below
