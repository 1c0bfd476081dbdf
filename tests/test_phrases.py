"""Phrases of large tables against plain Python; lists without entries or words; plans that don't grow."""

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from letterloom.operators import checks, phrases as listed_phrases, voice
from letterloom.operators.phrases import each_with_all, phrase_hits


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(texts, phrases):
    out = {}
    for key, text in texts:
        words = words_of(text)
        for phrase in {p for p in phrases if words_of(p)}:
            run = words_of(phrase)
            n = sum(words[i : i + len(run)] == run for i in range(len(words) - len(run) + 1))
            if n:
                out[key, phrase] = out.get((key, phrase), 0) + n
    return out


def table(spark, phrases):
    return spark.createDataFrame([(p,) for p in phrases], "phrase string")


def plan_of(df):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    return plan.getvalue()


def test_same_as_comparing_all(spark):
    rnd = random.Random(0)
    texts = [(i % 30, " ".join(rnd.choice(["a", "B", "c-d", "é", "f!"]) for _ in range(rnd.randrange(25)))) for i in range(40)]
    texts += [(31, None), (32, ""), (33, "a " * 20_000)]
    phrases = ["a", "A", "a a", "b c d", "é", "É a", "f a b", "c", "zz", "--", "", None, "a!", "a b c d é f a"]
    got = phrase_hits(spark.createDataFrame(texts, "k int, text string"), table(spark, phrases), ["k"]).collect()
    assert {(r.k, r.phrase): r.n for r in got} == brute(texts, phrases)


def test_lists_without_entries_or_words(spark):
    df = spark.createDataFrame([(1, "a -- b")], "id int, text string")
    for listed in ([], ["--"], [None], ["", " "]):
        assert checks.forbidden_hits(df, listed).collect() == []
    assert [tuple(r) for r in checks.forbidden_hits(df, ["--", "a b"]).collect()] == [(1, "a b", 1)]
    assert checks.verb_lead(df, []).first().leads_with_verb is False


def test_a_hundred_thousand_phrases(spark):
    phrases = spark.range(100_000).select(F.concat(F.lit("word"), F.col("id") % 5000, F.lit(" next"), "id").alias("phrase"))
    texts = spark.createDataFrame([(i, f"so word{i} next{i} and word{i} next{i + 1}") for i in range(2000)], "id int, text string")
    found = phrase_hits(texts, phrases, ["id"])
    assert found.count() == 2000
    few = phrase_hits(texts, phrases.limit(10), ["id"])
    assert abs(len(plan_of(found)) - len(plan_of(few))) < 500
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert phrase_hits(texts, phrases, ["id"]).agg(F.sum("n")).first()[0] == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_row_meets_every_entry(spark):
    rows, entries = spark.range(7).withColumnRenamed("id", "row"), spark.range(3000).withColumnRenamed("id", "entry")
    both = each_with_all(rows, entries)
    assert both.distinct().count() == both.count() == 21_000
    assert not any(n in plan_of(both) for n in ("CartesianProduct", "NestedLoop"))
    assert each_with_all(rows, entries.limit(0)).count() == 0


def test_authors_without_words(spark):
    df = spark.createDataFrame([("a", "le le la"), ("b", None), ("c", "LA")], "author_id string, text string")
    pairs = spark.createDataFrame([("le", "la"), ("x", "le")], "word_a string, word_b string")
    got = {tuple(r) for r in voice.word_choice(df, pairs).collect()}
    assert got == {
        ("a", "le", "la", 2, 1, "le"), ("a", "x", "le", 0, 2, "le"), ("b", "le", "la", 0, 0, ""),
        ("b", "x", "le", 0, 0, ""), ("c", "le", "la", 0, 1, "la"), ("c", "x", "le", 0, 0, ""),
    }
    lexicon = spark.createDataFrame([("le",), ("x",), ("y z",), (None,)], "word string")
    hints = spark.createDataFrame([("x", "la"), ("x", "le"), ("other", "le")], "word string, hint string")
    absent = {tuple(r) for r in voice.absent_words(df, lexicon, hints).collect()}
    assert absent == {("b", "le"), ("c", "le"), ("a", "x"), ("c", "x"), ("a", "y z"), ("b", "y z"), ("c", "y z")}


def test_runs_of_no_phrase_stay_in_the_scan(spark):
    """Of 200,000 runs that no phrase has, few reach the join, and a full filter only lets more through."""
    phrases = spark.range(500).select(F.concat(F.lit("next word"), F.col("id")).alias("phrase"))
    words = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), i * 100 + F.col("id")))
    texts = spark.range(100).select("id", F.concat_ws(" ", words, F.lit("next word7 Next WORD7")).alias("text"))
    table = listed_phrases.phrase_table(phrases)
    hashed = listed_phrases._hashed(texts, ["id"], "text")
    kept = listed_phrases._runs(hashed, ["id"], [2], listed_phrases.phrase_filter(table)).cache()
    assert kept.count() < 20_000
    assert [tuple(r) for r in kept.join(table, ["n_words", "h1", "h2"]).select("phrase", "n").distinct().collect()] == [
        ("next word7", 2)
    ]
    kept.unpersist()
    full = bytes([255]) * 4096
    assert listed_phrases._runs(hashed, ["id"], [2], full).count() > 200_000


def test_texts_of_many_pieces(spark, monkeypatch):
    """Texts that end inside, at and beyond what is worked on at a time; keys of any type, null among them."""
    monkeypatch.setattr(listed_phrases, "WORDS_AT_ONCE", 5)
    texts = [("x", "a b a b a b c"), (None, "a b"), ("y", None), ("z", "b a"), ("x", "c a b"), ("w", "a")]
    got = phrase_hits(spark.createDataFrame(texts, "k string, text string"), table(spark, ["a b", "b a", "a b c", "A"]), ["k"])
    assert {(r.k, r.phrase): r.n for r in got.collect()} == brute(texts, ["a b", "b a", "a b c", "A"])
