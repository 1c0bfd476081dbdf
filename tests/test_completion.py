import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from letterloom.operators.answers import complete_logged, read_log
from letterloom.operators.completion import complete, generation_prompt, strategy_prompt, with_tier
from letterloom.plans import phases
from letterloom.schemas import GENERATION_OUTPUT, TAILORING_STRATEGY

GOOD = json.dumps({"cover_letter": "a", "resume_content": "b", "other": 1})


def rows(spark, n=6):
    return spark.range(n).select("id", F.concat(F.lit("p"), "id").alias("prompt"), F.array("id").alias("kept"))


def test_answers(spark):
    got = complete(rows(spark), "prompt", GENERATION_OUTPUT, lambda p, s, t: GOOD, tier="strong").collect()
    assert len(got) == 6
    assert {(r["answer"]["cover_letter"], r["attempts"], r["error"], r["tier"]) for r in got} == {("a", 1, None, "strong")}
    assert all(r["kept"] == [r["id"]] for r in got)


@pytest.mark.parametrize(
    ("reply", "place"),
    [
        ("not JSON", "JSONDecodeError"),
        ("[]", "$"),
        ('{"cover_letter": "a"}', "$.resume_content"),
        ('{"cover_letter": 1, "resume_content": "b"}', "$.cover_letter"),
        ('{"cover_letter": "a", "resume_content": "b", "template_variables": {"X": 2}}', "$.template_variables.X"),
        ('{"cover_letter": "a", "resume_content": "b", "template_variables": null}', "$.template_variables"),
    ],
)
def test_wrong_answers(spark, reply, place):
    done = complete(rows(spark, 1), "prompt", GENERATION_OUTPUT, lambda p, s, t: reply, base_delay=0.0)
    row = done.first()
    assert (row["attempts"], row["answer"]) == (3, None)
    assert place in row["error"]


def test_two_failures_then_an_answer(spark, tmp_path):
    log = str(tmp_path / "calls")

    def flaky(prompt, schema, tier):
        import time

        with open(log, "a") as out:
            out.write(f"{time.time()}\n")
        if len(open(log).readlines()) < 3:
            raise OSError("busy")
        return GOOD

    row = complete(rows(spark, 1).coalesce(1), "prompt", GENERATION_OUTPUT, flaky, base_delay=0.1).first()
    assert (row["attempts"], row["error"]) == (3, None)
    first, second, third = [float(line) for line in open(log).readlines()]
    assert 0.1 <= second - first < third - second
    assert third - second >= 0.2


def test_last_error_is_kept_or_ends_the_job(spark):
    def never(prompt, schema, tier):
        raise OSError("down")

    row = complete(rows(spark, 1), "prompt", GENERATION_OUTPUT, never, base_delay=0.0).first()
    assert (row["attempts"], row["error"]) == (3, "OSError: down")
    with pytest.raises(PythonException, match="down"):
        complete(rows(spark, 1), "prompt", GENERATION_OUTPUT, never, base_delay=0.0, fail_fast=True).collect()


def test_nested_answers(spark):
    bad = {
        "positioning_angle": "", "resume_summary_angle": "", "skills_to_highlight": [], "cover_letter_hooks": [],
        "skills_gap_strategy": [{"missing_skill": "x"}], "experiences_to_emphasize": [],
    }
    done = complete(rows(spark, 1), "prompt", TAILORING_STRATEGY, lambda p, s, t: json.dumps(bad), max_attempts=1)
    assert "$.skills_gap_strategy[0].mitigation" in done.first()["error"]


def test_tiers(spark):
    df = spark.createDataFrame([("ingestion",), ("strategy",), ("generation",)], "phase string")
    assert [r["tier"] for r in with_tier(df, "phase").collect()] == ["fast", "strong", "strong"]


def test_a_tier_column_decides(spark):
    df = rows(spark, 1).withColumn("tier", F.lit("strong"))

    def fn(prompt, schema, tier):
        return json.dumps({"cover_letter": tier, "resume_content": ""})

    assert complete(df, "prompt", GENERATION_OUTPUT, fn).first()["answer"]["cover_letter"] == "strong"


def test_prompts(spark):
    record = F.struct(F.lit("x").alias("k"))
    df = spark.createDataFrame([("{{A}}",), (None,)], "template string")
    first = df.select(strategy_prompt(record, record, record)).first()[0]
    assert [line for line in first.split("\n") if line.startswith("## ")] == [
        "## Job Context", "## Applicant Profile", "## Applicant Writing Style",
    ]
    with_template, without = [
        r[0] for r in df.select(generation_prompt(record, record, record, record, F.col("template"))).collect()
    ]
    titles = ["## Tailoring Strategy", "## Author Writing Voice", "## Applicant Profile", "## Target Job"]
    assert [line for line in without.split("\n") if line.startswith("## ")] == titles
    assert "{{A}}" in with_template
    assert "LaTeX" not in without


def test_produce_calls_the_function_once_per_row(spark, tmp_path):
    log = str(tmp_path / "calls")

    def fn(prompt, schema, tier):
        with open(log, "a") as out:
            out.write("x")
        return json.dumps({"cover_letter": "c", "resume_content": "r", "template_variables": {"A": "1"}})

    record = F.struct(F.lit("x").alias("k"))
    df = spark.createDataFrame([(1, "{{A}}{{B}}"), (2, None)], "id int, text string").select(
        "id", "text", F.col("text").alias("template"), *[record.alias(n) for n in ("strategy", "style", "profile", "job")]
    )
    made = phases.produce(df, fn, contract=False)
    made.count()
    got = {r["id"]: (r["filled"], r["unfilled_keys"]) for r in made.collect()}
    assert got == {1: ("1{{B}}", ["B"]), 2: (None, None)}
    assert len(open(log).read()) == 2


def test_a_forgotten_hole_is_asked_for_again(spark):
    seen = []

    def fn(prompt, schema, tier):
        seen.append(prompt)
        fields = {f["name"]: f["type"] for f in json.loads(schema)["fields"]}["template_variables"]
        keys = [f["name"] for f in fields["fields"]] if fields["type"] == "struct" else []
        never = "never" in prompt
        variables = {k: "1" for k in (keys if seen.count(prompt) > 1 and not never else keys[1:])}
        return json.dumps({"cover_letter": "c", "resume_content": "r", "template_variables": variables})

    rows = [(1, ["A", "B"], "p1"), (2, [], "p2"), (3, None, "p3"), (4, ["A"], "never")]
    df = spark.createDataFrame(rows, "id int, holes array<string>, prompt string").coalesce(1)
    done = complete(df, "prompt", GENERATION_OUTPUT, fn, base_delay=0.0, required="holes")
    got = {r["id"]: (r["attempts"], r["error"]) for r in done.collect()}
    missing = "ValueError: answer breaks the schema at $.template_variables.A"
    assert got == {1: (2, None), 2: (1, None), 3: (1, None), 4: (3, missing)}


def calls_of(path):
    return sorted(open(path).read().split())


def logging_stub(path):
    def fn(prompt, schema, tier):
        import os
        import time

        with open(path, "a") as out:
            out.write(f"{prompt}\n")
        if prompt == "p7" and not os.path.exists(path + ".ready"):
            time.sleep(2)  # other tasks end meanwhile
            os._exit(1)  # as if the executor were lost
        if prompt == "p3" and not os.path.exists(path + ".ready"):
            raise OSError("down")
        return GOOD

    return fn


def test_a_killed_run_pays_no_logged_answer_twice(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), str(tmp_path / "log")
    df = rows(spark, 24)
    with pytest.raises(Exception, match="crashed|SparkException|aborted"):
        complete_logged(
            df, "prompt", GENERATION_OUTPUT, logging_stub(calls), log, max_attempts=1, parallelism=3, batch=2
        ).collect()
    first = calls_of(calls)
    paid = {r[0] for r in spark.read.parquet(log).filter("answer_json is not null").select("prompt_key").collect()}
    assert "p7" in first and 0 < len(paid) < 24
    open(calls + ".ready", "w").close()
    done = complete_logged(
        df, "prompt", GENERATION_OUTPUT, logging_stub(calls), log, max_attempts=1, parallelism=3, batch=2
    ).collect()
    assert len(done) == 24 and all(r["answer"]["cover_letter"] == "a" and r["error"] is None for r in done)
    # every call of the first run is asked again only if it is not in the log
    assert len(calls_of(calls)) == len(first) + 24 - len(paid)
    assert read_log(spark, log).count() == 24
    complete_logged(df, "prompt", GENERATION_OUTPUT, logging_stub(calls), log, parallelism=3, batch=2).collect()
    assert len(calls_of(calls)) == len(first) + 24 - len(paid)


def test_equal_prompts_are_paid_once_and_errors_are_kept(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), str(tmp_path / "log")
    fn = logging_stub(calls)
    df = spark.createDataFrame([(1, "p1"), (2, "p1"), (3, "p3"), (4, None)], "id int, prompt string")
    df = df.withColumn("prompt_key", F.lit("taken"))
    done = complete_logged(df, "prompt", GENERATION_OUTPUT, fn, log, base_delay=0.0, max_attempts=2)
    got = {r["id"]: (r["attempts"], r["error"], r["prompt_key"]) for r in done.collect()}
    assert got == {1: (1, None, "taken"), 2: (1, None, "taken"), 3: (2, "OSError: down", "taken"), 4: (1, None, "taken")}
    assert calls_of(calls) == ["p1", "p3", "p3"]
    with pytest.raises(RuntimeError, match="down"):
        complete_logged(df, "prompt", GENERATION_OUTPUT, fn, log, base_delay=0.0, max_attempts=1, fail_fast=True)
    empty = complete_logged(df.limit(0), "prompt", GENERATION_OUTPUT, fn, log)
    assert empty.collect() == []


def test_produce_with_a_log(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), str(tmp_path / "log")
    open(calls + ".ready", "w").close()
    record = F.struct(F.lit("x").alias("k"))
    df = spark.range(3).select(
        "id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("template"),
        *[record.alias(n) for n in ("strategy", "style", "profile", "job")],
    )
    for _ in range(2):
        made = phases.produce(df, logging_stub(calls), log=log)
        assert [r["cover_letter"] for r in made.collect()] == ["a"] * 3
    assert open(calls).read().count("## Tailoring Strategy") == 1  # one prompt for three rows, in two runs
