"""What a step leaves on disk and in memory."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from letterloom.operators import matching
from letterloom.operators.phrases import phrase_hits
from letterloom.operators.profile import merge_bullets
from letterloom.plans.phases import ingest, ingest_distinct
from letterloom.session import materialise
from letterloom.sources import files, sinks
from letterloom.sources.store import update_store
from letterloom.streaming.postings import with_saved_records
from test_round_three_matching import plan_of, world


def block_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length()


def test_shuffled_rows_go_with_their_step(spark):
    table = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = block_files(spark)
    for _ in range(5):
        assert materialise(table, "kept").count() == 7
    until = time.time() + 20
    while block_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert block_files(spark) <= before
    assert table.collect() == table.collect()  # worked out again where its shuffled rows are gone


def test_parts_of_strategies_are_written(spark):
    (applications, asked, links, roles), *_ = world(spark)
    skills = links.join(roles, "role_id").select("applicant_id", "skill").distinct()
    made = matching.strategise(
        applications,
        asked.withColumn("level", F.lit("required")),
        skills,
        skills.select("skill", F.col("skill").alias("topic")).distinct(),
        roles.select("*", F.lit("t").alias("title"), F.lit("c").alias("company")),
        links.select("role_id", "bullet_no", "text"),
    )
    read = {Path(f).parent.name.rsplit("-", 1)[0] for f in made.inputFiles()}
    assert read == {"applications", "chosen", "matched", "gaps", "hooks"}


def test_beginnings_of_bullets_cross_as_two_numbers(spark):
    rows = [("a", "1", "cut costs"), ("a", "1", "cut costs now"), ("a", "2", "cut costs"), (None, "1", "cut"), (None, "1", "cut it"), ("b", None, "x"), ("b", None, "x y")]
    bullets = spark.createDataFrame(rows, "p string, r string, text string")
    merged = merge_bullets(bullets, ["p", "r"])
    want = {("a", "1", "cut costs now"), *rows[2:]}
    assert {(x.p, x.r, x.text) for x in merged.collect()} == want
    (anti,) = [line for line in plan_of(merged).splitlines() if "LeftAnti" in line]
    assert "h1#" in anti and "h2#" in anti and "p#" not in anti and "r#" not in anti


def test_hits_of_long_lists_are_shuffled_once(spark):
    texts = spark.createDataFrame([(1, "a b a b"), (1, "A, b"), (2, "b a"), (None, "a b")], "id int, text string")
    phrases = spark.createDataFrame([("a b",), ("A b",), ("b",), ("c",)], "phrase string")
    want = [(None, "A b", 1), (None, "a b", 1), (None, "b", 1), (1, "A b", 3), (1, "a b", 3), (1, "b", 3), (2, "b", 1)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size, exchanges in (("-1", 2), (limit, 2)):  # both sides of the join, or the broadcast and the counts
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            hits = phrase_hits(texts, phrases, ["id"])
            assert plan_of(hits).count("Exchange") == exchanges
            assert sorted(map(tuple, hits.collect()), key=lambda r: (r[0] or 0, r[1])) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_records_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    text = "Title: Planner\nCompany: Acme\nRequired:\n- x"
    people, styles = (str(tmp_path / n) for n in ("people", "styles"))
    ids = spark.range(4).select(F.col("id").alias("applicant_id"))
    update_store(ids.select("applicant_id", F.struct(F.lit("n").alias("name")).alias("profile")), people, ["applicant_id"])
    update_store(ids.filter("applicant_id > 0").select("applicant_id", matching.default_style().alias("style")), styles, ["applicant_id"])
    asked = spark.createDataFrame([(i, j, text) for i in (0, 1, 9) for j in (1, 2)] + [(1, 3, None)], "applicant_id long, job_id long, text string")
    prepared = ingest_distinct(asked, with_saved_records(people, styles))
    assert prepared.columns == ["applicant_id", "job_id", "job_context", "job_slug", "profile", "style", "is_default"]
    assert "Broadcast" not in plan_of(prepared)
    got = {(r.applicant_id, r.job_id, r.job_slug, r.profile and r.profile.name, r.is_default) for r in prepared.collect()}
    slug, none = "acme_planner", ingest(asked.filter("job_id = 3")).first().job_slug
    want = {(i, j, slug, n, d) for i, n, d in ((0, "n", True), (1, "n", False), (9, None, True)) for j in (1, 2)}
    assert got == want | {(1, 3, none, "n", False)}


def test_texts_are_written_by_the_tasks(spark, tmp_path):
    rows = [(1, "a\nb"), (-2, ""), (3, None), (None, "ü"), (1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for name, base in (("plain", str(tmp_path)), ("url", f"file://{tmp_path}"), ("one slash", f"file:{tmp_path}")):
        sinks.write_texts(df, f"{base}/{name}", "doc_id")
        sinks.write_texts(df, f"{base}/{name}", "doc_id")  # as a task that runs again
        read = files.read_samples(spark, f"{base}/{name}", "letter")
        got = {(r[0], r.text) for r in read.select(sinks.key_of_text(read, "doc_id"), "text").collect()}
        assert got == {(1, "a\nb\nc\n"), (-2, "\n"), (3, "\n"), (None, "ü\n")}
        assert not list(tmp_path.glob(f"{name}/**/*.crc"))


def test_cardinality_is_checked_on_written_parts(spark, tmp_path):
    (applications, asked, links, roles), *_ = world(spark)
    skills = links.join(roles, "role_id").select("applicant_id", "skill").distinct()
    made = matching.strategise(
        applications,
        asked.withColumn("level", F.lit("required")),
        skills,
        skills.select("skill", F.col("skill").alias("topic")).distinct(),
        roles.select("*", F.lit("t").alias("title"), F.lit("c").alias("company")),
        links.select("role_id", "bullet_no", "text"),
    )
    checked = matching.cardinality_check(made)
    # one join, of the applications with the grouped parts
    assert sum("Join " in line for line in plan_of(checked).splitlines()) == 1
