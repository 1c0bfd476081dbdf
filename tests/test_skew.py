"""Joins on a key that holds most of the rows are split, and stay right."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from letterloom.operators import matching

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def test_a_posting_with_most_of_the_applications(small_partitions):
    spark, n = small_partitions, 200_000
    job = F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 50)
    applications = spark.range(0, n, 1, 8).select(F.col("id").alias("applicant_id"), job.alias("job_id"))
    requirements = spark.range(50 * 4).select(
        (F.col("id") % 50).alias("job_id"),
        F.concat(F.lit("s"), (F.col("id") / 50).cast("int").cast("string")).alias("skill"),
        F.lit("required").alias("level"),
    )
    skills = spark.range(n).select(F.col("id").alias("applicant_id"), F.lit("s1").alias("skill"))
    matched = matching.skill_match(applications, requirements, skills)
    assert len(matched.collect()) == n
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        matched.explain()
    assert "skew=true" in plan.getvalue()


def test_a_skill_that_most_people_hold_covers_one_way(spark):
    n = 60_000
    held = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 40))
    skills = spark.range(0, n, 1, 8).select(F.col("id").alias("applicant_id"), held.alias("skill"))
    covers = spark.createDataFrame(
        [("hot", "wanted"), ("hot", "wanted"), ("wanted", "s0"), ("wanted", "wanted"), ("s3", "wanted"), (None, "wanted")],
        "skill string, covers string",
    )
    gap = spark.range(0, n, 1, 8).select(F.col("id").alias("applicant_id"), (F.col("id") % 5).alias("job_id"), F.lit("wanted").alias("skill"))
    got = matching.transferable_by_cover(gap, skills, covers)
    counts = {r["mitigation"]: (r["n"], r["via"]) for r in got.groupBy("mitigation").agg(F.count("*").alias("n"), F.max("n_via").alias("via")).collect()}
    by_s3 = sum(1 for i in range(0, n, 3) if i % 40 == 3)
    assert counts["transferable from hot, covers wanted"] == (n - n // 3, 1)
    assert counts["transferable from s3, covers wanted"] == (by_s3, 1)
    assert counts["no credible reframe"] == (n // 3 - by_s3, 0)
    back = matching.transferable_by_cover(gap.withColumn("skill", F.lit("hot")), skills, covers)
    assert back.filter("n_via > 0").count() == 0
