"""The grouped building blocks, with one group that holds most of the rows."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from letterloom.functions.ranking import most_common, running_totals, top_rows


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"), i, rng.randrange(50)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, v long").repartition(6)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_top_rows(spark):
    rows = skewed()
    top = top_rows(frame(spark, rows), ["k"], [F.col("v").desc(), F.col("i").asc()], 3)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    wanted = [r for g in groups.values() for r in sorted(g, key=lambda r: (-r[2], r[1]))[:3]]
    assert sorted(tuple(r) for r in top.collect()) == sorted(wanted)


def test_top_rows_limits_before_the_shuffle(spark):
    plan = plan_of(top_rows(frame(spark, skewed()), ["k"], [F.col("i").asc()], 3))
    partial, exchange = plan.index("Partial"), plan.index("Exchange hashpartitioning(k")
    assert "WindowGroupLimit" in plan
    assert exchange < partial  # the plan is printed from the result down to the scan


def test_running_totals(spark):
    rows = skewed()
    got = running_totals(frame(spark, rows), ["k"], "i", "v", "before").collect()
    before, wanted = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        wanted[i] = before.get(k, 0)
        before[k] = wanted[i] + v
    assert {r["i"]: r["before"] for r in got} == wanted


def test_running_totals_of_a_hot_group_with_sparse_orders(spark, monkeypatch):
    from letterloom.functions import ranking

    written = []
    kept = ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, purpose: written.append(kept(df, purpose)) or written[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 70))
        time = F.timestamp_seconds(F.col("id") * F.col("id") * 3600)  # far apart, and ever farther
        df = spark.range(0, 40_000, 1, 8).select(hot.alias("k"), time.alias("t"), F.lit(1).alias("v"), "id")
        got = running_totals(df, ["k"], "t", "v", "before")
        assert got.filter("k = 'hot'").agg(F.max("before"), F.count_distinct("before")).first()[:] == (35_999, 36_000)
        (cut,) = written
        sizes = [r["count"] for r in cut.groupBy("k", "__range").count().collect()]
        assert max(sizes) < 2 * 40_000 / 16
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_most_common_prefers_the_smaller_value_on_ties(spark):
    rows = [("a", 1, 5), ("a", 2, 3), ("a", 3, 5), ("a", 4, 3), ("b", 5, 9)]
    got = most_common(frame(spark, rows), ["k"], "v").collect()
    assert {(r["k"], r["v"], r["support"]) for r in got} == {("a", 3, 2), ("b", 9, 1)}
