"""Updates of a keyed store: what is written, what stays, and what readers see of lost updates."""

import os
import time

import pytest
from pyspark.sql import functions as F

from letterloom.sources.store import read_store, touched_rows, update_store, versions


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def rows_of(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_a_small_update_writes_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.range(20_000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    one = update_store(first, path, ["k"], buckets=64)
    before = files_of(path + "/data")
    time.sleep(0.05)
    new = spark.createDataFrame([(k, "new") for k in (3, 17, 3_000_000)], "k long, v string")
    two = update_store(new, path, ["k"])
    after = files_of(path + "/data")
    assert all(after[f] == t for f, t in before.items())  # nothing that was written is touched
    folders = {os.path.dirname(f) for f in after if f not in before and f.endswith(".parquet")}
    assert 1 <= len({f for f in folders if "bucket=" in f}) <= 3
    assert versions(spark, path).filter(F.col("version") == two).count() <= 3
    got = dict(rows_of(read_store(spark, path)))
    assert len(got) == 20_001 and [k for k, v in got.items() if v == "new"] == [3, 17, 3_000_000]
    assert rows_of(read_store(spark, path, version=one)) == rows_of(first)


def test_readers_see_nothing_of_a_lost_update(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    update_store(df, path, ["k"], buckets=4)
    # a writer that was lost before its manifest: folders of the next version, half of them
    df.withColumn("v", F.lit("lost")).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(
        f"{path}/data/version=2"
    )
    assert rows_of(read_store(spark, path)) == [(1, "a"), (2, "b")]
    update_store(spark.createDataFrame([(2, "c")], "k long, v string"), path, ["k"])
    assert rows_of(read_store(spark, path)) == [(1, "a"), (2, "c")]


def test_odd_keys_and_updates(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "a int, k string, v string"
    keys = ["a", "k"]
    update_store(spark.createDataFrame([], schema), path, keys, buckets=3)
    assert read_store(spark, path).collect() == []
    update_store(spark.createDataFrame([(1, None, "x"), (None, None, "y"), (1, "", "z"), (1, None, "x")], schema), path, keys)
    assert read_store(spark, path).count() == 4
    update_store(spark.createDataFrame([(1, None, "new")], schema), path, keys)
    got = sorted(((r.a, r.k, r.v) for r in read_store(spark, path).collect()), key=str)
    assert got == sorted([(1, None, "new"), (None, None, "y"), (1, "", "z")], key=str)
    with pytest.raises(ValueError, match="columns"):
        update_store(spark.createDataFrame([(1, "x")], "a int, k string"), path, keys)
    with pytest.raises(ValueError, match="itself"):
        update_store(spark.createDataFrame([(1, 2)], "k int, bucket int"), str(tmp_path / "other"), ["k"])
    with pytest.raises(ValueError, match="no store"):
        read_store(spark, str(tmp_path / "none"))
    assert touched_rows(spark, str(tmp_path / "none"), spark.range(1), ["id"]) is None
    part = touched_rows(spark, path, spark.createDataFrame([(1, "")], "a int, k string"), keys)
    assert 1 <= part.filter("k = ''").count() <= part.count() <= 3
