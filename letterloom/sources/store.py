"""A keyed table in buckets, of which an update rewrites only those it touches.

`data/version=V/bucket=B` holds the rows of a bucket as version V wrote them and is never changed.
`manifest` has a row (version, bucket) for each of these folders and `layout` the number of buckets.
The manifest's rows of a version are written as one file when its data is whole, so readers see all of
an update or nothing, a lost update leaves only folders that nobody reads, and older versions stay
readable. One writer at a time.
"""

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.session import materialise

BUCKETS = 256
MANIFEST = "version long, bucket int"
#: Names the store keeps for itself.
OWN_COLUMNS = ("version", "bucket")


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(buckets)).cast("int")


def _layout(spark: SparkSession, path: str) -> tuple[int, list[str], T.StructType] | None:
    """Number of buckets, keys and columns of a store; None if there is none yet."""
    try:
        row = spark.read.schema("buckets int, keys array<string>, columns string").parquet(f"{path}/layout").first()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (row["buckets"], row["keys"], T.StructType.fromJson(json.loads(row["columns"]))) if row else None


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, bucket): which buckets each version wrote."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _folders(spark: SparkSession, path: str, version: int | None, buckets: Sequence[int] | None) -> list[str]:
    known = versions(spark, path)
    if version is not None:
        known = known.filter(F.col("version") <= version)
    newest = known.filter("bucket >= 0").groupBy("bucket").agg(F.max("version").alias("version"))
    wanted = None if buckets is None else set(buckets)
    return [
        f"{path}/data/version={r['version']}/bucket={r['bucket']}"
        for r in newest.orderBy("bucket").collect()  # one a bucket
        if wanted is None or r["bucket"] in wanted
    ]


def read_store(
    spark: SparkSession, path: str, version: int | None = None, buckets: Sequence[int] | None = None
) -> DataFrame:
    """The rows of a store as they are now or were after a version, of all buckets or some."""
    layout = _layout(spark, path)
    if layout is None:
        raise ValueError(f"there is no store in {path}")
    folders = _folders(spark, path, version, buckets)
    if not folders:
        return spark.createDataFrame([], layout[2])
    return spark.read.schema(layout[2]).parquet(*folders)


def update_store(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> int:
    """Write a version in which the rows of `df` replace all rows of their keys; its number.

    The first update makes the store, with so many buckets; later ones keep its number. Only the
    buckets of the keys in `df` are read and written. NULL keys are keys like others; rows of
    `df` that share a key all stay. `df` is worked out once.
    """
    spark = df.sparkSession
    taken = [c for c in df.columns if c.lower() in OWN_COLUMNS]
    if taken:
        raise ValueError(f"the store needs these column names for itself: {taken}")
    layout = _layout(spark, path)
    if layout is None:
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        rows = [(buckets, list(keys), columns.json())]
        made = spark.createDataFrame(rows, "buckets int, keys array<string>, columns string")
        spark.createDataFrame([(0, -1)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        made.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    else:
        buckets, kept_keys, columns = layout
        if kept_keys != list(keys) or [f.name for f in columns] != df.columns:
            raise ValueError(f"the store in {path} has keys {kept_keys} and columns {columns.names}")
    new = materialise(df.withColumn("bucket", _bucket(keys, buckets)), "update")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # `buckets` at most
    number = versions(spark, path).agg(F.max("version")).first()[0] + 1
    table = new
    old_folders = _folders(spark, path, None, touched)
    if old_folders:
        old = spark.read.schema(columns).parquet(*old_folders).withColumn("bucket", _bucket(keys, buckets))
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        # the bucket is an equal key on both sides, so rows are spread even where keys are NULL
        same.append(F.col("old.bucket") == F.col("new.bucket"))
        # keys that are alike make small files, by which Spark would broadcast very many of them
        replaced = new.select(*keys, "bucket").distinct().hint("merge")
        table = new.unionByName(old.alias("old").join(replaced.alias("new"), same, "left_anti"))
    # a bucket with very many rows of one key is split; what a lost try of this version left is overwritten
    table.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
    done = spark.createDataFrame([(number, b) for b in touched], MANIFEST)
    done.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return number


def touched_rows(spark: SparkSession, path: str, asked: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The rows of the buckets that hold the keys of `asked`; None while there is no store."""
    layout = _layout(spark, path)
    if layout is None:
        return None
    found = asked.select(_bucket(keys, layout[0]).alias("bucket")).distinct().collect()
    return read_store(spark, path, buckets=[r["bucket"] for r in found])
