"""Parquet tables, spread over the cores where they are small enough to sit in a few scan tasks."""

from pyspark.sql import DataFrame, SparkSession

SMALL_SPLITS = 64  # 8 GB at the usual split size


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small input over all cores, before work that is heavy per row.

    A small file may hold a single row group, which a single task would read and work on. Inputs of
    more than SMALL_SPLITS splits are left as they are, so a large table is never shuffled for this.
    """
    if df.rdd.getNumPartitions() > SMALL_SPLITS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
