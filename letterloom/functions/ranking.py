"""Grouped building blocks that stay even when one group holds a large share of all rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterloom.session import materialise


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The first `k` rows of every group, by a total order.

    `row_number() <= k` lets Spark put a WindowGroupLimit before the shuffle, so every map task sends
    at most `k` rows of a group however large the group is.
    """
    name = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def running_totals(df: DataFrame, keys: Sequence[str], order: str, value: str, total: str) -> DataFrame:
    """Add `total`: the sum of `value` over the earlier rows of the group, in `order`.

    `order` is unique in its group and of any type with an order; give narrow rows, and join wide
    ones to the result. The rows are cut into ranges of (keys, order) of about equal numbers, by a
    sample, and written with the number of their range. So whatever values `order` has, and whatever
    share of the rows a group has, no task sums more than a range; the sums of the ranges of a
    group, one row each, are then summed along it.
    """
    ranged = df.repartitionByRange(*keys, order).withColumn("__range", F.spark_partition_id())
    cut = materialise(ranged, "ranges")
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    sums = cut.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(along), F.lit(0))).drop("__sum")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] + [F.col("l.__range") == F.col("o.__range")]
    return local.alias("l").join(offsets.alias("o"), same).select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("__offset") + F.col("__local")).alias(total)
    )


def most_common(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """The value most rows of a group show; ties go to the smallest value."""
    counted = df.groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("support")
    )
    return top_rows(counted, keys, [F.col("support").desc(), F.col(value).asc()], 1)
