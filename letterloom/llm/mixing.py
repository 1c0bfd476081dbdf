"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import free_name
from letterloom.session import materialise

#: Largest mean that one draw may have; larger means are sums of independent draws.
DRAW_MEAN = 8.0
#: Terms of the distribution function kept for one draw. Above 60 terms the tail of a mean of at
#: most 8 is under 2**-53, which no 52-bit uniform number reaches.
DRAW_TERMS = 60


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def source_rates(
    docs: DataFrame, text: str, source: str, alpha: float, epochs: float, weights: DataFrame | None = None
) -> DataFrame:
    """Per source: its mass, its target share and the mean repetition rate that reaches it.

    Mass is code points plus one a document, so that sources of empty texts have a rate too. Without
    `weights` (source, weight) the target weight is mass ** alpha: 1 keeps the sources' shares, 0
    makes them equal. A source that `weights` lacks, or gives null or less than 0, gets the rate 0.
    The targets together hold `epochs` times the input.
    """
    mass = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1).alias("mass")
    )
    if weights is None:
        weighted = mass.withColumn("weight", F.pow(F.col("mass").cast("double"), F.lit(float(alpha))))
    else:
        given = weights.groupBy(F.col("source").alias("__source")).agg(F.sum("weight").alias("weight"))
        weighted = mass.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").withColumn(
            "weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
        )
    totals = weighted.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight")).first()
    all_mass, all_weight = totals["all_mass"] or 0, totals["all_weight"] or 1.0
    share = F.col("weight") / F.lit(float(all_weight))
    rate = F.lit(float(epochs)) * share * F.lit(float(all_mass)) / F.col("mass")
    draws = F.greatest(F.ceil(rate / F.lit(DRAW_MEAN)), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("draws")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(DRAW_TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("f")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            F.concat(a["f"], F.array(F.element_at(a["f"], -1) + a["p"] * mean / k)).alias("f"),
        ),
    )["f"]
    return (
        weighted.select("source", "mass", share.alias("share"), rate.alias("rate"), draws.alias("draws"))
        .withColumn("cdf", terms)
        .select("source", "mass", "share", "rate", "draws", "cdf")
    )


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    alpha: float = 0.7,
    epochs: float = 1.0,
    seed: int = 1,
    weights: DataFrame | None = None,
    copy: str = "copy",
) -> DataFrame:
    """Documents repeated so that sources meet their target weights, in a global random order.

    Each row draws its count from the Poisson distribution of its source's rate: a uniform number
    hashed from seed and key is inverted through the distribution function. Rates over DRAW_MEAN
    are the sum of several independent draws, so any rate is exact. The row is exploded to that many
    rows (`copy` counts from 1; the name gets underscores if it is taken), dealt to the shuffle
    partitions by a hash of row and copy and ordered by hash in each, which is a random permutation
    that comes out the same on every run.

    Nulls: a null key is drawn by the text's hash; a null text counts as empty; null is a source of
    its own. Rows that repeat with the same key get the same count. An empty table gives an empty
    one. Extra columns are kept.
    """
    copy = free_name(docs, copy)
    # written first: its size decides whether Spark broadcasts it or joins by shuffle and splits skew
    rates = materialise(source_rates(docs, text, source, alpha, epochs, weights), "rates").select(
        F.col("source").alias("__source"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf")
    )
    unit = F.coalesce(
        F.col(key).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit(""))))
    )
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("__draws")),
        F.lit(0),
        lambda n, i: n
        + F.size(
            F.filter("__cdf", lambda c: c <= uniform(F.lit(str(seed)), i.cast("string"), F.col("__unit")))
        ),
    )
    drawn = (
        docs.withColumn("__unit", unit)
        .join(rates, F.col(source).eqNullSafe(F.col("__source")))
        .withColumn("__n", count)
        .filter(F.col("__n") > 0)
        .drop("__source", "__draws", "__cdf")
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("__n"))))
    )
    order = F.xxhash64(F.lit(seed), F.col("__unit"), F.col(copy), F.xxhash64(F.col(text)))
    return (
        drawn.withColumn("__order", order)
        .repartition(F.col("__order"))
        .sortWithinPartitions("__order")
        .select(*docs.columns, copy)
    )
