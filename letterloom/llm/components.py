"""Connected components of a table of links, in rounds of joins and groupings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node it reaches.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then all its
    smaller ones, to the smallest node it sees, until nothing changes. Each round is written to the
    shared folder, and the number of rounds grows with the logarithm of the longest path.
    """
    edges = materialise(_both(links.select("a", "b").filter(F.col("a") != F.col("b"))), "edges")
    while True:
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        small = _star(large, False)
        after = materialise(small, "edges")
        if _sum(after) == _sum(edges):
            break
        edges = after
    roots = after.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _both(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger node a to its smaller b."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours of each node a linked to the smallest of a and its neighbours.

    large: only the neighbours above a; otherwise a itself and its neighbours, all of which are below.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a")
    if large:
        moved = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        kept = least.select("a", F.col("m").alias("b"))
        moved = near.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(kept)
    return _both(moved.filter(F.col("a") != F.col("b")))


def _sum(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary")))).first()
    )
