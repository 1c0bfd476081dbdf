"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order and posted in their inverted files. A query
reads the files of its own nearest pivots; each common pivot lowers the footrule distance of the two
orders (a pivot missing from one counts as standing after its last). The vectors with the least
distance are ranked again by the exact inner product.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.functions.ranking import top_rows
from letterloom.session import materialise

PIVOTS = 512
ORDER = 64
INDEX_BLOCK = 16_384
QUERY_BLOCK = 1_024
SHARE = 0.08
LEAST = 1_000


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec) of rows whose vector has only finite components, not all 0, and the commonest length."""
    good = vectors.filter(
        F.col(key).isNotNull()
        & F.col(vector).isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    ).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    sizes = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return good.filter(F.size("vec") == (sizes["n"] if sizes else 0))


def choose_pivots(vectors: DataFrame, pivots: int) -> np.ndarray:
    """At most `pivots` different vectors out of a sample of eight times as many by a hash of the id.

    The sample is what the index is fitted on; every vector is indexed. Picked farthest first, so
    that copies and dense spots do not take all places.
    """
    sample = (
        vectors.select("vec_id", "vec")
        .orderBy(F.xxhash64("vec_id"), "vec_id")
        .limit(8 * pivots)
        .collect()
    )
    if not sample:
        return np.zeros((0, 1))
    rows = np.unique(np.array([r["vec"] for r in sample]), axis=0)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    # half farthest first, half as they come, so that pivots also follow the density
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(pivots // 2, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    rest = [i for i in np.random.default_rng(0).permutation(len(unit)) if i not in set(chosen)]
    return unit[chosen + rest[: max(0, pivots - len(chosen))]]


def permutations(vectors: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first; ties to the smaller number."""
    near = -(vectors @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :order].astype(np.int16)


class InvertedFiles:
    """Postings of one block of vectors: per pivot, the vectors that have it and where in their order."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, depth = orders.shape
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.places = by // depth, (by % depth).astype(np.int32)
        self.ends = np.cumsum(np.bincount(flat, minlength=pivots))
        self.n, self.depth = n, depth

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every posted vector to a query's order."""
        gain = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(order):
            part = slice(self.ends[pivot - 1] if pivot else 0, self.ends[pivot])
            # |a - b| instead of (depth - a) + (depth - b)
            gain[self.rows[part]] += 2 * (self.depth - np.maximum(self.places[part], place))
        return self.depth * (self.depth + 1) - gain.astype(np.int64)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    pivots: int = PIVOTS,
    order: int = ORDER,
    share: float = SHARE,
    least: int = LEAST,
) -> DataFrame:
    """The k nearest found rows of `vectors` for each row of `queries`, itself left out: query_id, rank
    (from 1), vec_id, score (inner product in double precision). Ties go to the smaller vec_id.

    Queries and vectors meet in a grid of blocks, each pair of blocks in one task. In each, the
    `share` of the block with the least footrule distance (`least` rows at least, ties to the smaller
    vec_id) is ranked exactly, so what is read grows with the table. Vectors that are null, zero, hold
    null or non-finite components or have another length than most take no part. Of rows that repeat
    an id the one with the smaller vector counts. Extra columns are ignored.
    """
    schema = "query_id long, vec_id long, score double"
    base = materialise(usable(vectors, key, vector).groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    asked = usable(queries, key, vector).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    chosen = choose_pivots(base, pivots)
    depth = min(order, len(chosen))
    n, q = base.count(), asked.count()
    n_blocks, q_blocks = max(1, -(-n // INDEX_BLOCK)), max(1, -(-q // QUERY_BLOCK))

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                orders = permutations(np.stack(pdf["vec"].to_numpy()), chosen, depth)
                yield pdf.assign(pivots=list(orders))

    indexed = base.mapInPandas(posted, "vec_id long, vec array<double>, pivots array<smallint>")
    indexed = indexed.withColumn("ib", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")).withColumn(
        "ib", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    )

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows = rows.sort_values("vec_id", ignore_index=True)
        ids = rows["vec_id"].to_numpy()
        data = np.stack(rows["vec"].to_numpy())
        files = InvertedFiles(np.stack(rows["pivots"].to_numpy()).astype(np.int64), len(chosen))
        wanted = np.stack(queries["vec"].to_numpy())
        orders = permutations(wanted, chosen, depth)
        budget = max(least, int(share * len(ids))) + 1
        out = []
        for who, v, o in zip(queries["vec_id"].to_numpy(), wanted, orders, strict=True):
            distance = files.footrule(o)
            if budget < len(ids):
                # one number for (distance, position), so that ties go to the smaller id
                ranked = distance * len(ids) + np.arange(len(ids))
                near = np.argpartition(ranked, budget)[:budget]
            else:
                near = np.arange(len(ids))
            near = near[ids[near] != who]
            scores = (data[near] * v).sum(axis=1)
            best = np.lexsort((ids[near], -scores))[:k]
            out.append(pd.DataFrame({"query_id": who, "vec_id": ids[near][best], "score": scores[best]}))
        return pd.concat(out, ignore_index=True)

    met = indexed.groupBy("ib", "qb").cogroup(asked.groupBy("ib", "qb")).applyInPandas(meet, schema)
    return top_rows(met, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, rank="rank").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
