"""Whitening of vectors over distributed block matrices (MLlib's BlockMatrix).

Rows get dense numbers and are cut into blocks of bounded size. The blocks, centred, times their
transpose give the scatter matrix; the sums over blocks are split along the rows, so no task reads
more than a few blocks. Only the scatter matrix, as wide as a vector, comes to the driver, for its
eigenvectors. The blocks times the whitening matrix are the projected rows.
"""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterloom.session import materialise

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
#: Entries are held within these bounds, so that every scaled one is an exact long.
LARGEST = 2.0**42
#: Entries of a block: at least, so that it is worth a message, and at most, so that it fits in a task.
BLOCK_ENTRIES = (1 << 16, 1 << 22)
#: Blocks wanted of a large table; their places are known to the driver.
BLOCKS = 1 << 12
#: Blocks of each side that one task multiplies.
BLOCKS_A_TASK = 8
#: Components whose share of the largest eigenvalue is smaller have no variance in double precision.
RANK_SHARE = 1e-11

LOW_BITS = 26


class Fit(NamedTuple):
    """What is known of all vectors: their number, width and the exact sum of each dimension."""

    n: int
    width: int
    sums: list[int]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec, part, pos) of rows whose vector is neither null nor holds null or non-finite entries."""
    good = vectors.filter(
        F.col(vector).isNotNull()
        & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    part = F.spark_partition_id()
    pos = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    return good.select(
        F.col(key).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("vec"),
        part.alias("part"),
        pos.alias("pos"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Written rows of `usable` with a dense `index` from 0, by the sizes of their parts."""
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return rows.join(first, "part").select((F.col("first") + F.col("pos")).alias("index"), "vec_id", "vec")


def scaled(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """floor(1024 * c) + 100000 of all entries; a vector shorter than `width` has zeros after its end."""
    column = batch.column("vec")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((batch.num_rows, width))
    if (lengths == width).all():
        out[:] = values.reshape(batch.num_rows, width)
    else:
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return np.floor(SCALE * np.clip(out, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def fit(rows: DataFrame) -> Fit:
    """Over all written rows; sums are exact, as their upper and lower bits are summed apart."""
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if not n or not width:
        return Fit(n, width, [])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch, width)
            low = x & ((1 << LOW_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array((x >> LOW_BITS).sum(0)), pa.array(low.sum(0))],
                names=["dim", "high", "low"],
            )

    sums = rows.select("vec").mapInArrow(summed, "dim int, high long, low long").groupBy("dim")
    found = sums.agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return Fit(n, width, [(r["high"] << LOW_BITS) + r["low"] for r in sorted(found, key=lambda r: r["dim"])])


def _gaps(x: np.ndarray, fitted: Fit) -> np.ndarray:
    """n * x - S, exact: as 64-bit numbers where they fit, else as Python's."""
    if max(fitted.n * int(np.abs(x).max(initial=0)), *map(abs, fitted.sums)) < 1 << 61:
        return fitted.n * x - np.array(fitted.sums, np.int64)
    return fitted.n * x.astype(object) - np.array(fitted.sums, object)


def _deviations(gaps: np.ndarray) -> list[int | None]:
    """Sums of squares along the rows, exact; None beyond a long."""
    largest = int(np.abs(gaps).max(initial=0))
    if gaps.dtype != object and largest * largest * gaps.shape[1] < 1 << 63:
        return (gaps * gaps).sum(1).tolist()
    exact = (gaps.astype(object) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def centred(rows: DataFrame, fitted: Fit) -> DataFrame:
    """(index, vec_id, deviation, vector): each row less the mean, from exact whole numbers."""

    def centre(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = _gaps(scaled(batch, fitted.width), fitted)
            vector = (gaps / fitted.n).astype(float)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("index"),
                    batch.column("vec_id"),
                    pa.array(_deviations(gaps), pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(vector) + 1, dtype=np.int32) * fitted.width), pa.array(vector.ravel())
                    ),
                ],
                names=["index", "vec_id", "deviation", "vector"],
            )

    return rows.mapInArrow(centre, "index long, vec_id long, deviation long, vector array<double>")


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """(index, vector) as blocks of whole rows."""
    least, most = (max(1, size // width) for size in BLOCK_ENTRIES)
    high = min(most, max(least, -(-n // BLOCKS)))
    dense = rows.select("index", array_to_vector("vector").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(dense, "vector"), n, width)
    return matrix.toBlockMatrix(high, width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The matrix, transposed, times itself; the rows are split into parts whose products are added."""
    parts = max(1, -(-matrix.numRowBlocks // BLOCKS_A_TASK))
    across = matrix.transpose()._java_matrix_wrapper
    # the number of splits is an argument that the Python method lacks; without it one task reads all blocks
    product = across.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def whitening(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and the eigenvectors over their square roots, in columns.

    The largest entry of an eigenvector is positive. Components without variance are left out.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    real = values > RANK_SHARE * max(values[0], 0)
    values, vectors = values[real], vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * signs / np.sqrt(values)


def project(matrix: BlockMatrix, onto: np.ndarray) -> DataFrame:
    """(index, projected): the rows of the blocks times `onto`, a small matrix."""
    context = matrix.blocks.context
    width, k = onto.shape
    small = BlockMatrix(context.parallelize([((0, 0), Matrices.dense(width, k, onto.ravel("F")))], 1), width, k)
    product = matrix.multiply(small)
    high = matrix.rowsPerBlock
    packed = product.blocks.map(lambda b: (int(b[0][0]), bytearray(b[1].toArray().astype("<f8").tobytes())))

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                values = np.frombuffer(data, "<f8")
                rows = len(values) // k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block * high + np.arange(rows, dtype=np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), pa.array(values)),
                    ],
                    names=["index", "projected"],
                )

    blocks = packed.toDF("block int, data binary")
    return blocks.mapInArrow(unpack, "index long, projected array<double>")


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the projected rows' covariance (divisor n) less the identity."""
    w = [F.get("projected", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = projected.agg(*[F.sum(c) for c in w], *[F.sum(w[i] * w[j]) for i, j in pairs]).first()
    means, products = [v / n for v in found[:k]], found[k:]
    return max(
        abs(p / n - means[i] * means[j] - (i == j)) for (i, j), p in zip(pairs, products, strict=True)
    )


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each usable vector on each of the first `components` principal components, with unit variance:
    vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become whole numbers, x = floor(1024 * c) + 100000; the covariance of all usable vectors,
    with divisor n, gives the components. `deviation` is the exact sum of (n * x - S) ** 2, null if it
    is beyond a long. `explained` is a component's share of the variance and `identity_error` the
    largest absolute entry of the whitened rows' covariance less the identity.

    Vectors that are null or hold null or non-finite entries are dropped. A vector shorter than the
    longest has zeros after its end; entries beyond 2 ** 42 count as that. Repeated rows and ids, null
    ids too, are rows of their own. A component whose eigenvalue is below 1e-11 of the largest has no
    rows, so equal vectors, a single one or an empty table give none. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows = materialise(usable(vectors, key, vector), "vectors")
    fitted = fit(rows)
    if not fitted.sums:
        return spark.createDataFrame([], schema)
    middle = centred(numbered(rows), fitted)
    blocks = block_matrix(middle, fitted.n, fitted.width)
    covariance = scatter(blocks) / fitted.n
    values, onto = whitening(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    projected = materialise(project(blocks, onto), "projected")
    error = identity_error(projected, fitted.n, len(values))
    trace = float(np.trace(covariance))
    shares = F.array(*[F.lit(float(v) / trace) for v in values])
    parts = F.transform(
        F.arrays_zip(F.col("projected").alias("whitened"), shares.alias("explained")),
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("component"), p["whitened"].alias("whitened"), p["explained"].alias("explained")
        ),
    )
    return (
        middle.select("index", "vec_id", "deviation")
        .join(projected, "index")
        .select("vec_id", "deviation", F.inline(parts))
        .select(
            "vec_id",
            "component",
            F.lit(fitted.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            "explained",
            F.lit(error).alias("identity_error"),
        )
    )
