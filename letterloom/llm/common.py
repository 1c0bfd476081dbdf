"""Helpers for work on whole texts inside tasks: bounded pieces of Arrow batches, words, hashes."""

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

PIECE_BYTES = 2 << 20

#: A-Z to a-z, other ASCII that is neither letter nor digit to a space; bytes of other characters stay.
LETTERS_AND_DIGITS = bytes(
    (b | 0x20) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and any other characters above ASCII, lower-cased in ASCII."""
    return text.translate(LETTERS_AND_DIGITS).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, lower-cased in ASCII."""
    return text.lower().split()


def pieces(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most `limit` bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            floor = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, floor + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores added until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def annotate(
    docs: DataFrame,
    text: str,
    fields: T.StructType,
    make: Callable[[], Callable[[list[bytes]], Sequence[Sequence[Any]]]],
    name: str,
) -> DataFrame:
    """`docs` with one more struct column, made from the text of each row in place (no shuffle).

    `make()` runs once a task and gives a function from a piece's texts to one list for each field.
    """
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in pieces(batches, text):
            columns = work(texts(piece, text))
            found = pa.StructArray.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names
            )
            yield pa.RecordBatch.from_arrays([*piece.columns, found], names=[*piece.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, fields)]))


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo `divisor`; a null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_counts(
    docs: DataFrame,
    text: str,
    split: Callable[[bytes], list[bytes]],
    keep: Callable[[bytes], bool] | None = None,
    piece_bytes: int = 16 << 20,
) -> DataFrame:
    """(word binary, n long): how often each word stands in all texts, summed per piece before the shuffle."""
    from collections import Counter

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            words = list(filter(keep, tally)) if keep else list(tally)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([tally[w] for w in words], pa.int64())],
                names=["word", "n"],
            )

        for piece in pieces(batches, text):
            for t in texts(piece, text):
                tally.update(split(t))
                held += len(t)
            if held >= piece_bytes:
                yield out()
                tally.clear()
                held = 0
        yield out()

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
