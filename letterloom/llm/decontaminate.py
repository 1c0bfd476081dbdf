"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: every piece of a task's texts gets its own sorted postings (term to
positions). Benchmark items are sent to all pieces in blocks of bounded size. A window of an item is
found by its rarest term: that term's positions, less its offset, are the candidate starts, which are
intersected with the offset-adjusted lists of the other terms, next rarest first.
"""

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.llm.common import annotate, free_name, plain_words

WINDOW = 13
BLOCK_WORDS = 200_000

SPAN = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("begin", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)
FOUND = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]
)


class Block(NamedTuple):
    """Windows of some benchmark items: a row of term numbers each, -1 beyond its length."""

    terms: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items: list[str]


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int, words: int) -> Iterator[Block]:
    """The benchmark in blocks of at most `words` words (or one item), fetched one after another.

    Items without id or words have no windows. An item of fewer words than `window` is one window.
    """
    terms: dict[bytes, int] = {}
    rows: list[list[int]] = []
    items: list[str] = []
    held = 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        found = plain_words((row[1] or "").encode())
        if row[0] is None or not found:
            continue
        if held and held + len(found) > words:
            yield _block(terms, rows, items, window)
            terms, rows, items, held = {}, [], [], 0
        numbers = [terms.setdefault(w, len(terms)) for w in found]
        for start in range(max(1, len(numbers) - window + 1)):
            rows.append(numbers[start : start + window])
            items.append(row[0])
        held += len(found)
    yield _block(terms, rows, items, window)


def _block(terms: dict[bytes, int], rows: list[list[int]], items: list[str], window: int) -> Block:
    grid = np.full((len(rows), window), -1, np.int32)
    for i, row in enumerate(rows):
        grid[i, : len(row)] = row
    return Block(terms, grid, np.array([len(r) for r in rows], np.int32), items)


class Postings:
    """Positional postings of a piece of texts, for the terms of a block."""

    def __init__(self, texts: list[bytes], terms: dict[bytes, int]):
        self.n_words = []
        parts = []
        for t in texts:
            words = plain_words(t)
            self.n_words.append(len(words))
            parts.append(np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words)))
            parts.append(np.full(1, -1, np.int32))  # keeps windows within their text
        self.ids = np.concatenate(parts)
        self.starts = np.cumsum([0, *(n + 1 for n in self.n_words)])[:-1]
        places = np.flatnonzero(self.ids >= 0)
        order = np.argsort(self.ids[places], kind="stable")
        self.positions = places[order]
        self.sizes = np.bincount(self.ids[places], minlength=len(terms) + 1)
        self.ends = np.cumsum(self.sizes)

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] - self.sizes[term] : self.ends[term]]

    def starts_of(self, row: np.ndarray, slop: int) -> np.ndarray:
        """Where the terms of `row` stand, each within `slop` places of its own offset."""
        order = np.argsort(self.sizes[row], kind="stable")
        at = self.of(row[order[0]]) - order[0]
        for k in order[1:]:
            other = self.of(row[k]) - k
            near = np.searchsorted(other, at - slop)
            inside = near < len(other)
            at = at[inside][other[near[inside]] <= at[inside] + slop]
            if not len(at):
                break
        return at


def _finder(block: Block, slop: int):
    def find(texts: list[bytes]):
        postings = Postings(texts, block.terms)
        spans: list[list[tuple]] = [[] for _ in texts]
        if len(block.items):
            # windows with a term that the piece lacks are out at once
            sizes = np.where(block.windows < 0, 1, postings.sizes[block.windows])
            for w in np.flatnonzero(sizes.min(axis=1) > 0):
                n = int(block.lengths[w])
                at = postings.starts_of(block.windows[w, :n], slop)
                if not len(at):
                    continue
                doc = np.searchsorted(postings.starts, np.maximum(at, 0), side="right") - 1
                for d, a in zip(doc.tolist(), (at - postings.starts[doc]).tolist(), strict=True):
                    begin, end = max(a, 0), min(a + n, postings.n_words[d])
                    if end > begin and (slop or (a >= 0 and a + n <= postings.n_words[d])):
                        spans[d].append((block.items[w], begin, end))
        return postings.n_words, [_merged(s) for s in spans]

    return lambda: find


def _merged(spans: list[tuple]) -> list[dict]:
    """Overlapping spans of an item as one."""
    out: list[dict] = []
    for item, begin, end in sorted(spans):
        if out and out[-1]["item_id"] == item and begin <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"item_id": item, "begin": begin, "end": end})
    return out


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
    name: str = "found",
) -> DataFrame:
    """`docs` with a struct column: n_words, and spans of words (item_id, begin, end) that match.

    A span covers occurring windows of `window` consecutive item words (an item of fewer words is
    one window); overlapping ones of an item are one span. `slop` 0 asks for the exact phrase; a
    larger one lets each word stand up to so many places off (proximity).

    Nulls and empty texts have no words and no spans; items without id or words match nothing;
    repeated items and rows are all reported. With an empty benchmark all spans are empty. Extra
    columns are kept; `name` gets underscores if it is taken. A benchmark over `block_words` words
    is searched in several blocks, one pass each, and their spans are joined in the row.
    """
    out, name = docs, free_name(docs, name)
    for number, block in enumerate(blocks_of(benchmark, item, item_text, window, block_words)):
        if not number:
            out = annotate(out, text, FOUND, _finder(block, slop), name)
            continue
        more = free_name(out, f"__block{number}")
        out = annotate(out, text, FOUND, _finder(block, slop), more)
        both = F.struct(
            F.col(f"{name}.n_words").alias("n_words"),
            F.concat(f"{name}.spans", f"{more}.spans").alias("spans"),
        )
        out = out.withColumn(name, both).drop(more)
    return out


def contamination(name: str = "found") -> Column:
    """Of a row of `find_passages`: n_words, n_hit, n_items, items_sha256 and contaminated (hit words
    are a twentieth of all or more), as a struct."""
    spans = F.col(f"{name}.spans")
    n_words = F.col(f"{name}.n_words")
    hit = F.size(
        F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["begin"], s["end"] - 1))))
    ).cast("long")
    items = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["item_id"])))
    return F.struct(
        n_words.alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= n_words)).alias("contaminated"),
    )
