"""Ranked lexical search over posting lists that are blocked by document similarity.

Texts are cut into shards of bounded size, each with the counts of its own terms. For a block of
queries every shard gets a list of postings for each of their terms. The documents of a list are
clustered around some of its own by the direction of their weights, and each cluster is a block with
a summary: the largest weight in it of every term that some query has together with the list's. The
summary times the query bounds every score in the block, so a block is read only if its bound can
reach the k-th best score known; a list is read only if documents without the terms of the lists
before it still can. Results are exact.

Scores are whole numbers (see `weights`). A first part of the shards is searched on its own; the k-th
scores found there are where the search of all others starts from.
"""

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.functions.ranking import top_rows
from letterloom.llm.common import LETTERS_AND_DIGITS, WordHashes, pieces, plain_words, texts
from letterloom.session import materialise

#: Text of a shard, about.
SHARD_BYTES = 8 << 20
#: Words of a block of queries, at most (or one query).
BLOCK_WORDS = 200_000
#: Documents of a block of postings, on average. A list of no more is one block.
BLOCK = 64
#: Terms of more than a part of a shard's documents share the blocks of all its documents.
COMMON = 4
DIRECTIONS = 16
#: One shard in so many is searched first.
FIRST = 16
#: Cells of summaries that are worked out at once.
CELLS = 1 << 21
#: Terms of a query from which on summaries leave out nothing for it.
LONG_QUERY = 1000
#: Blocks of a list that are read before the bounds of the others are compared again.
BEST_BLOCKS = 4
CHUNK = 1 << 20
NO_ID = (1 << 63) - 1

FORWARD = (
    "shard long, ids array<long>, sizes array<long>, terms array<long>, ends array<int>, "
    "cols array<int>, counts array<int>"
)
BLOCKED = (
    "shard long, ids array<long>, ends array<int>, cols array<int>, parts array<int>, "
    "list_terms array<int>, list_largest array<int>, list_ends array<int>, common array<int>, "
    "common_largest array<int>, docs array<int>, block_ends array<int>, sum_ends array<int>, "
    "sum_cols array<int>, sum_parts array<int>"
)


class Queries(NamedTuple):
    """Some queries: their numbers, the hashes of all their terms in order, and of each query its
    terms (places in `terms`) and how often it has them."""

    numbers: list[int]
    terms: np.ndarray
    cols: list[np.ndarray]
    counts: list[np.ndarray]


class Statistics(NamedTuple):
    """Documents with terms, all their terms, and the weight of each query term."""

    n: int
    length: int
    weights: np.ndarray


def word_hashes(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words of a text, read in chunks that end between words."""
    if len(text) <= CHUNK:
        return hashes.of(plain_words(text))
    plain, out, start = text.translate(LETTERS_AND_DIGITS), [], 0
    while start < len(plain):
        end = plain.find(b" ", min(start + CHUNK, len(plain)))
        end = len(plain) if end < 0 else end
        out.append(hashes.of(plain[start:end].split()))
        start = end
    return np.concatenate(out)


def _lists(schema: str, rows: list[list]) -> pa.RecordBatch:
    """Rows of a shard number and arrays, typed as in `schema`."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "long": pa.int64()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names
    )


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch as numbers and numpy arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            cell = column[i]
            row[name] = cell.values.to_numpy() if pa.types.is_list(cell.type) else cell.as_py()
        yield row


def index_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of all texts, written: per document its terms, by 64-bit hash, and their counts.

    A document without terms is left out. A null key stays null; repeated rows are documents of their own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        number = TaskContext.get().partitionId() << 33
        ids: list[int] = []
        found: list[np.ndarray] = []
        held = 0
        for piece in pieces(batches, "text"):
            for i, t in zip(piece.column("id").to_pylist(), texts(piece, "text"), strict=True):
                words = word_hashes(t, hashes)
                if len(words):
                    ids.append(NO_ID if i is None else i)
                    found.append(words)
                    held += len(t)
                if held >= shard_bytes:
                    yield _forward(number, ids, found)
                    number, ids, found, held = number + 1, [], [], 0
        if ids:
            yield _forward(number, ids, found)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, FORWARD), "shards", wide=True)


def _forward(number: int, ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(f) for f in found])
    terms, place = np.unique(np.concatenate(found), return_inverse=True)
    code, counts = np.unique(np.repeat(np.arange(len(ids)), sizes) * len(terms) + place, return_counts=True)
    ends = np.cumsum(np.bincount(code // len(terms), minlength=len(ids)))
    return _lists(FORWARD, [[number, ids, sizes, terms.view(np.int64), ends, code % len(terms), counts]])


def query_blocks(queries: DataFrame, words: int) -> Iterator[Queries]:
    """Numbered texts in blocks of at most `words` words (or one text), fetched one after another."""
    hashes = WordHashes()
    numbers: list[int] = []
    counts: list[Counter] = []
    held = 0

    def block() -> Queries:
        terms = np.unique(np.array([h for c in counts for h in c], np.uint64))
        cols = [np.searchsorted(terms, np.array(sorted(c), np.uint64)) for c in counts]
        return Queries(numbers, terms, cols, [np.array([c[h] for h in sorted(c)], np.int64) for c in counts])

    for row in queries.select("number", "text").toLocalIterator():
        found = word_hashes((row["text"] or "").encode(), hashes)
        if not len(found):
            continue
        if held and held + len(found) > words:
            yield block()
            numbers, counts, held = [], [], 0
        numbers.append(row["number"])
        counts.append(Counter(found.tolist()))
        held += len(found)
    if numbers:
        yield block()


def statistics(shards: DataFrame, terms: np.ndarray) -> Statistics:
    """Over all shards. A term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1)))."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = row["terms"].view(np.uint64)
                at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                hit = terms[at] == own
                n_docs = np.bincount(row["cols"], minlength=len(own))[hit]
                col = np.append(at[hit], [-1, -2])
                n = np.append(n_docs, [len(row["sizes"]), row["sizes"].sum()])
                yield pa.RecordBatch.from_arrays([pa.array(col, pa.int32()), pa.array(n, pa.int64())], names=["col", "n"])

    counted = shards.select("sizes", "terms", "cols").mapInArrow(run, "col int, n long")
    found = {r["col"]: r["n"] for r in counted.groupBy("col").agg(F.sum("n").alias("n")).collect()}
    n = found.get(-1, 0)
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * found[c] + 1))) if c in found else 0 for c in range(len(terms))]
    return Statistics(n, found.get(-2, 0), np.array(weights, np.int64))


def parts(counts: np.ndarray, sizes: np.ndarray, stats: Statistics) -> np.ndarray:
    """What a term's count in a document makes of its weight: (10**9 * tf) div (1000 * tf + 8 * m),
    with m = 25 + (75 * n * N) div L for a document of n terms."""
    if 75 * int(sizes.max(initial=0)) * stats.n < 1 << 62:
        m = 25 + 75 * sizes * stats.n // stats.length
    else:
        m = np.array([25 + 75 * int(s) * stats.n // stats.length for s in sizes], np.int64)
    counts = counts.astype(np.int64)
    return 10**9 * counts // (1000 * counts + 8 * m)


def _clusters(docs: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The cluster of each document of a list: the nearest of every BLOCK-th of its documents."""
    heads = directions[docs[::BLOCK]]
    near = [(directions[docs[i : i + 4096]] @ heads.T).argmax(axis=1) for i in range(0, len(docs), 4096)]
    return np.unique(np.concatenate(near), return_inverse=True)[1]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many as its size says."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def block_shard(
    row: dict, queries: np.ndarray, together: list[np.ndarray | None], stats: Statistics, axes: np.ndarray
) -> list | None:
    """The postings of a shard for the query terms, in blocks with summaries; None without any."""
    own = row["terms"].view(np.uint64)
    at = np.minimum(np.searchsorted(queries, own), len(queries) - 1)
    col_of = np.where(queries[at] == own, at, -1)
    doc = np.repeat(np.arange(len(row["ids"])), np.diff(row["ends"], prepend=0))
    cols = col_of[row["cols"]]
    keep = cols >= 0
    keep[keep] = stats.weights[cols[keep]] > 0
    doc, cols = doc[keep], cols[keep]
    part = parts(row["counts"][keep], row["sizes"][doc], stats)
    some, doc = np.unique(doc, return_inverse=True)
    if not len(some):
        return None
    ends = np.cumsum(np.bincount(doc, minlength=len(some)))

    directions = np.zeros((len(some), DIRECTIONS), np.float32)
    weight = (part * stats.weights[cols]).astype(np.float32)
    for k in range(DIRECTIONS):
        directions[:, k] = np.bincount(doc, weights=weight * axes[cols, k], minlength=len(some))
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-9)

    by_col = np.argsort(cols, kind="stable")
    terms, first = np.unique(cols[by_col], return_index=True)
    largest = np.maximum.reduceat(part[by_col], first)
    lists = np.split(doc[by_col], first[1:])
    common = np.array([len(d) * COMMON > len(some) and len(d) > BLOCK for d in lists])
    lists = [d for d, c in zip(lists, common, strict=True) if not c]
    list_terms, list_largest = terms[~common], largest[~common]
    if common.any():
        lists.append(np.arange(len(some)))
        list_terms, list_largest = np.append(list_terms, -1), np.append(list_largest, 0)

    docs, block_sizes = [], []
    for d in lists:
        cluster = _clusters(d, directions) if len(d) > BLOCK else np.zeros(len(d), np.int64)
        docs.append(d[np.argsort(cluster, kind="stable")])
        block_sizes.append(np.bincount(cluster))
    n_blocks = np.array([len(s) for s in block_sizes])
    docs, block_sizes = np.concatenate(docs), np.concatenate(block_sizes)
    asked = [together[t] for t in list_terms if t >= 0]
    if common.any():
        asked.append(_union([together[t] for t in terms[common]]))
    local = np.full(len(queries), -1)
    local[terms] = np.arange(len(terms))
    asked = [None if a is None else local[a][local[a] >= 0] for a in asked]
    summary = _summaries(
        docs, block_sizes, np.repeat(np.arange(len(lists)), n_blocks), asked, ends, np.searchsorted(terms, cols), part, len(terms)
    )
    return [row["shard"], row["ids"][some], ends, cols, part, list_terms, list_largest, np.cumsum(n_blocks),
            terms[common], largest[common], docs, np.cumsum(block_sizes), summary[0], terms[summary[1]], summary[2]]


def _summaries(
    docs: np.ndarray,
    sizes: np.ndarray,
    lists: np.ndarray,
    asked: list[np.ndarray | None],
    ends: np.ndarray,
    cols: np.ndarray,
    values: np.ndarray,
    width: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block its columns and the largest value of each over its documents, for the columns
    that are asked together with its list (None: all)."""
    held = np.diff(ends, prepend=0)
    block_ends = np.cumsum(sizes)
    step = max(1, CELLS // width)
    counts, found_cols, found = [], [], []
    for at in range(0, len(sizes), step):
        n = sizes[at : at + step]
        some = docs[block_ends[at] - sizes[at] : block_ends[at + len(n) - 1]]
        own = lists[at : at + step]
        wanted = np.zeros((own[-1] - own[0] + 1, width), bool)
        for i, row in enumerate(wanted, own[0]):
            row[slice(None) if asked[i] is None else asked[i]] = True
        cells = np.zeros(len(n) * width, np.int64)
        entries = _ranges((ends - held)[some], held[some])
        blocks = np.repeat(np.repeat(np.arange(len(n)), n), held[some])
        np.maximum.at(cells, blocks * width + cols[entries], values[entries])
        hit = np.flatnonzero(cells * wanted[own - own[0]].ravel())
        counts.append(np.bincount(hit // width, minlength=len(n)))
        found_cols.append(hit % width)
        found.append(cells[hit])
    return np.cumsum(np.concatenate(counts)), np.concatenate(found_cols), np.concatenate(found)


def _union(sets: list[np.ndarray | None]) -> np.ndarray | None:
    return None if any(s is None for s in sets) else np.unique(np.concatenate(sets))


def asked_together(queries: Queries) -> list[np.ndarray | None]:
    """For each term all terms of the queries that have it; None (any) if one of these is a long query."""
    of_term: list[list] = [[] for _ in queries.terms]
    for cols in queries.cols:
        for c in cols.tolist():
            of_term[c].append(cols if len(cols) <= LONG_QUERY else None)
    return [_union(sets) for sets in of_term]


def blocked_index(shards: DataFrame, queries: Queries, stats: Statistics) -> DataFrame:
    """The blocked postings of all shards for the terms of some queries, written."""
    terms = queries.terms
    axes = np.random.default_rng(0).choice(np.array([-1, 1], np.float32), (len(terms), DIRECTIONS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = asked_together(queries)
        for batch in batches:
            for row in _rows(batch):
                made = block_shard(row, terms, together, stats, axes)
                if made:
                    yield _lists(BLOCKED, [made])

    return materialise(shards.mapInArrow(run, BLOCKED), "blocks", wide=True)


class Shard:
    """A shard's blocked postings, ready to be searched."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.row, self.weights = row, weights
        self.places = {int(t): i for i, t in enumerate(row["list_terms"])}
        self.common = {int(t): int(v) for t, v in zip(row["common"], row["common_largest"], strict=True)}
        self.begins = row["ends"] - np.diff(row["ends"], prepend=0)
        self.read = 0

    def scores(self, docs: np.ndarray, factor: np.ndarray) -> np.ndarray:
        sizes = self.row["ends"][docs] - self.begins[docs]
        at = _ranges(self.begins[docs], sizes)
        self.read += len(docs)
        return np.add.reduceat(factor[self.row["cols"][at]] * self.row["parts"][at], np.cumsum(sizes) - sizes)

    def search(self, cols: np.ndarray, counts: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents with a score of at least `least`, best first."""
        row, weights = self.row, self.weights
        factor = np.zeros(len(weights), np.int64)
        factor[cols] = counts * weights[cols]
        lists = [(int(factor[c]) * int(row["list_largest"][self.places[c]]), self.places[c]) for c in cols.tolist() if c in self.places]
        lists.sort(reverse=True)
        shared = sum(int(factor[c]) * self.common[c] for c in cols.tolist() if c in self.common)
        if shared:
            lists.append((shared, self.places[-1]))
        left = sum(bound for bound, _ in lists)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(len(row["ids"]), bool)
        least = max(least, 1)
        for bound, place in lists:
            # documents that are in none of the lists before have at most what is left
            if left < least:
                break
            first = int(row["list_ends"][place - 1]) if place else 0
            blocks = np.arange(first, row["list_ends"][place])
            bounds = self.bounds(blocks, factor)
            left -= bound
            order = np.argsort(-bounds, kind="stable")
            for turn in (order[:BEST_BLOCKS], order[BEST_BLOCKS:]):
                use = blocks[turn][bounds[turn] >= least]
                if not len(use):
                    break
                starts = np.where(use > 0, row["block_ends"][use - 1], 0)
                docs = row["docs"][_ranges(starts, row["block_ends"][use] - starts)]
                docs = docs[~seen[docs]]
                if not len(docs):
                    continue
                seen[docs] = True
                new = self.scores(docs, factor)
                good = new >= least
                ids, scores = np.append(ids, row["ids"][docs[good]]), np.append(scores, new[good])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(scores) == k:
                    least = max(least, int(scores[-1]))
        return ids, scores

    def bounds(self, blocks: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """What no document of these blocks, all of one list, can be above."""
        row = self.row
        begin = int(row["sum_ends"][blocks[0] - 1]) if blocks[0] else 0
        ends = row["sum_ends"][blocks]
        part = slice(begin, int(ends[-1]))
        return np.add.reduceat(factor[row["sum_cols"][part]] * row["sum_parts"][part], np.append(begin, ends[:-1]) - begin)


def search_index(index: DataFrame, queries: Queries, stats: Statistics, k: int, least: dict[int, int]) -> DataFrame:
    """(number, id, score): at most k documents a query and shard; none below the query's `least`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row, stats.weights)
                found = [
                    (number, *shard.search(cols, counts, k, least.get(number, 1)))
                    for number, cols, counts in zip(queries.numbers, queries.cols, queries.counts, strict=True)
                ]
                sizes = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(queries.numbers, np.int64), sizes)),
                        pa.array(np.concatenate([ids for _, ids, _ in found])),
                        pa.array(np.concatenate([scores for _, _, scores in found])),
                    ],
                    names=["number", "id", "score"],
                )

    return index.mapInArrow(run, "number long, id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    return top_rows(found, ["number"], [F.col("score").desc(), F.col("id")], k, rank="rank")


def search(
    docs: DataFrame,
    queries: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    shard_bytes: int = SHARD_BYTES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The k best documents of each query: item_id, rank (from 1), doc_id, score. Equal scores go by
    the smaller key.

    Terms are runs of ASCII letters, digits and all characters above ASCII, in ASCII lower case. A
    document scores, for each term of the query and each time it is there, the term's weight times
    what its count makes of it (`statistics`, `parts`). Only scores above 0 are given.

    Null and empty texts have no terms: such a document is found by nothing and a query finds nothing.
    Documents that repeat a row or a key are ranked each; a null key stands behind all others of a
    score. Of several texts of a query id the first in order counts; a null id is one query. Extra
    columns are ignored. Terms are known by 64-bit hashes. The queries are worked on in blocks of
    `block_words` words, one after another; each reads the stored shards and writes its own blocks.
    """
    asked = queries.groupBy(F.col(item).alias("item")).agg(F.min(item_text).alias("text"))
    asked = materialise(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
    shards = index_texts(docs, key, text, shard_bytes)
    ahead = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    answers = None
    for block in query_blocks(asked, block_words):
        stats = statistics(shards, block.terms)
        if not stats.n:
            break
        index = blocked_index(shards, block, stats)
        first = materialise(best(search_index(index.filter(ahead), block, stats, k, {}), k), "first")
        least = {r["number"]: r["score"] for r in first.filter(F.col("rank") == k).collect()}
        rest = search_index(index.filter(~ahead), block, stats, k, least)
        found = materialise(best(first.drop("rank").unionByName(rest), k), "found")
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        answers = docs.sparkSession.createDataFrame([], "number long, id long, score long, rank int")
    return answers.join(asked.select("number", "item"), "number").select(
        F.col("item").alias("item_id"),
        F.col("rank").cast("int").alias("rank"),
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "score",
    )
