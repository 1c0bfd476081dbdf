"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.llm.common import annotate, free_name, pieces, plain_words, texts
from letterloom.session import materialise

BLOCK = 64
#: Blocks that are read before any bound is compared.
FIRST_BLOCKS = 4
#: Lists of more than a part of all examples are rows of a matrix, the most frequent ones at most.
HOT_SHARE, HOT_LISTS = 32, 4096
#: Queries whose products with that matrix are worked out at once.
QUERIES = 256
#: What sums in single precision may be off by.
SLACK = 1e-5
#: Besides whole words, their first so many bytes are terms too, for the forms of one stem.
STEMS = (4, 5)

#: Words whose terms a task remembers.
WORDS_HELD = 1 << 18

SCORED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("neighbours", T.ArrayType(T.LongType())),
    ]
)


class Postings(NamedTuple):
    """The examples of each term, cut into entries of one block of examples each."""

    first: np.ndarray  # of each term, its first entry
    blocks: np.ndarray  # of each entry
    largest: np.ndarray  # weight of each entry
    starts: np.ndarray  # of each entry, its first posting
    rows: np.ndarray
    values: np.ndarray


def postings(terms: np.ndarray, rows: np.ndarray, values: np.ndarray, kinds: int) -> Postings:
    """Of weights that are not 0, each given by its term below `kinds` and its row."""
    order = np.lexsort((rows, terms))
    terms, rows, values = terms[order], rows[order].astype(np.int32), values[order].astype(np.float32)
    place = terms.astype(np.int64) << 32 | rows // BLOCK
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    largest = np.maximum.reduceat(values, starts) if len(values) else values
    first = np.searchsorted(terms[starts], np.arange(kinds + 1))
    return Postings(first, rows[starts] // BLOCK, largest, np.append(starts, len(rows)), rows, values)


class Lists(NamedTuple):
    """Weights of the examples: by example, and by term in blocks where its list is not a frequent one."""

    hot: np.ndarray  # of each term, its column among the frequent ones or -1
    rest: Postings  # of all other terms
    ends: np.ndarray  # of each example, where its own terms end
    terms: np.ndarray
    values: np.ndarray


def arranged(terms: np.ndarray, rows: np.ndarray, values: np.ndarray, kinds: int, examples: int) -> Lists:
    """Of weights that are not 0, each given by its term below `kinds` and its example."""
    df = np.bincount(terms, minlength=kinds)
    frequent = np.argsort(-df, kind="stable")[:HOT_LISTS]
    frequent = np.sort(frequent[df[frequent] * HOT_SHARE > examples])
    hot = np.full(kinds, -1, np.int32)
    hot[frequent] = np.arange(len(frequent))
    rare = hot[terms] < 0
    order = np.lexsort((terms, rows))
    ends = np.cumsum(np.bincount(rows, minlength=examples))
    rest = postings(terms[rare], rows[rare], values[rare], kinds)
    return Lists(hot, rest, ends, terms[order].astype(np.int32), values[order].astype(np.float32))


def frequent_lists(lists: Lists) -> np.ndarray:
    """The frequent lists as a matrix, examples x columns; made where it is used."""
    matrix = np.zeros((len(lists.ends), int(lists.hot.max(initial=-1)) + 1), np.float32)
    begins = lists.ends - np.diff(lists.ends, prepend=0)
    for row, begin, end in zip(matrix, begins, lists.ends, strict=True):
        columns = lists.hot[lists.terms[begin:end]]
        row[columns[columns >= 0]] = lists.values[begin:end][columns >= 0]
    return matrix


class Index(NamedTuple):
    """Labelled examples, ordered so that like ones share a block."""

    terms: dict[bytes, int]
    idf: np.ndarray
    lists: Lists
    labels: np.ndarray
    ids: np.ndarray
    default: float  # share of toxic examples among those without any telling term


def labelled_examples(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int, max_chars: int
) -> DataFrame:
    """At most `per_class` labelled documents of each class, by a hash of the key: (id, text, label).

    The bound is what makes the index small enough to send to every task. Texts over `max_chars`
    code points are not taken as examples (they are scored like all others), so the sample is at
    most 2 * per_class * max_chars code points. Keys labelled both ways and null labels are left out.
    """
    clean = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("__other"))
        .filter(F.col("label") == F.col("__other"))
        .drop("__other")
    )
    found = docs.filter(F.length(text).between(1, max_chars)).select(
        F.col(key).alias("id"), F.col(text).alias("text")
    )
    # ranked without the texts; only the chosen rows' texts are fetched
    short = found.select("id").join(clean, "id").groupBy("id").agg(F.first("label").alias("label"))
    order = F.struct(F.xxhash64(F.col("id").cast("string")), F.col("id"))
    chosen = None
    for value in (0, 1):
        part = short.filter(F.col("label") == value).orderBy(order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = materialise(chosen, "examples")
    return found.join(picked, "id").groupBy("id").agg(F.first("text").alias("text"), F.first("label").alias("label"))


def terms_of(words: list[bytes]) -> list[list[bytes]]:
    """The terms of each word: itself, and the stems of longer ones marked with a star."""
    return [[w, *(w[:n] + b"*" for n in STEMS if len(w) > n)] for w in words]


def build_index(examples: DataFrame, max_terms: int, min_contexts: int, z: float, emphasis: float) -> Index:
    """The index over all terms of the examples.

    Terms that tell the classes apart have `emphasis` times their TF-IDF weight, as that of all the
    rest would drown them. For these, a term counts once for each different next word in a class, so
    that a passage that is copied through many examples is one occurrence. They are those whose toxic
    share is above that of all by `z` standard errors, at most `max_terms`. Where none occurs, as in
    copies of a toxic passage of plain words, the nearest examples are those with the same words.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            columns: list[list] = [[], [], [], [], []]
            ids, labels = piece.column("id").to_pylist(), piece.column("label").to_pylist()
            for i, label, t in zip(ids, labels, texts(piece, "text"), strict=True):
                words = plain_words(t)
                pairs = Counter(
                    (term, after)
                    for terms, after in zip(terms_of(words), [*words[1:], b""], strict=True)
                    for term in terms
                )
                for column, values in zip(
                    columns,
                    ([i] * len(pairs), [label] * len(pairs), [t for t, _ in pairs], [a for _, a in pairs], pairs.values()),
                    strict=True,
                ):
                    column.extend(values)
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["id", "label", "term", "after", "n"],
            )

    schema = "id long, label int, term binary, after binary, n long"
    occurring = examples.select("id", "label", "text").mapInArrow(counted, schema)
    contexts = (
        occurring.groupBy("term", "after")
        .agg(F.max(1 - F.col("label")).alias("clean"), F.max("label").alias("toxic"))
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    contexts = materialise(contexts, "contexts")
    all_clean, all_toxic = contexts.agg(
        F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))
    ).first()
    share = all_toxic / max(1, all_clean + all_toxic)
    n = F.col("clean") + F.col("toxic")
    telling = (
        contexts.filter(n >= min_contexts)
        .withColumn("z", (F.col("toxic") - n * share) / F.sqrt(n * max(share * (1 - share), 1e-12)))
        .filter(F.col("z") >= z)
        .orderBy(F.col("z").desc(), "term")
        .limit(max_terms)
        .collect()
    )
    # the sample is bounded, and its texts are smaller than its postings
    people = examples.select("id", "label", "text").orderBy("id").toArrow()
    labels = people.column("label").to_numpy().astype(np.int64)
    ids = people.column("id").to_numpy().astype(np.int64)
    terms: dict[bytes, int] = {}
    found: list[tuple] = []
    for text in people.column("text").cast(pa.binary()).to_pylist():
        counts = Counter(t for of_word in terms_of(plain_words(text)) for t in of_word)
        places = [terms.setdefault(t, len(terms)) for t in counts]
        found.append((np.array(places, np.int64), 1 + np.log(np.fromiter(counts.values(), float, len(counts)))))
    sizes = np.array([len(t) for t, _ in found], np.int64)
    columns = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in found)])
    weights = np.concatenate([np.zeros(0), *(w for _, w in found)])
    rows = np.repeat(np.arange(len(ids)), sizes)
    idf = np.log((1 + len(ids)) / (1 + np.bincount(columns, minlength=len(terms)))) + 1
    tells = np.zeros(len(terms), bool)
    tells[[terms[bytes(r["term"])] for r in telling]] = True
    idf[tells] *= emphasis
    weights *= idf[columns]
    silent = np.bincount(rows, weights=tells[columns], minlength=len(ids)) == 0
    # add-one share, so that no evidence never gives certainty
    default = (labels[silent].sum() + labels.mean()) / (silent.sum() + 1) if len(ids) else 0.0
    norm = np.sqrt(np.bincount(rows, weights=weights**2, minlength=len(ids)))
    weights /= norm[rows]
    heaviest = np.zeros(len(ids), np.int64)
    by_weight = np.argsort(weights, kind="stable")
    heaviest[rows[by_weight]] = columns[by_weight]
    order = np.lexsort((ids, heaviest))
    moved = np.empty(len(ids), np.int64)
    moved[order] = np.arange(len(ids))
    lists = arranged(columns, moved[rows], weights, len(terms), len(ids))
    return Index(terms, idf, lists, labels[order], ids[order], float(default))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many as its size says."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def nearest(
    lists: Lists, matrix: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]], k: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k nearest examples of unit vectors, each given by its terms and weights, and their cosines.

    What the frequent terms add is known for all examples by one product of matrices. With it, the
    largest such sum of a block and the block's largest weights of the other terms bound its cosines.
    The blocks of the largest bounds are read first, then all whose bound can beat the k-th cosine
    found; and the cosines of those that can be among the k are summed again in double precision. So
    the result is exact. Ties go to the smaller position.
    """
    n, rest = len(lists.ends), lists.rest
    starts = np.arange(0, n, BLOCK)
    begins = lists.ends - np.diff(lists.ends, prepend=0)
    weight_of = np.zeros(len(lists.hot))
    for at in range(0, len(asked), QUERIES):
        some = asked[at : at + QUERIES]
        columns = [lists.hot[terms] for terms, _ in some]
        heads = np.zeros((len(some), matrix.shape[1]), np.float32)
        for head, column, (_, weights) in zip(heads, columns, some, strict=True):
            head[column[column >= 0]] = weights[column >= 0]
        for sums, column, (terms, weights) in zip(heads @ matrix.T, columns, some, strict=True):
            rare, of_rare = terms[column < 0], weights[column < 0]
            sizes = rest.first[rare + 1] - rest.first[rare]
            entries, by = _ranges(rest.first[rare], sizes), np.repeat(of_rare, sizes)
            blocks = rest.blocks[entries]
            bounds = np.bincount(blocks, weights=rest.largest[entries] * by, minlength=len(starts))
            bounds = bounds + np.maximum.reduceat(sums, starts)
            scores = sums.astype(np.float64)
            read, least = np.zeros(len(starts), bool), 0.0
            for turn in (0, 1):
                now = ~read & (bounds > 0)
                if turn:
                    now &= bounds >= least - SLACK
                else:
                    now[np.argsort(-bounds, kind="stable")[FIRST_BLOCKS:]] = False
                read |= now
                use = now[blocks]
                part = entries[use]
                sizes = rest.starts[part + 1] - rest.starts[part]
                hits = _ranges(rest.starts[part], sizes)
                scores = scores + np.bincount(rest.rows[hits], weights=rest.values[hits] * np.repeat(by[use], sizes), minlength=n)
                known = np.flatnonzero(np.repeat(read, BLOCK)[:n] & (scores > 0))
                if len(known) >= k:
                    least = np.partition(scores[known], -k)[-k]
            found = known[scores[known] >= least - SLACK]
            if not len(found):
                yield found, np.zeros(0)
                continue
            weight_of[terms] = weights
            sizes = lists.ends[found] - begins[found]
            own = _ranges(begins[found], sizes)
            cosines = np.add.reduceat(lists.values[own].astype(np.float64) * weight_of[lists.terms[own]], np.cumsum(sizes) - sizes)
            weight_of[terms] = 0
            best = np.lexsort((found, -cosines))[:k]
            yield found[best], cosines[best]


class WordTerms(dict):
    """Numbers of words, and the index terms of each; held up to a bound."""

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.known = terms
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.sizes: list[int] = []
        self.terms: list[int] = []

    def __missing__(self, word: bytes) -> int:
        found = [self.known[t] for t in terms_of([word])[0] if t in self.known]
        self.terms += found
        self.sizes.append(len(found))
        self[word] = n = len(self)
        return n

    def vectors(self, texts: Iterable[bytes], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The terms of each text, in order, and their TF-IDF weights, with length 1."""
        if len(self) > WORDS_HELD:
            self.reset()
        words = [np.fromiter(map(self.__getitem__, plain_words(t)), np.int32) for t in texts]
        sizes, flat = np.array(self.sizes, np.int64), np.array(self.terms, np.int64)
        starts = np.cumsum(sizes) - sizes
        out = []
        for ids in words:
            word, times = np.unique(ids, return_counts=True)
            terms, place = np.unique(flat[_ranges(starts[word], sizes[word])], return_inverse=True)
            counts = np.bincount(place, weights=np.repeat(times, sizes[word]), minlength=len(terms))
            weights = (1 + np.log(counts)) * idf[terms]
            out.append((terms, weights / max(np.sqrt((weights**2).sum()), 1e-300)))
        return out


def _scorer(index: Index, k: int, threshold: float):
    def make():
        names = list(index.terms)
        words, matrix = WordTerms(index.terms), frequent_lists(index.lists)
        return lambda texts: score(texts, names, words, matrix)

    def score(texts: list[bytes], names: list[bytes], words: WordTerms, matrix: np.ndarray):
        # equal texts of a piece are answered once
        place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        asked = words.vectors(place, index.idf)
        if len(index.labels):
            near = nearest(index.lists, matrix, asked, k)
            votes = [vote(names, q, *found) for q, found in zip(asked, near, strict=True)]
        else:
            votes = [(index.default, [], [])] * len(asked)
        chosen = [votes[place[t]] for t in texts]
        scores = [s for s, _, _ in chosen]
        return scores, [int(s >= threshold) for s in scores], [why for _, why, _ in chosen], [ids for _, _, ids in chosen]

    def vote(names: list[bytes], query: tuple[np.ndarray, np.ndarray], found: np.ndarray, cosines: np.ndarray) -> tuple:
        if not len(found):
            return index.default, [], []
        terms, weights = query
        near = cosines**2
        # the votes of one more neighbour of weight 0.25 that stands for documents without evidence
        s = (near @ index.labels[found] + 0.25 * index.default) / (near.sum() + 0.25)
        top = np.argsort(-weights, kind="stable")[:5]
        return float(min(1.0, max(0.0, s))), [names[t].decode(errors="replace") for t in terms[top]], index.ids[found].tolist()

    return make


def score_toxicity(
    docs: DataFrame,
    index: Index,
    text: str = "text",
    k: int = 15,
    threshold: float = 0.7,
    name: str = "toxicity",
) -> DataFrame:
    """`docs` with a struct column: score (0 to 1), predicted (score >= threshold), evidence (the
    heaviest shared words) and neighbours (ids of the examples that voted).

    The score is the share of toxic among the k nearest examples, weighted by squared cosine. A text
    without any of the index's terms, empty and null ones too, gets the share of toxic examples among
    those without telling terms. Equal texts get equal scores. Extra columns are kept; `name` gets
    underscores if it is taken.
    """
    return annotate(docs, text, SCORED, _scorer(index, k, threshold), free_name(docs, name))


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = 2000,
    max_chars: int = 20_000,
    max_terms: int = 512,
    min_contexts: int = 5,
    z: float = 6.0,
    emphasis: float = 30.0,
) -> Index:
    """The index of a bounded sample of labelled documents; without labelled rows all scores are 0."""
    examples = materialise(
        labelled_examples(docs, labels, key, text, label, per_class, max_chars), "labelled"
    )
    return build_index(examples, max_terms, min_contexts, z, emphasis)
