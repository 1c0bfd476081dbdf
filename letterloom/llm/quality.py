"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded (what kinds of
characters follow each other, how its words repeat, which words it has; then one layer of neurons).
Gated attention, softmax of w . (tanh(V h) * sigmoid(U h)), says how much each passage counts; the
weighted passages are one vector, and a logistic layer gives its probability. All layers are learned
together from the labels of documents.
"""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.llm.common import WordHashes, annotate, free_name, pieces, texts
from letterloom.session import materialise

PASSAGE_WORDS = 64
#: Longer texts are read in segments that end at white space, or after so many bytes without any.
SEGMENT_BYTES = 1 << 20
BUCKETS = 64
HIDDEN, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4

SPACE, NEWLINE, LETTER, CAPITAL, DIGIT, STOP, PAUSE, SIGN = range(8)
WHITE = b" \t\n\r\x0b\x0c"
#: The kind of each byte.
KINDS = np.array(
    [
        NEWLINE if b == 0x0A
        else SPACE if b in WHITE
        else DIGIT if 0x30 <= b <= 0x39
        else CAPITAL if 0x41 <= b <= 0x5A
        else LETTER if 0x61 <= b <= 0x7A or b >= 0x80
        else STOP if b in b".!?"
        else PAUSE if b in b",;:'-\""
        else SIGN
        for b in range(256)
    ],
    np.uint8,
)
N_KINDS = 8
WIDTH = N_KINDS * N_KINDS + BUCKETS + 5

SCORED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("n_passages", T.LongType()),
        T.StructField("top_passage", T.LongType()),
        T.StructField("top_weight", T.DoubleType()),
    ]
)


class Model(NamedTuple):
    """Means and scales of the features, and the layers."""

    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]


def segments(text: bytes, limit: int = SEGMENT_BYTES) -> list[bytes]:
    """A text in pieces of at most `limit` bytes, cut after white space where there is any."""
    out, start = [], 0
    while len(text) - start > limit:
        end = max(text.rfind(bytes([b]), start, start + limit) for b in WHITE) + 1 or start + limit
        out.append(text[start:end])
        start = end
    return [*out, text[start:]]


def passage_features(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and the number of passages of each text (1 for an empty one)."""
    parts = [segments(t) for t in texts]
    flat = [s for p in parts for s in p]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    found, at, held = [], 0, 0
    for i, s in enumerate(flat):
        held += len(s)
        if held >= 2 * SEGMENT_BYTES or i == len(flat) - 1:
            found.append(_segment_features(flat[at : i + 1], hashes))
            at, held = i + 1, 0
    n_passages = np.concatenate([n for _, n in found])
    sizes = np.bincount(owner, weights=n_passages, minlength=len(texts)).astype(np.int64)
    return np.concatenate([rows for rows, _ in found]), sizes


def _segment_features(flat: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage of some segments, and their numbers of passages.

    A passage is so many words of a segment. Its features: shares of pairs of neighbouring bytes by
    kind (roots, to spread small ones), shares of words by hash, number and length of words, distinct
    words, words that repeat the one before, bytes.
    """
    joined = b"".join(s + b"\n" for s in flat)
    ends = np.cumsum([len(s) + 1 for s in flat])
    kinds = KINDS[np.frombuffer(joined, np.uint8)]
    white = kinds <= NEWLINE
    begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    words = joined.lower().split()
    segment = np.searchsorted(ends, begins, side="right")  # of each word
    n_words = np.bincount(segment, minlength=len(flat))
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first_word, first_passage = np.cumsum(n_words) - n_words, np.cumsum(n_passages) - n_passages
    of_word = first_passage[segment] + (np.arange(len(words)) - first_word[segment]) // PASSAGE_WORDS
    total = int(n_passages.sum())

    # a passage reaches up to the first word of the next one
    heads = np.concatenate([[0], ends[:-1]])
    starts = np.full(total, -1, np.int64)
    starts[first_passage] = heads
    later = np.flatnonzero(np.diff(of_word, prepend=-1) > 0) if len(words) else np.zeros(0, np.int64)
    later = later[of_word[later] != first_passage[segment[later]]]
    starts[of_word[later]] = begins[later]
    sizes = np.diff(np.append(starts, len(joined)))
    of_byte = np.repeat(np.arange(total, dtype=np.int32), sizes)
    pairs = of_byte[:-1] * np.int32(N_KINDS * N_KINDS) + (kinds[:-1] * np.int32(N_KINDS) + kinds[1:])
    inside = np.ones(len(pairs), bool)
    inside[ends[:-1] - 1] = False
    counts = np.bincount(pairs[inside], minlength=total * N_KINDS * N_KINDS).reshape(total, -1)

    h = hashes.of(words)
    held = np.bincount(of_word, minlength=total)
    per_word = 1.0 / np.maximum(held, 1)
    buckets = np.bincount(
        of_word * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS
    ).reshape(total, -1)
    key = np.sort((of_word.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(36)).astype(np.int64), minlength=total)
    same = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    repeats = np.bincount(of_word[1:][same], minlength=total)
    visible = np.bincount(of_byte[~white], minlength=total)
    out = np.empty((total, WIDTH), np.float32)
    out[:, : N_KINDS * N_KINDS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    out[:, N_KINDS * N_KINDS : -5] = np.sqrt(buckets * per_word[:, None])
    out[:, -5] = np.log1p(held)
    out[:, -4] = np.log1p(visible * per_word)
    out[:, -3] = distinct * per_word
    out[:, -2] = repeats * per_word
    out[:, -1] = np.log1p(sizes)
    return out, n_passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def new_layers(width: int, hidden: int, gates: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"W": (width, hidden), "b": (hidden,), "V": (hidden, gates), "U": (hidden, gates), "w": (gates,),
              "c": (hidden,), "d": (1,)}
    return {k: rng.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shapes.items()}


def forward(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Probability of each bag and all that led to it; `sizes` are the passages of each bag, 1 at least."""
    starts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ p["c"] + p["d"]), "bag": bag, "starts": starts}


def gradients(
    p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray
) -> dict[str, np.ndarray]:
    """Of the weighted mean cross entropy."""
    f = forward(p, x, sizes)
    bag, h, t, s, a = f["bag"], f["h"], f["t"], f["s"], f["a"]
    off = (f["p"] - y) * weight / weight.sum()
    dz = off[:, None] * p["c"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, f["starts"])[bag])
    gate = de[:, None] * p["w"]
    dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ off,
            "d": off.sum(keepdims=True)}


def fit_layers(
    x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = HIDDEN, gates: int = GATES
) -> dict[str, np.ndarray]:
    """Adam over small batches of bags, in an order drawn from a fixed seed."""
    p = new_layers(x.shape[1], hidden, gates)
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(1)
    means, squares = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, steps = 0, EPOCHS * -(-len(sizes) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sizes))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            rows = np.concatenate([np.arange(starts[b], starts[b] + sizes[b]) for b in bags])
            found = gradients(p, x[rows], sizes[bags], y[bags], weight[bags])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in found.items():
                g = g + DECAY * p[k]
                means[k] = 0.9 * means[k] + 0.1 * g
                squares[k] = 0.999 * squares[k] + 0.001 * g * g
                p[k] = p[k] - rate * means[k] / (1 - 0.9**step) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
    return p


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, label) of keys that are labelled 0 or 1, and not both."""
    return (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("__other"))
        .filter(F.col("label") == F.col("__other"))
        .drop("__other")
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = 2000,
    passages_per_doc: int = 32,
) -> Model | float:
    """The model of a bounded sample of labelled documents, or the share of label 1 if one label lacks.

    At most `per_class` documents of each label are learned from, by a hash of the key, and of a
    document with more than `passages_per_doc` passages that many, spread evenly over its whole text. Passages
    are encoded where the texts are; the driver gets at most 2 * per_class * passages_per_doc rows of
    numbers. Documents are weighted by how many of their label there are in all, so that scores are
    probabilities. Keys labelled both ways, null keys and null labels are left out; a key's rows all count.
    """
    known = labelled(labels, key, label)
    short = docs.select(F.col(key).alias("id")).filter(F.col("id").isNotNull()).distinct().join(known, "id")
    short = materialise(short, "labelled")
    counts = {r["label"]: r["count"] for r in short.groupBy("label").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = [short.filter(F.col("label") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    picked = materialise(chosen[0].unionByName(chosen[1]), "sample")
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(picked, "id")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for piece in pieces(batches, "text"):
            x, sizes = passage_features(texts(piece, "text"), hashes)
            ends = np.cumsum(sizes)
            kept = [
                x[e - n : e][np.linspace(0, n - 1, min(n, passages_per_doc)).round().astype(int)]
                for n, e in zip(sizes, ends, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id").cast(pa.string()),
                    piece.column("label"),
                    pa.array([k.tobytes() for k in kept], pa.binary()),
                ],
                names=["id", "label", "passages"],
            )

    encoded = found.select("id", "label", "text").mapInArrow(encode, "id string, label int, passages binary")
    rows = sorted(materialise(encoded, "passages").collect(), key=lambda r: (r["id"], bytes(r["passages"])))
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, WIDTH) for r in rows]
    x, y = np.concatenate(bags).astype(float), np.array([r["label"] for r in rows], float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    learned = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.array([counts[int(v)] / learned[int(v)] for v in y])
    layers = fit_layers(standard(x, mean, scale), np.array([len(b) for b in bags]), y, weight / weight.mean())
    return Model(mean, scale, layers)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _scorer(model: Model | float, threshold: float):
    def make():
        hashes = WordHashes()

        def score(texts: list[bytes]):
            if isinstance(model, float):
                n = len(texts)
                return [model] * n, [int(model >= threshold)] * n, [0] * n, [None] * n, [None] * n
            x, sizes = passage_features(texts, hashes)
            f = forward(model.layers, standard(x, model.mean, model.scale), sizes)
            top = np.lexsort((np.arange(len(x)), -f["a"], f["bag"]))[f["starts"]]
            # products of matrices differ in the last bits by the rows around a passage
            p, weights = f["p"].round(9), f["a"][top].round(9)
            return p, (p >= threshold).astype(np.int32), sizes, top - f["starts"], weights

        return score

    return make


def score_quality(
    docs: DataFrame, model: Model | float, text: str = "text", threshold: float = 0.3, name: str = "quality"
) -> DataFrame:
    """`docs` with a struct column: score (probability of label 1), predicted (score >= threshold),
    n_passages, top_passage (from 0, the one with the largest attention weight, the first of equal
    ones) and top_weight.

    All passages of the whole text count. A null or empty text is one passage without words. Scores
    and weights have nine decimals, so that equal texts get equal ones. Without a model all scores are the share of label 1 and there are no
    passages. Extra columns are kept; `name` gets underscores if it is taken.
    """
    return annotate(docs, text, SCORED, _scorer(model, threshold), free_name(docs, name))
