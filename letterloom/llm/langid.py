"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a variable-order tree of byte contexts. A byte is coded in the longest context that
was seen in training; where it is new there, an escape is paid (method C: a context with n bytes
seen, d of them different, gives d / (n + d) to the escape) and the next shorter context is asked,
down to equal shares of 256. The statistics are frozen, so the code length of a byte depends only on
the bytes before it, and equal strings of order + 1 bytes are coded once a piece.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.functions.ranking import top_rows
from letterloom.llm.common import annotate, free_name
from letterloom.session import materialise

ORDER = 4
#: Parts of a language that are ranked on their own before the whole is.
PARTS = 64
MASK = (1 << (8 * (ORDER + 1))) - 1

PREDICTED = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
     T.StructField("bits", T.ArrayType(T.DoubleType()))]
)


class Tree(NamedTuple):
    """Per order k: strings of k + 1 bytes seen and their bits; contexts of k bytes, their escape bits."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, it and the ORDER bytes before it as a number; zeros stand before a text. Also
    the number of bytes of each text."""
    pad = b"\0" * ORDER
    joined = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    code = joined.copy()
    for back in range(1, ORDER + 1):
        code[back:] |= joined[:-back] << (8 * back)
    lengths = np.array([len(t) for t in texts], np.int64)
    own = np.ones(len(joined), bool)
    heads = np.cumsum([0, *(lengths[:-1] + ORDER)]) if len(texts) else np.zeros(0, np.int64)
    for back in range(ORDER):
        own[heads + back] = False
    return code[own] & MASK, lengths


def grow(texts: list[bytes]) -> Tree:
    codes, _ = strings(texts)
    tree = Tree([], [], [], [])
    for k in range(ORDER + 1):
        grams, counts = np.unique(codes & ((1 << (8 * (k + 1))) - 1), return_counts=True)
        contexts, first = np.unique(grams >> 8, return_index=True)
        seen = np.add.reduceat(counts, first) if len(grams) else counts
        kinds = np.diff([*first, len(grams)])
        owner = np.searchsorted(contexts, grams >> 8)
        tree.grams.append(grams)
        tree.bits.append(np.log2((seen + kinds)[owner] / counts) if len(grams) else np.zeros(0))
        tree.contexts.append(contexts)
        tree.escapes.append(np.log2((seen + kinds) / kinds) if len(grams) else np.zeros(0))
    return tree


def code_bits(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """Exact code length in bits of the last byte of each code."""
    total = np.zeros(len(codes))
    open_ = np.arange(len(codes))
    for k in range(ORDER, -1, -1):
        if not len(open_) or not len(tree.grams[k]):
            continue
        gram = codes[open_] & ((1 << (8 * (k + 1))) - 1)
        at = np.minimum(np.searchsorted(tree.grams[k], gram), len(tree.grams[k]) - 1)
        hit = tree.grams[k][at] == gram
        total[open_[hit]] += tree.bits[k][at[hit]]
        open_, gram = open_[~hit], gram[~hit] >> 8
        at = np.minimum(np.searchsorted(tree.contexts[k], gram), len(tree.contexts[k]) - 1)
        known = tree.contexts[k][at] == gram
        total[open_[known]] += tree.escapes[k][at[known]]
    total[open_] += 8.0
    return total


def learn(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    docs_per_lang: int = 300,
    max_chars: int = 20_000,
) -> dict[str, Tree]:
    """A tree for each non-null language, from at most `docs_per_lang` of its documents by a hash of
    the key. Only documents of 1 to `max_chars` code points are learned from (all are predicted), so a
    language's sample is at most docs_per_lang * max_chars code points. One task grows one tree.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.length(text).between(1, max_chars)).select(
        F.col(lang).alias("lang"), F.col(key).cast("string").alias("id"), F.col(text).alias("text")
    )
    # the first of each of many parts of a language, then the first of those: no task ranks a language
    order = [F.col("h"), F.col("id")]
    hashed = usable.select("lang", "id", F.xxhash64("id").alias("h"))
    parted = hashed.withColumn("part", F.pmod(F.xxhash64("h", F.lit("part")), F.lit(PARTS)))
    ranked = top_rows(top_rows(parted, ["lang", "part"], order, docs_per_lang), ["lang"], order, docs_per_lang)
    chosen = materialise(ranked.select("lang", "id").distinct(), "sample")
    sample = usable.join(chosen, ["lang", "id"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        tree = grow([t.encode() for t in sorted(pdf["text"])[:docs_per_lang]])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "tree": [pickle.dumps(tuple(tree))]})

    import pickle

    grown = sample.groupBy("lang").applyInPandas(one, "lang string, tree binary").collect()
    return {r["lang"]: Tree(*pickle.loads(bytes(r["tree"]))) for r in sorted(grown, key=lambda r: r["lang"])}


def _predictor(trees: dict[str, Tree]):
    names = list(trees)

    def make():
        import regex

        letter = regex.compile(r"\p{L}")
        return lambda texts: predict(texts, letter)

    def predict(texts: list[bytes], letter):
        codes, lengths = strings(texts)
        unique, back = np.unique(codes, return_inverse=True)
        ends = np.cumsum(lengths)
        bits = np.zeros((len(names), len(texts)))
        for i, name in enumerate(names):
            running = np.concatenate([[0.0], np.cumsum(code_bits(trees[name], unique)[back])])
            bits[i] = running[ends] - running[ends - lengths]
        langs, scores = [], []
        for j, t in enumerate(texts):
            if not names or not letter.search(t.decode(errors="replace")):
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(bits[:, j].argmin())
            gap = np.minimum(bits[:, j] - bits[best, j], 1000.0)
            langs.append(names[best])
            scores.append(float(1.0 / np.exp2(-gap).sum()))
        return langs, scores, pa.array(list(bits.T), pa.list_(pa.float64()))

    return make


def predict_language(
    docs: DataFrame, trees: dict[str, Tree], text: str = "text", name: str = "language"
) -> DataFrame:
    """`docs` with a struct column: lang (the language whose tree codes the whole text shortest; ties
    go to the first by name), score (its share of 2 ** -bits over all languages) and bits (the code
    length under each language, by name).

    `und` with score 0 if the text is null, empty or has no letter, or no language was learned. Extra
    columns are kept; `name` gets underscores if it is taken.
    """
    return annotate(docs, text, PREDICTED, _predictor(trees), free_name(docs, name))
