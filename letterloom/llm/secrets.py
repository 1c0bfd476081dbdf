"""Secret scans: candidates by their shape, false positives removed by a random forest.

Candidates are runs that could be keys, and values assigned to names such as password. A forest over
their length, character transitions, dictionary coverage, path signs and neighbouring words, trained
from labelled findings, decides which are secrets.
"""

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.llm.common import annotate, free_name, pieces, texts, word_counts
from letterloom.session import materialise

#: Runs of ten characters or more with a digit, or values assigned to a name that promises a secret.
RUN = re.compile(rb"(?<![A-Za-z0-9+/_\-])[A-Za-z+/_\-]*+\d[A-Za-z0-9+/_\-]*+={0,2}")
ASSIGNED = re.compile(
    rb"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|auth|credential)s?[\"']?\s*[:=]\s*[\"']?"
    rb"([^\s\"',;]{6,})"
)
LEAST_CHARS = 10
NAMES = re.compile(rb"(?i)(passw|pwd|secret|token|key|auth|cred|bearer|private|akia)")
LETTERS = re.compile(rb"[A-Za-z]{3,}")
LABELS = ["length", "entropy", "digits", "upper", "lower", "symbols", "changes", "hexadecimal", "longest_letters",
          "transitions", "dictionary", "slashes", "path", "named", "assigned", "quoted", "word_before",
          "word_after", "dictionary_before", "dictionary_after"]

SPAN = T.StructType(
    [
        T.StructField("begin", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)
SCANNED = T.StructType(
    [
        T.StructField("n_candidates", T.LongType()),
        T.StructField("secrets", T.ArrayType(SPAN)),
        T.StructField("redacted", T.StringType()),
    ]
)
FINDING = "id string, begin int, value binary, before binary, after binary, features array<double>"


class Language(NamedTuple):
    """What ordinary text looks like: log-probabilities of letter pairs, and frequent words."""

    pairs: np.ndarray
    words: frozenset[bytes]


class Forest(NamedTuple):
    language: Language
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # feature, limit, left child, value


def learn_language(docs: DataFrame, text: str = "text", share: float = 2e-5) -> Language:
    """Letter pairs and words of all texts. Words with at least `share` of all words are the dictionary,
    so it has at most 1 / share entries; pairs are counted over all words."""
    counts = materialise(
        word_counts(docs, text, lambda t: LETTERS.findall(t.lower()), lambda w: len(w) <= 20), "letters"
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(3, int(np.ceil(share * total)))
    words = counts.filter((F.col("n") >= least) & (F.length("word") >= 3)).select("word").collect()

    def count_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(676, np.int64)
        for batch in batches:
            found = batch.column("word").to_pylist()
            joined = np.frombuffer(b" ".join(found) + b" ", np.uint8).astype(np.int64) - 97
            weight = np.repeat(batch.column("n").to_numpy(), [len(w) + 1 for w in found])
            both = (joined[:-1] >= 0) & (joined[1:] >= 0)
            sums += np.bincount(
                (joined[:-1] * 26 + joined[1:])[both], weights=weight[:-1][both], minlength=676
            ).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(676)), pa.array(sums)], names=["pair", "n"])

    pairs = np.ones((26, 26))
    for r in counts.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[divmod(r["pair"], 26)] += r["n"]
    return Language(
        np.log(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(bytes(r["word"]) for r in words)
    )


def candidates(text: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(begin, end, word before, word after) in bytes, in text order, without overlaps."""
    spans = [m.span(1) for m in ASSIGNED.finditer(text)]
    taken = {b for b, _ in spans}
    for m in RUN.finditer(text):
        if m.end() - m.start() >= LEAST_CHARS and m.start() not in taken:
            spans.append(m.span())
    out, last = [], -1
    for begin, end in sorted(spans):
        if begin < last:
            continue
        last = end
        # the neighbours are looked for close by, so that a long text is not copied for each candidate
        before = text[max(0, begin - 80) : begin].split()
        after = text[end : end + 80].split()
        # back to the first word with letters, so that signs between a name and its value come with it
        back = 1
        while back < min(3, len(before)) and not LETTERS.search(before[-back]):
            back += 1
        out.append((begin, end, b"".join(before[-back:]), after[0] if after else b""))
    return out


def features(value: bytes, before: bytes, after: bytes, language: Language) -> list[float]:
    """In the order of LABELS."""
    n = max(1, len(value))
    codes = np.frombuffer(value or b" ", np.uint8)
    counts = np.bincount(codes)
    shares = counts[counts > 0] / n
    digit = (codes >= 48) & (codes <= 57)
    upper = (codes >= 65) & (codes <= 90)
    lower = (codes >= 97) & (codes <= 122)
    kinds = digit + 2 * upper + 3 * lower
    low = value.lower()
    found = LETTERS.findall(low)
    steps = [
        language.pairs[a - 97, b - 97]
        for word in found
        for a, b in zip(word[:200], word[1:201], strict=False)
    ]
    covered = sum(len(w) for w in found if w in language.words)
    stem = lambda w: b"".join(LETTERS.findall(w.lower())[:1])
    return [
        float(min(n, 200)),
        float(-(shares * np.log2(shares)).sum()),
        float(digit.mean()),
        float(upper.mean()),
        float(lower.mean()),
        float((kinds == 0).mean()),
        float((kinds[1:] != kinds[:-1]).sum() / n),
        float(bool(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", value))),
        float(max(map(len, found), default=0)),
        float(np.mean(steps)) if steps else -8.0,
        covered / n,
        float(value.count(b"/")),
        float(before.endswith((b"/", b".", b"@", b":")) or b"/" in after[:1] or b"://" in before),
        float(bool(NAMES.search(before) or NAMES.search(value))),
        float(b"=" in before[-4:] or b":" in before[-4:]),
        float(before.endswith((b'"', b"'")) or after.startswith((b'"', b"'"))),
        float(bool(stem(before))),
        float(bool(stem(after))),
        float(stem(before) in language.words),
        float(stem(after) in language.words),
    ]


def findings(docs: DataFrame, language: Language, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate: id, begin (byte), value, before, after, features."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            rows = []
            for i, t in zip(piece.column("id").to_pylist(), texts(piece, "text"), strict=True):
                for begin, end, before, after in candidates(t):
                    value = t[begin:end]
                    rows.append((i, begin, value, before, after, features(value, before, after, language)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["id", "begin", "value", "before", "after", "features"],
            )

    return docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(find, FINDING)


def grow_tree(x: np.ndarray, y: np.ndarray, seed: int, depth: int, least: int) -> tuple:
    """One tree on a bootstrap sample: at each node the best Gini split of a random few features."""
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, len(y), len(y))
    x, y = x[rows], y[rows].astype(float)
    some = max(1, int(np.sqrt(x.shape[1])))
    feature, limit, left, value = [], [], [], []
    queue = [(np.arange(len(y)), 0, -1, False)]
    while queue:
        at, level, parent, right = queue.pop(0)
        me = len(value)
        if parent >= 0 and not right:
            left[parent] = me
        feature.append(-1), limit.append(0.0), left.append(-1), value.append(float(y[at].mean()))
        if level >= depth or len(at) < 2 * least or value[me] in (0.0, 1.0):
            continue
        best = (0.0, -1, 0.0)
        for f in rng.permutation(x.shape[1])[:some]:
            order = np.argsort(x[at, f], kind="stable")
            v, ones = x[at, f][order], np.cumsum(y[at][order])
            size = np.arange(1, len(at) + 1)
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(size[cut] >= least) & (len(at) - size[cut] >= least)]
            if not len(cut):
                continue
            l1, ln = ones[cut], size[cut]
            r1, rn = ones[-1] - l1, len(at) - ln
            impurity = l1 * (ln - l1) / ln + r1 * (rn - r1) / rn
            gain = ones[-1] * (len(at) - ones[-1]) / len(at) - impurity
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] < 0:
            continue
        feature[me], limit[me] = best[1], best[2]
        low = x[at, best[1]] <= best[2]
        # children are put in the queue together, so the right one's number is the left one's plus one
        queue += [(at[low], level + 1, me, False), (at[~low], level + 1, me, True)]
    return np.array(feature), np.array(limit), np.array(left), np.array(value)


def tree_values(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, limit, left, value = tree
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return value[at]
        node = at[inner]
        at[inner] = left[node] + (x[inner, feature[node]] > limit[node])


def train_forest(
    labelled: DataFrame,
    language: Language,
    n_trees: int = 24,
    depth: int = 8,
    least: int = 3,
    max_findings: int = 10_000,
) -> Forest:
    """A forest from labelled findings (value, features, label 0 or 1), one task a tree.

    At most `max_findings` of each label are taken, by a hash of the value; that bounds what every
    task gets. Without findings of both labels the forest has no trees and every candidate is kept
    as a secret (score 1), since nothing is known that would clear it.
    """
    import pickle

    rows = []
    for label in (0, 1):
        part = labelled.filter(F.col("label") == label)
        rows += (
            part.orderBy(F.xxhash64("value"), "value", F.col("features"))
            .limit(max_findings)
            .select("features", "label")
            .collect()
        )
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Forest(language, [])
    x = np.array([r["features"] for r in rows])

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            trees = [pickle.dumps(grow_tree(x, y, int(s), depth, least)) for s in pdf["id"]]
            yield pd.DataFrame({"id": pdf["id"], "tree": trees})

    seeds = labelled.sparkSession.range(n_trees).repartition(n_trees, "id")
    grown = seeds.mapInPandas(grow, "id long, tree binary").collect()
    return Forest(language, [pickle.loads(bytes(r["tree"])) for r in sorted(grown, key=lambda r: r["id"])])


def _scanner(forest: Forest, threshold: float, mask: bytes):
    def scan(texts: list[bytes]):
        found = [candidates(t) for t in texts]
        x = np.array(
            [features(t[b:e], p, a, forest.language) for t, c in zip(texts, found, strict=True) for b, e, p, a in c]
        )
        if len(x) and forest.trees:
            scores = np.mean([tree_values(tree, x) for tree in forest.trees], axis=0)
        else:
            scores = np.ones(len(x))
        counts, spans, redacted = [], [], []
        at = 0
        for t, c in zip(texts, found, strict=True):
            own = [(b, e, float(s)) for (b, e, _, _), s in zip(c, scores[at : at + len(c)], strict=True)]
            at += len(c)
            secret = [s for s in own if s[2] >= threshold]
            parts, last, chars, rows = [], 0, 0, []
            for begin, end, score in secret:
                chars += len(t[last:begin].decode(errors="replace"))
                size = len(t[begin:end].decode(errors="replace"))
                rows.append({"begin": chars, "end": chars + size, "score": score})
                chars += size
                parts += [t[last:begin], mask]
                last = end
            counts.append(len(c))
            spans.append(rows)
            redacted.append(b"".join([*parts, t[last:]]).decode(errors="replace") if secret else None)
        return counts, spans, redacted

    return lambda: scan


def scan_secrets(
    docs: DataFrame,
    forest: Forest,
    text: str = "text",
    threshold: float = 0.5,
    mask: str = "[SECRET]",
    name: str = "scan",
) -> DataFrame:
    """`docs` with a struct column: n_candidates, secrets (begin and end in code points, score) and
    redacted (the text with `mask` for each secret; null where there is none).

    Null and empty texts have no candidates. Equal texts get equal findings. Extra columns are kept;
    `name` gets underscores if it is taken.
    """
    return annotate(docs, text, SCANNED, _scanner(forest, threshold, mask.encode()), free_name(docs, name))


#: Findings whose label is plain from their form: issuers' key formats and assigned random strings,
#: against numbers, addresses and dated names.
PLAIN_SECRET = [
    r"^AKIA[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}$", r"^xox[abp]-[0-9A-Za-z-]{20,}$",
    r"^sk_(live|test)_[0-9A-Za-z]{16,}$", r"^AIza[0-9A-Za-z_-]{35}$",
]
PLAIN_OTHER = [r"^[0-9_/+-]+={0,2}$", r"^[A-Za-z]{3,}[_/-]?[0-9]{1,4}$", r"^[0-9]{1,4}[_/-]?[A-Za-z]{3,}$"]


def plain_label(value: Column, before: Column) -> Column:
    """1, 0 or null (not plain) for a finding."""
    secret = F.lit(False)
    for pattern in PLAIN_SECRET:
        secret = secret | value.rlike(pattern)
    assigned = before.rlike(r"""(?i)(password|passwd|pwd|secret|token|api[_-]?key)s?["']?\s*[:=]["']?$""")
    random = value.rlike(r"^[A-Za-z0-9+/_-]{16,}={0,2}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    other = F.lit(False)
    for pattern in PLAIN_OTHER:
        other = other | value.rlike(pattern)
    return F.when(secret | (assigned & random), 1).when(other & ~assigned, 0)


def plain_findings(docs: DataFrame, language: Language, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of `docs` with the label that their form gives away, for want of a table of labelled ones."""
    found = findings(docs, language, key, text)
    value, before = F.col("value").cast("string"), F.col("before").cast("string")
    return found.withColumn("label", plain_label(value, before)).filter(F.col("label").isNotNull())
