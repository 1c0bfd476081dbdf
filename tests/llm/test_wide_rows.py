"""Shards are rows of megabytes: a task holds a few of them, however many its part of the texts has."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from letterloom.llm.common import WordHashes
from letterloom.llm.language_model import _count_grams, join_codes, pack, suffixes, unpack, word_codes
from letterloom.llm.ranked_search import index_texts
from test_round_three_matching import plan_of


def test_shards_are_written_in_small_groups(spark):
    words = "array_join(transform(sequence(1, 300000), x -> hex(xxhash64(id, x))), ' ') AS text"
    docs = spark.range(0, 4, 1, 1).selectExpr("id AS doc_id", words)
    shards = index_texts(docs, shard_bytes=1 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in shards.inputFiles()]
    assert shards.count() == sum(groups) == 4


def test_packed_ngrams_are_counted_as_they_are():
    rng = np.random.default_rng(3)
    prefix, suffix = (rng.integers(0, 1 << 64, 1000, np.uint64) for _ in range(2))
    codes = np.sort(join_codes(prefix, suffix))
    by_code = np.argsort(join_codes(prefix, suffix))
    assert (suffixes(codes, prefix[by_code]) == suffix[by_code]).all()
    counts = rng.integers(1, 1 << 40, 1000)
    for got, want in zip(unpack(pack(codes, prefix[by_code], counts)), (codes, prefix[by_code], counts), strict=True):
        assert (got == want.astype(np.uint64)).all()


def test_ngrams_cross_the_shuffle_packed(spark):
    words = [f"w{i}" for i in range(50)]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, 40)) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seen: Counter = Counter()
    for t in texts:
        own = [w.encode() for w in (t or "").split()] + [b""]
        seen.update(tuple(own[i : i + n]) for n in (2, 3) for i in range(len(own) - n + 1))
    grams = _count_grams(docs, "text", 3, 8000, 2)
    assert "Exchange hashpartitioning(part" in plan_of(grams)

    def code(words):
        own = word_codes(list(words), WordHashes())
        return own[0] if len(own) == 1 else join_codes(code(words[:-1]), code(words[1:]))

    want = {(len(g), *(int(np.int64(np.uint64(x).view(np.int64))) for x in (code(g[:-1]), code(g[1:]), code(g))), n) for g, n in seen.items() if n > 1}
    assert {(r.level, r.prefix, r.suffix, r.code, r.n) for r in grams.collect()} == want
