"""Ranked search against plain Python, with blocks that are skipped, ties, odd rows and several blocks of queries."""

import collections
import math
import random
import re

import numpy as np
import pytest
from compare import database, difference, spark_rows, sql_rows

from letterloom.llm import oracles, queries, ranked_search
from letterloom.llm.common import WordHashes

DOCS = "doc_id long, text string"
ITEMS = "item_id int, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score) by reading every document for every item."""
    counted = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(size for _, _, size in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in counted:
            m = 100 - 75 + 75 * size * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms_of(text)
                if t in c
            )
            if score > 0:
                found.append((-score, i is None, i))
        best = sorted(found)[:k]
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n, words=80):
    """Texts of a few topics, with words of very different frequency, and copies."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        topic = rnd.randrange(5)
        pool = [f"Topic{topic}x{j}" for j in range(40)] + ["the"] * 40 + ["of"] * 20 + [f"w{j}" for j in range(words)]
        rows.append((i, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 120)))))
    rows += [(n + j, rows[3][1]) for j in range(n // 3)]  # a third are copies of one
    return rows


@pytest.mark.parametrize(("shard", "block"), [(2_000, 4), (20_000, 8), (1 << 20, 64)])
def test_same_as_reading_all(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "FIRST", 3)
    docs = corpus(1, 240)
    items = [(i, " ".join(t.split()[:30])) for i, t in docs[::20]] + [(900, "the of"), (901, "w1 w1 THE"), (902, "absent")]
    got = ranked_search.search(
        spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), shard_bytes=shard, block_words=200
    )
    assert rows_of(got) == brute(docs, items)


def test_blocks_are_skipped():
    hashes = WordHashes()
    docs = corpus(2, 3000)
    found = [ranked_search.word_hashes(t.encode(), hashes) for _, t in docs]
    (row,) = ranked_search._rows(ranked_search._forward(0, [i for i, _ in docs], found))
    counts = [collections.Counter(f[:12].tolist()) for f in found[:40]]
    terms = np.unique(np.array([h for c in counts for h in c], np.uint64))
    cols = [np.searchsorted(terms, np.array(sorted(c), np.uint64)) for c in counts]
    times = [np.array([c[h] for h in sorted(c)]) for c in counts]
    asked = ranked_search.Queries(list(range(40)), terms, cols, times)
    df = [sum(t in set(f.tolist()) for f in found) for t in terms.tolist()]
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * d + 1))) for d in df])
    stats = ranked_search.Statistics(len(docs), sum(map(len, found)), weights)
    axes = np.random.default_rng(0).choice(np.array([-1, 1], np.float32), (len(terms), ranked_search.DIRECTIONS))
    made = ranked_search.block_shard(row, terms, ranked_search.asked_together(asked), stats, axes)
    shard = ranked_search.Shard(next(ranked_search._rows(ranked_search._lists(ranked_search.BLOCKED, [made]))), weights)
    lists = 0
    for c, n in zip(cols, times, strict=True):
        factor = np.zeros(len(terms), np.int64)
        factor[c] = n * weights[c]
        scores = shard.scores(np.arange(len(shard.row["ids"])), factor)
        order = np.lexsort((shard.row["ids"], -scores))[:10]
        before = shard.read
        ids, best = shard.search(c, n, 10, 1)
        lists += shard.read - before
        assert best.tolist() == scores[order].tolist() and ids.tolist() == shard.row["ids"][order].tolist()
        # bounds hold for every document of every block
        row = shard.row
        for place, t in enumerate(row["list_terms"].tolist()):
            if t >= 0 and factor[t]:
                blocks = np.arange(row["list_ends"][place - 1] if place else 0, row["list_ends"][place])
                for b, bound in zip(blocks, shard.bounds(blocks, factor), strict=True):
                    inside = row["docs"][row["block_ends"][b - 1] if b else 0 : row["block_ends"][b]]
                    assert scores[inside].max() <= bound
    assert lists < 0.7 * 40 * len(docs)


def test_odd_rows(spark):
    long = "start " + "filler words, " * 200_000 + "needle"
    docs = [(1, None), (2, ""), (3, "!!! --"), (4, "One two; ÜBER two"), (4, "One two; ÜBER two"), (4, "one"),
            (None, "one two"), (None, None), (7, long), (8, "x" * 3_000_000 + " needle")]
    items = [(1, "one TWO"), (2, None), (3, ""), (4, "über ÜBER"), (5, "needle start"), (5, "zz other text"), (None, "two"), (6, "...")]
    kept = [items[0], items[3], (5, "needle start"), items[6]]
    clash = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS shard", "'a' AS id", "2 AS score")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "7 AS number", "'b' AS item")
    assert rows_of(ranked_search.search(clash, asked)) == brute(docs, kept)
    assert rows_of(ranked_search.search(clash.limit(0), asked)) == []
    assert rows_of(ranked_search.search(clash, asked.limit(0))) == []


def test_long_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "LONG_QUERY", 10)
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    docs = corpus(4, 100)
    items = [(1, " ".join(t for _, t in docs[:6])), (2, "w1 the")]
    got = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert rows_of(got) == brute(docs, items)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = spark_rows(queries.op12_ranked_search(spark, folder))
    assert difference(got, sql_rows(database(folder), oracles.STATEMENTS["op12_ranked_search"])) == ""
