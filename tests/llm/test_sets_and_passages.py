"""Jaccard join, components, benchmark passages and mixing against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from letterloom.llm import decontaminate, jaccard, mixing
from letterloom.llm.components import components

DOCS = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups_of(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        if words:
            at, kind = rnd.randrange(len(words)), rnd.random()
            words[at : at + (kind < 0.7)] = [] if kind < 0.3 else [f"w{rnd.randrange(60)}"]
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    texts = ["", None, "  ", "a", "A", "a b c d", "a  b c\td", "x y z w v", "x y z w"]
    for _ in range(45):
        words = [f"w{rnd.randrange(60)}" for _ in range(rnd.choice([1, 4, 5, 6, 7, 8, 10, 15, 30, 60, 150, 400]))]
        words += common[: rnd.choice([0, 6, 10, 40])]
        for _ in range(rnd.choice([1, 2, 5, 10])):
            words = edited(rnd, words, rnd.choice([0, 1, 1, 2, len(words) // 40]))
            texts.append(" ".join(words))
    rnd.shuffle(texts)
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "a b c d")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == groups_of(rows)
    assert len(got) == len(rows)


def test_equal_cells_are_never_missed():
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.choice([4, 5, 6, 8, 9, 12, 17, 30, 33, 64, 65, 120, 300])
        a = {rnd.getrandbits(63) for _ in range(n)}
        b = set(a)
        for _ in range(rnd.randrange(max(1, n // 5) + 1)):
            if rnd.random() < 0.5 and len(b) > 1:
                b.discard(next(iter(b)))
            else:
                b.add(rnd.getrandbits(63))
        if 100 * len(a & b) >= 80 * len(a | b) and a != b:
            keys = [set(jaccard.cell_keys(np.array(sorted(s), np.uint64))[0].tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_large_group_and_empty_table(spark):
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(300)] + [(i, "same text here and there") for i in range(300, 600)]
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0, 300}
    assert jaccard.similar_groups(spark.createDataFrame([], DOCS)).collect() == []


def links_of(rows):
    """(id, number of other sets that are similar)."""
    sets = {i: shingles(t) for i, t in rows}
    kinds = set(sets.values()) - {frozenset()}
    near = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in kinds) for a in kinds}
    return {(i, near.get(s, 0)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [jaccard.BLOCK_SHINGLES, 600])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join([*base, f"end{i}"]) for i in range(40)] + ["", None, "a b", "a b", "same text here and there"]
    # chains, whose ends do not link, over a boundary of size bands
    for length in (20, 33, 64, 130):
        words = [f"v{length}x{i}" for i in range(length)]
        for k in range(30):
            words = edited(rnd, words, rnd.choice([0, 1, 2])) + [f"more{k}"] * (k % 2)
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = jaccard.similar_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.n_links) for r in got} == links_of(rows)
    assert {r.n_links for r in got if r.doc_id < 40} == {39}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == groups_of(rows)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}


def brute_passages(docs, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, u in items:
            v = words(u)
            for s in range(max(1, len(v) - window + 1)) if v and i is not None else []:
                part = v[s : s + window]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        found.add(str(i))
        ids = ",".join(sorted(found))
        flag = len(hit) > 0 and 20 * len(hit) >= len(w)
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), flag)
    return out


@pytest.mark.parametrize("block_words", [5, 1000])
def test_passages(spark, block_words):
    rnd = random.Random(4)
    draw = lambda n: " ".join(rnd.choice(["a", "b", "C", "É", "x9"]) for _ in range(n))
    items = [(1, draw(3)), (2, draw(9)), (10, draw(4)), (10, draw(5)), (None, draw(3)), (4, None), (5, "--")]
    docs = [(i, draw(rnd.choice([0, 2, 10, 80]))) for i in range(60)] + [(90, None), (91, items[1][1]), (91, items[1][1])]
    found = decontaminate.find_passages(
        spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", found string"),
        spark.createDataFrame(items, "item_id long, text string"), window=4, block_words=block_words,
    )
    got = found.select("doc_id", decontaminate.contamination("found_").alias("v")).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: tuple(r.v) for r in got} == brute_passages(docs, items, 4)


def test_passages_close_by(spark):
    docs = spark.createDataFrame([(1, "one x two three"), (2, "one two three"), (3, "three two one")], DOCS)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    hits = lambda slop: {r.doc_id for r in decontaminate.find_passages(docs, items, slop=slop).collect() if r.found.spans}
    assert hits(0) == {2} and hits(1) == {1, 2}
    none = decontaminate.find_passages(docs, items.limit(0)).collect()
    assert [r.found.spans for r in none] == [[], [], []]


def brute_copies(rows, alpha, seed=1):
    mass = {}
    for _, t, s in rows:
        mass[s] = mass.get(s, 0) + len(t or "") + 1
    weight = {s: m**alpha for s, m in mass.items()}
    out = {}
    for d, t, s in rows:
        rate = weight[s] / sum(weight.values()) * sum(mass.values()) / mass[s]
        draws = max(1, math.ceil(rate / 8))
        unit = str(d) if d is not None else "text " + hashlib.md5((t or "").encode()).hexdigest()
        n = 0
        for i in range(1, draws + 1):
            u = int(hashlib.md5(f"{seed}|{i}|{unit}".encode()).hexdigest()[:13], 16) / 2**52
            p = total = math.exp(-rate / draws)
            k = 0
            while total <= u and k < 60:
                k += 1
                p *= rate / draws / k
                total += p
                n += 1
        out[(d, t, s)] = n
    return out


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, "t" * rnd.randrange(50), "big" if i % 3 else "small") for i in range(300)]
    rows += [(1000, None, None), (None, "null key", "rare"), (1001, "", "rare")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", source string, copy int")
    got = mixing.mix_sources(docs, alpha=0.0).collect()
    counts = {}
    for r in got:
        counts.setdefault((r.doc_id, r.text, r.source), []).append(r.copy_)
    wanted = {k: n for k, n in brute_copies(rows, 0.0).items() if n}
    assert {k: len(v) for k, v in counts.items()} == wanted
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in counts.values())
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    weights = spark.createDataFrame([("big", 1.0), ("rare", None)], "source string, weight double")
    assert {r.source for r in mixing.mix_sources(docs, weights=weights).collect()} == {"big"}
