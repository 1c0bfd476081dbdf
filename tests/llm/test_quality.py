"""Passages against plain Python, gradients against differences, and labels that can be learned."""

import math
import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from letterloom.llm import quality
from letterloom.llm.common import WordHashes

DOCS = "doc_id long, text string"


def brute_rows(text):
    """The features of a text of one segment, passage by passage."""
    white = set(quality.WHITE)
    text += b"\n"
    begins = [i for i, b in enumerate(text) if b not in white and (i == 0 or text[i - 1] in white)]
    cuts = [0, *begins[quality.PASSAGE_WORDS :: quality.PASSAGE_WORDS], len(text)]
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        row = [0.0] * quality.WIDTH
        pairs = [(quality.KINDS[text[i]], quality.KINDS[text[i + 1]]) for i in range(a, min(b, len(text) - 1))]
        for x, y in pairs:
            row[int(x) * quality.N_KINDS + int(y)] += 1
        row = [math.sqrt(v / max(1, len(pairs))) for v in row]
        words = text[a:b].lower().split()
        n = max(1, len(words))
        base = quality.N_KINDS**2
        for w in words:
            row[base + xxh64_intdigest(w) % quality.BUCKETS] += 1 / n
        row[base:-5] = [math.sqrt(v) for v in row[base:-5]]
        row[-5:] = [
            math.log1p(len(words)),
            math.log1p(sum(map(len, words)) / n),
            len(set(words)) / n,
            sum(x == y for x, y in zip(words, words[1:], strict=False)) / n,
            math.log1p(b - a),
        ]
        rows.append(row)
    return rows


def test_passages():
    rnd = random.Random(3)
    texts = [b"", b"   ", b"\n one", "Ünder  a |b| 12.5\t!!\n".encode() * 30]
    texts += [" ".join(rnd.choice(["the", "The", "42", "a,b", "x" * 40, "\n"]) for _ in range(n)).encode() for n in (1, 63, 64, 65, 128, 300)]
    x, sizes = quality.passage_features(texts, WordHashes())
    want = [brute_rows(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert np.allclose(x, np.concatenate(want), atol=1e-6)


def test_long_texts_are_read_whole(monkeypatch):
    text = b"some words and more of them " * 3000
    whole, _ = quality.passage_features([text], WordHashes())
    assert len(quality.segments(text, 10_000)) > 8 and b"".join(quality.segments(text, 10_000)) == text
    assert quality.segments(b"x" * 25, 10) == [b"x" * 10, b"x" * 10, b"x" * 5]
    monkeypatch.setattr(quality, "SEGMENT_BYTES", 1000)
    monkeypatch.setattr(quality.segments, "__defaults__", (1000,))
    cut, sizes = quality.passage_features([b"", text, b"x"], WordHashes())
    assert np.expm1(cut[:, -5]).sum() == pytest.approx(np.expm1(whole[:, -5]).sum() + 1)
    assert sizes[0] == sizes[2] == 1


def loss(p, x, sizes, y, weight):
    q = quality.forward(p, x, sizes)["p"]
    return -(weight * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / weight.sum()


def test_gradients():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 3, 2, 5])
    x, y, weight = rng.normal(size=(11, 6)), np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 0.5, 1])
    p = quality.new_layers(6, 4, 3)
    found = quality.gradients(p, x, sizes, y, weight)
    for k, v in p.items():
        for at in np.ndindex(v.shape):
            up, down = ({**p, k: v.copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (loss(up, x, sizes, y, weight) - loss(down, x, sizes, y, weight)) / 2e-5
            assert found[k][at] == pytest.approx(slope, abs=1e-7)


def test_score_is_that_of_the_weighted_passages():
    rng = np.random.default_rng(1)
    p, sizes = quality.new_layers(5, 4, 3), np.array([2, 1, 4])
    x = rng.normal(size=(7, 5))
    got = quality.forward(p, x, sizes)
    at = 0
    for b, n in enumerate(sizes):
        h = [np.tanh(r @ p["W"] + p["b"]) for r in x[at : at + n]]
        e = [math.exp((np.tanh(v @ p["V"]) / (1 + np.exp(-v @ p["U"]))) @ p["w"]) for v in h]
        z = sum(w * v for w, v in zip(e, h, strict=True)) / sum(e)
        assert got["p"][b] == pytest.approx(1 / (1 + math.exp(-(z @ p["c"] + p["d"][0]))))
        at += n


def planted(n=240):
    """Texts of many clean passages; a bad one has one passage of repeated words somewhere."""
    rnd = random.Random(5)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(n):
        passages = [" ".join(rnd.choices(vocabulary, k=64)) for _ in range(rnd.randrange(1, 8))]
        if i % 4 == 0:
            passages.insert(rnd.randrange(len(passages) + 1), " ".join([rnd.choice(vocabulary)] * 64))
        rows.append((i, " ".join(passages), int(i % 4 != 0)))
    return rows


def test_one_bad_passage_is_found(spark):
    rows = planted()
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:160]], "doc_id long, quality int")
    model = quality.train(docs, labels)
    more = spark.createDataFrame(
        [*(r[:2] for r in rows), (900, None), (901, ""), (None, "word1"), (902, "word1 " * 100_000), (902, "word1 " * 100_000)],
        DOCS,
    ).selectExpr("*", "1 AS quality", "'x' AS score")
    scored = quality.score_quality(more, model)
    assert scored.columns == ["doc_id", "text", "quality", "score", "quality_"]
    got = [(r.doc_id, r.quality_) for r in scored.collect()]
    assert len(got) == len(rows) + 5
    by = dict(got)
    held = [(i, y) for i, _, y in rows[160:]]
    assert sum(by[i].predicted == y for i, y in held) >= 0.95 * len(held)
    for i, text, y in rows[160:]:
        if not y and by[i].predicted == 0:
            words = text.split()[64 * by[i].top_passage :][:64]
            assert len(set(words)) < 60  # evidence is the bad passage
    assert all(0 <= s.score <= 1 for _, s in got)
    assert by[900] == by[901] and by[900].n_passages == 1
    twice = [s.score for i, s in got if i == 902]
    assert twice[0] == twice[1]
    assert by[902].predicted == 0 and by[902].n_passages >= 100_000 // 64


def test_bounds_ties_and_missing_labels(spark):
    rows = planted(40)
    docs = spark.createDataFrame([(str(i), t) for i, t, _ in rows] + [(None, "x"), ("3", "twice")], "doc_id string, text string")
    good = [(str(i), y) for i, _, y in rows]
    odd = [("1", 0), ("1", 1), ("2", None), (None, 1), ("none", 1), ("3", 7)]
    labels = spark.createDataFrame(good[4:] + odd, "doc_id string, quality int")
    model = quality.train(docs, labels, per_class=5, passages_per_doc=2)
    again = quality.train(docs.repartition(5), labels.repartition(3), per_class=5, passages_per_doc=2)
    assert all(np.array_equal(model.layers[k], again.layers[k]) for k in model.layers)
    one = quality.train(docs, labels.filter("quality = 1"))
    none = quality.train(docs.limit(0), labels)
    assert (one, none) == (1.0, 0.5)
    assert {r.quality.score for r in quality.score_quality(docs, one).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), model).collect() == []
