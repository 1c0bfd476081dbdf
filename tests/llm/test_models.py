"""Language model, language identification, toxicity, token counts, secrets, neighbours, main text."""

import collections
import math
import random

import numpy as np
import pytest

from letterloom.llm import (
    extraction,
    langid,
    language_model,
    neighbours,
    secrets,
    token_counts,
    toxicity,
)

DOCS = "doc_id long, text string"


def corpus(seed, n=60):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice("aaaabbbcd") + rnd.choice(["", "x"]) for _ in range(rnd.randrange(30)))) for i in range(n)]


def test_arcs_of_a_state_sum_to_one(spark):
    model = language_model.train(spark.createDataFrame(corpus(1), DOCS), share=0.01).model
    automaton = language_model.Automaton(model)
    rare = float(language_model.root_probabilities(np.array([0]), model.tokens, model.kinds)[0])
    left = 1 - sum(model.orders[0].p) - rare
    for w in [[], ["a"], ["a", "b"], ["bx", "a"]]:
        before = automaton.read([x.encode() for x in w], {})
        each = [10 ** (automaton.read([*(x.encode() for x in w), v], {}) - before) for v in model.words]
        unknown = 10 ** (automaton.read([*(x.encode() for x in w), b"?"], {b"?": math.log10(rare + max(left, 0))}) - before)
        assert sum(each) + unknown == pytest.approx(1, abs=1e-6)


def test_scores(spark):
    rows = [*corpus(2), (70, None), (71, ""), (72, "never seen words"), (72, "never seen words")]
    docs = spark.createDataFrame(rows, DOCS)
    got = language_model.score_texts(docs, language_model.train(docs.filter("doc_id < 60"))).collect()
    tokens = lambda t: [*(t or "").split(), ""]
    counts = collections.Counter(w for i, t in rows if i < 60 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        r = by[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(w in counts for w in tokens(t)), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    empty = docs.limit(0)
    assert language_model.score_texts(empty, language_model.train(empty)).collect() == []
    assert all(math.isfinite(r.score) for r in language_model.score_texts(docs, language_model.train(empty)).collect())


def brute_backoff(train, text, least=2, discount=0.7):
    """log10 probability by counts of all n-grams of up to three words seen `least` times."""
    seen = collections.Counter()
    for t in train:
        for i in range(len(t)):
            seen.update(tuple(t[i - n + 1 : i + 1]) for n in (1, 2, 3) if i - n + 1 >= 0)
    tokens = sum(c for g, c in seen.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in seen)
    after = collections.defaultdict(list)
    for g, c in seen.items():
        if len(g) > 1 and c >= least:
            after[g[:-1]].append(g)

    def kept(g):
        return (seen[g] - discount) / (seen[g[:-1]] if len(g) > 1 else tokens)

    def p(g):
        if len(g) == 1:
            return kept(g) if g in seen else discount * kinds / tokens
        if seen[g] >= least:
            return kept(g)
        rest = after.get(g[:-1], [])
        return (1 - sum(map(kept, rest))) / (1 - sum(kept(h[1:]) for h in rest)) * p(g[1:])

    return sum(math.log10(p(tuple(text[max(0, i - 2) : i + 1]))) for i in range(len(text)))


def test_ngrams_seen_twice_count_at_any_size(spark, monkeypatch):
    # "left right here" is seen twice in 400,000 tokens and more, 5e-6 of which are over two
    rnd = random.Random(4)
    filler = [" ".join(f"w{rnd.randrange(300)}" for _ in range(200)) for _ in range(2600)]
    texts = [*filler, "far left right here", "so left right here too", "left right"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    asked = ["left right here", "w1 left right here too", "right here", "never left", "", filler[0]]
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 300)
    got = language_model.score_texts(spark.createDataFrame(list(enumerate(asked)), DOCS), language_model.train(docs))
    read = [[*t.split(), ""] for t in texts]
    for r in got.collect():
        assert r.score == pytest.approx(brute_backoff(read, [*asked[r.doc_id].split(), ""])), asked[r.doc_id]


def brute_bits(train, text):
    k = langid.ORDER
    seen = collections.defaultdict(collections.Counter)
    for t in train:
        t = b"\0" * k + t
        for i in range(k, len(t)):
            for size in range(k + 1):
                seen[t[i - size : i]][t[i]] += 1
    total, t = 0.0, b"\0" * k + text
    for i in range(k, len(t)):
        for size in range(k, -1, -1):
            here = seen.get(t[i - size : i])
            if here is None:
                continue
            n, d = sum(here.values()), len(here)
            if here[t[i]]:
                total += math.log2((n + d) / here[t[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths():
    train = [b"the cat sat", b"the hat", "für".encode()]
    tree = langid.grow(train)
    for text in (b"the cat", b"zzz", "über the".encode(), b""):
        codes, _ = langid.strings([text])
        assert langid.code_bits(tree, codes).sum() == pytest.approx(brute_bits(train, text))


def test_languages(spark):
    rows = [(i, t, lang) for i in range(30) for t, lang in (("the cat and the hat", "en"), ("der hund und die katze", "de"))]
    trees = langid.learn(spark.createDataFrame(rows + [(99, "x", None)], DOCS + ", lang string"))
    docs = [(1, "and the cat"), (2, "und der hund"), (3, None), (4, ""), (5, "123 ½ !!"), (6, "the " * 50_000)]
    got = {r.doc_id: r.language for r in langid.predict_language(spark.createDataFrame(docs, DOCS), trees).collect()}
    assert [got[i].lang for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [r.language.lang for r in langid.predict_language(spark.createDataFrame(docs[:1], DOCS), {}).collect()] == ["und"]


@pytest.mark.parametrize(("hot", "density"), [(0, 0.2), (8, 0.2), (1024, 0.2), (8, 0.02)])
def test_nearest_examples_are_exact(monkeypatch, hot, density):
    monkeypatch.setattr(toxicity, "HOT_LISTS", hot)
    rng = np.random.default_rng(0)
    weights = rng.random((700, 60)) * (rng.random((700, 60)) < density)
    weights[:, :4] *= 20  # some heavy terms, so that blocks are left out
    weights = weights[weights.any(axis=1)]
    weights = (weights / np.linalg.norm(weights, axis=1, keepdims=True))[np.argsort(weights.argmax(axis=1), kind="stable")]
    weights[50:60] = weights[50]
    rows, columns = np.nonzero(weights)
    lists = toxicity.arranged(columns, rows, weights[rows, columns], 61, len(weights))
    asked = []
    for _ in range(300):
        terms = np.sort(rng.choice(61, 3, replace=False))
        q = rng.random(3)
        asked.append((terms, q / np.linalg.norm(q)))
    for (terms, q), (found, cosines) in zip(asked, toxicity.nearest(lists, toxicity.frequent_lists(lists), asked, 7), strict=True):
        whole = np.hstack([weights, np.zeros((len(weights), 1))])[:, terms] @ q
        best = [i for i in np.lexsort((np.arange(len(whole)), -whole.round(12)))[:7] if whole[i] > 0]
        assert np.allclose(cosines, whole[best], atol=1e-6) and np.allclose(whole[found], cosines, atol=1e-6)
        assert found.tolist() == best


def test_toxicity(spark):
    rnd = random.Random(6)
    words = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        text = words(40)
        if i % 4 == 0:
            text[rnd.randrange(40)] = rnd.choice(["nasty", "vile"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    labels += [(3, None), (8000, 1)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.train(docs, marks.filter("doc_id % 3 <> 1 or toxic is null"), z=4.0)
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "so nasty"), (902, "so nasty")], DOCS)
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs.unionByName(extra), index).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    assert got[900].score == got[901].score < 0.3 and got[902].predicted == 1
    assert {r.toxicity.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, marks.limit(0))).collect()} == {0.0}


def test_copies_of_a_toxic_passage_meet_their_twins(spark):
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(25)]
    rows = [(i, " ".join([*words(10), *(passage if i % 4 == 0 else words(25)), *words(10)])) for i in range(240)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240) if i % 3 != 1], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, marks)).collect()
    assert all(r.toxicity.predicted == (r.doc_id % 4 == 0) for r in got)
    assert all(len(r.toxicity.neighbours) == 15 for r in got)


def brute_pieces(pieces, word):
    unknown, text = min(pieces.values()) - 10, "▁" + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        ways = [(best[s][0] + pieces[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in pieces]
        if text[end - 1] not in pieces:
            ways.append((best[end - 1][0] + unknown, best[end - 1][1] - len(text[end - 1].encode())))
        best.append(max(ways))
    return -best[-1][1]


def test_token_counts(spark):
    rnd = random.Random(7)
    pieces = {p: -rnd.random() * 5 for p in ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "bab", "aab", "▁b"]}
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 12))) for _ in range(300)] + ["ab" * 500]
    docs = [(1, " ".join(words)), (2, None), (3, " \n"), (4, words[-1]), (4, words[-1])]
    got = {r.doc_id: r.tokens for r in token_counts.count_tokens(spark.createDataFrame(docs, DOCS), pieces).collect()}
    assert got[1].n_tokens == sum(brute_pieces(pieces, w) for w in words)
    assert (got[2].n_tokens, got[3].n_words, got[4].n_tokens) == (0, 0, brute_pieces(pieces, words[-1]))


def test_secrets(spark):
    rnd = random.Random(8)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(120):
        rows += [(4 * i, f"see token = \"{hexa(40)}\" here"), (4 * i + 1, f"call 030{rnd.randrange(10**9):010d} now"),
                 (4 * i + 2, f"é password={hexa(18)} x"), (4 * i + 3, "plain words only")]
    rows += [(900, None), (901, ""), (902, "w " * 100_000)]
    docs = spark.createDataFrame(rows, DOCS)
    language = secrets.learn_language(docs)
    forest = secrets.train_forest(secrets.plain_findings(docs, language), language, n_trees=8)
    got = {r.doc_id: (r.text, r.scan) for r in secrets.scan_secrets(docs, forest).collect()}
    for i, (text, scan) in got.items():
        found = [text[s.begin : s.end] for s in scan.secrets]
        wanted = {0: 1, 1: 0, 2: 1, 3: 0}[i % 4] if i < 900 else 0
        assert len(found) == wanted
        if found:
            assert scan.redacted == text.replace(found[0], "[SECRET]") and len(found[0]) in (18, 40)
        else:
            assert scan.redacted is None
    none = secrets.train_forest(secrets.plain_findings(docs.limit(0), language), language)
    assert none.trees == [] and secrets.scan_secrets(docs.limit(0), none).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(500 + i, data[0].tolist()) for i in range(30)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (1004, [1.0])]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"), k=5).collect()
    ids, whole = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in [i for i in ids if i % 20 == 0]:
        scores = (whole * whole[list(ids).index(q)]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:5]
        found = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert found == [(n + 1, ids[i]) for n, i in enumerate(order)]
    assert {r.query_id for r in got} == {int(i) for i in ids if i % 20 == 0}
    assert neighbours.search(vectors.limit(0), vectors.limit(0)).collect() == []


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(10)
    data = rng.normal(size=(6000, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), least=100)
    found = {(r.query_id, r.vec_id) for r in got.collect()}
    hit = 0
    for q in range(0, 6000, 100):
        scores = data @ data[q]
        scores[q] = -np.inf
        hit += sum((q, int(i)) in found for i in np.argsort(-scores)[:20])
    assert hit >= 0.9 * 60 * 20


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu, one</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many cookies, all of them, always.</p></div>
<div id=content><article><h1>Head &amp; line</h1><p>First, para&shy;graph with   some text, and more.
<p><b>Bold<br>second.</p><ul><li>item one<li>item two</ul><blockquote>Quote &lt;x&gt;.</blockquote>
<div class="ad">Buy, now, all, of, it.</div><form><p>Name, mail</p></form></article>
<aside><p>Aside, text, with, many, commas, in, it.</p></aside></div>
<section class="comments"><p>Reader, comment, with, lots, of, commas, and words and words.</p></section>
<footer><p>&copy; footer, text, here</p></footer></body></html>"""


def test_main_text():
    assert extraction.main_text(PAGE).replace("\xad", "") == (
        "Head & line\nFirst, paragraph with some text, and more.\nBold second.\nitem one\nitem two\nQuote <x>."
    )
    no_article = "<body><div class=menu><a href=x>a, b, c</a></div><div><h2>T</h2><p>" + "Some words, more. " * 9 + "</p><p>Short.</p></div></body>"
    assert extraction.main_text(no_article).split("\n")[::2] == ["T", "Short."]
    assert extraction.main_text("") == "" and extraction.main_text("<script>x") == ""
    assert extraction.main_text("just words") == "just words"
    assert extraction.main_text("<p>" * 3000 + "deep" + "<div>" * 3000) == "deep"


def test_main_text_of_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 2), (3, "u", "", 3)], "page_id long, url string, html string, main int")
    got = {r.page_id: r.main_ for r in extraction.extract_text(pages).collect()}
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text) > 50
