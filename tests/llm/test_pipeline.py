"""The registered queries against their SQL, and the pipeline stage by stage."""

import collections
import itertools
import random

import corpus_pipeline
import pytest
from compare import database, difference, spark_rows, sql_rows

from letterloom.llm import oracles, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.STATEMENTS))
def test_queries_with_sql(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, FOLDER))
    assert difference(got, sql_rows(database(FOLDER), oracles.STATEMENTS[name])) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        assert kept <= ids and len(kept) >= 0.7 * len(ids), name


def test_empty_tables_and_extra_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(3).selectExpr("*", "1 AS score", "'x' AS found", "2 AS n", "'y' AS class_id")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, rows, FOLDER)
            assert after.columns[: len(docs.columns)] == docs.columns
            assert after.count() >= 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n):
    return " ".join(f"{rnd.choice('bcdfgl')}{rnd.choice('aeiou')}{rnd.choice('mnprst')}{rnd.randrange(60)}" for _ in range(n))


def changed(rnd, text, times):
    """Copies of a text with some of its last words replaced."""
    parts = text.split()
    return " ".join([*parts[: len(parts) - times], *(f"new{rnd.randrange(10**6)}" for _ in range(times))])


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_copies(rows):
    """The rows that stay: the first by id of each group, found by comparing all pairs."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(r[1]) for r in rows]
    for x, y in itertools.combinations(range(len(rows)), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            parent[root(x)] = root(y)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(1)
    base = [words(rnd, n) for n in (60, 60, 60, 80, 3)]
    rows = [(1, base[0], "s"), (1, base[0], "s"), (2, base[0], "s"), (2, base[1], "s"), (None, base[1], "t"),
            (None, changed(rnd, base[1], 4), "t"), (3, changed(rnd, base[2], 2), "s"), (4, base[2], "s"), (5, base[4], "s"),
            (6, base[4].upper(), "s"), (7, None, "s"), (7, None, "s"), (8, "", "s"), (9, changed(rnd, base[2], 30), "s")]
    for i in range(10, 70):  # a third of the rows are near copies of one text
        rows.append((i, changed(rnd, base[3], rnd.randrange(6)) if i % 3 == 0 else words(rnd, rnd.randrange(1, 70)), "s"))
    got = corpus_pipeline.drop_near_copies(spark, table(spark, rows).repartition(5), FOLDER)
    mine = sorted(((r.doc_id, r.source) for r in got.collect()), key=str)
    assert mine == sorted(((i, s) for i, _, s in brute_copies(rows)), key=str)
    texts = {r.text for r in got.collect()}
    assert base[1] in texts and base[0] in texts  # the clean text of id 2 is not lost with its copy


def test_the_whole_run_on_planted_rows(spark, tmp_path):
    rnd = random.Random(2)
    item = words(rnd, 40)
    secret = "password=" + "".join(rnd.choice("0123456789abcdef") for _ in range(32))
    rows, marks = [], []
    for i in range(400):
        toxic = i % 8 == 0
        text = words(rnd, 50).split()
        if toxic:
            text[rnd.randrange(50)] = rnd.choice(["nasty", "vile"])
        rows.append((i, " ".join(text), f"s{i % 3}"))
        marks.append((i, 1, int(toxic)))
    copied = {400 + j: 3 + 8 * (j // 4) for j in range(40)}  # near copies of clean texts
    rows += [(i, changed(rnd, rows[of][1], 1), "s0") for i, of in copied.items()]
    rows += [(500 + j, f"{words(rnd, 20)} {item} {words(rnd, 20)}", "s1") for j in range(10)]
    rows += [(600 + j, f"{words(rnd, 30)} {secret[:-2]}{j % 10:02d} {words(rnd, 30)}", "s2") for j in range(10)]
    rows += [(700, None, "s0"), (701, "", "s0")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    after = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        after[name] = collections.Counter(r.doc_id for r in docs.collect())
    clean = [i for i in range(400) if i % 8]
    assert not any(after["toxicity"][i] for i in range(0, 400, 8)) and all(after["toxicity"][i] for i in clean)
    kept = brute_copies([r for r in rows if after["toxicity"][r[0]]])
    assert after["near_copies"] == collections.Counter(r[0] for r in kept)
    assert not any(after["near_copies"][i] for i in copied)
    assert [i for i in after["near_copies"] if not after["decontamination"][i]] == list(range(500, 510))
    assert after["secrets"] == after["decontamination"]
    assert not any(secret[10:20] in (r.text or "") for r in docs.collect())
    assert {r.doc_id: r.text for r in docs.collect() if r.doc_id in clean and r.doc_id < 400} == {
        i: t for i, t, _ in rows if after["mixing"][i] and i in clean and i < 400
    }
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(r.doc_id for r in again.collect()) == after["mixing"]
