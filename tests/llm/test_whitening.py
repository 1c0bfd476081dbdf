"""Whitened vectors against numpy, exact sums, and rows that cannot or need not be like the others."""

import math

import numpy as np
import pytest

from letterloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(df):
    return sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in df.collect()), key=str)


def brute(vectors, components=8):
    """(n, deviations, whitened up to sign, explained) by numpy, from vectors of one length."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, ((n * x.astype(object) - s) ** 2).sum(1), (x - s / n) @ u / np.sqrt(e), e / np.trace(np.cov(x.T, bias=True))


@pytest.mark.parametrize("least", [1, 1 << 16])
def test_same_as_numpy(spark, monkeypatch, least):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", (least, 1 << 22))
    monkeypatch.setattr(whitening, "BLOCKS", 30)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 12)) * np.arange(1, 13) + 5
    vectors[100:200] = vectors[0]  # a third of the rows is one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(7)
    got = rows_of(whitening.whiten(df))
    n, deviations, whitened, explained = brute(vectors)
    assert len(got) == 300 * 8
    by = {(i, c): r for i, c, *r in got}
    for c in range(1, 9):
        mine = np.array([by[i, c][2] for i in range(300)])
        assert np.allclose(mine, whitened[:, c - 1]) or np.allclose(mine, -whitened[:, c - 1])
        assert by[0, c][3] == pytest.approx(explained[c - 1])
        assert 0 <= by[0, c][4] < 1e-9
    assert all(by[i, 1][:2] == [n, deviations[i]] for i in range(300))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.5, 0.0]), (4, [0.5]), (5, []),
            (6, None), (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, inf])]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA + ", n int, index string")
    got = rows_of(whitening.whiten(df))
    assert sorted({(str(r[0]), r[1]) for r in got}) == sorted((i, c) for i in ("1", "2", "4", "5", "None") for c in (1, 2))
    assert len(got) == 12 and {r[2] for r in got} == {6}
    _, deviations, _, _ = brute([[1, 2], [2, 1], [2, 1], [0.5, 0], [0.5, 0], [0, 0]])
    assert sorted(r[3] for r in got if r[1] == 1) == sorted(deviations)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [3.0, 4.0])], [(i, [3.0, 4.0]) for i in range(5)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_no_rank(spark):
    # the second dimension is twice the first, so there is one component
    got = rows_of(whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(10)], SCHEMA)))
    assert len(got) == 10 and {r[1] for r in got} == {1}
    assert got[0][5] == pytest.approx(1)


def test_large_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e9, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r[0], r[1]): r for r in rows_of(whitening.whiten(df))}
    assert got[1, 1][3] is None  # beyond a long
    assert math.isfinite(got[1, 1][4])
    df = spark.createDataFrame([(1, [2e5, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0])], SCHEMA)
    assert {r[0]: r[3] for r in rows_of(whitening.whiten(df))} == dict(
        zip((1, 2, 3), brute([[2e5, 0], [0, 1], [5, 2]], 2)[1], strict=True)
    )
