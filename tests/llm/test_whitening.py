"""Whitening next to plain numpy in double precision."""
import math

import numpy as np
import pytest

from spanloom.llm.whitening import eigen, refine, whitened

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=np.float64)
    n, centred = len(x), x - x.mean(axis=0)
    value, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, centred, value[::-1], vectors[:, ::-1]


def check(got, ids, vectors, k):
    x, centred, value, basis = plain(vectors)
    n, ints = len(x), x.astype(int).astype(object)
    deviation = ((ints * n - ints.sum(axis=0)) ** 2).sum(axis=1)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(table) == n * k
    for c in range(k):
        w = centred @ basis[:, c] / math.sqrt(value[c])
        mine = np.array([table[i, c + 1].whitened for i in ids])
        assert min(np.abs(w - mine).max(), np.abs(w + mine).max()) < 1e-6
    for i, d in zip(ids, deviation):
        assert table[i, 1].deviation == (d if d < 1 << 63 else None) and table[i, 1].n == n
    assert {round(r.explained / (value[r.component - 1] / value.sum()), 9) for r in got} == {1.0}
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


def test_rows_match_plain_numpy(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = whitened(spark.read.parquet(f"{small}/embeddings.parquet")).collect()
    check(got, [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_few_dimensions_and_large_entries(spark):
    rng = np.random.default_rng(4)
    for size in (1.0, 2e4, 3e5):
        vectors = [[float(np.float32(c)) for c in size * rng.normal(size=5) * [1, 2, 3, 4, 5]] for _ in range(300)]
        got = whitened(spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(7)).collect()
        check(got, list(range(300)), vectors, 5)


def test_clustered_eigenvalues():
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to the last bit
        q = q @ (1.5 * np.eye(40, dtype=np.longdouble) - 0.5 * (q.T @ q))
    value = np.concatenate(([5, 5 + 1e-9, 5 + 3e-9, 2, 2, 2], 1 + np.arange(10) * 1e-7, np.linspace(3, 4, 24))).astype(np.longdouble)
    a = (q * value) @ q.T
    a = (a + a.T) / 2
    got, x = eigen(a)
    assert np.max(np.abs(x.T @ x - np.eye(40))) < 1e-16
    assert np.max(np.abs(a @ x - x * got)) < 1e-15
    assert np.max(np.abs(got - np.sort(value)[::-1])) < 1e-15
    apart = np.argsort(-value)[:3]  # the cluster around 5 is told apart
    assert np.max(np.abs(np.abs(q[:, apart].T @ x[:, :3]) - np.eye(3))) < 1e-8


def test_refinement_squares_the_error():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    exact = np.linalg.eigh(a)[1]
    rough = exact + 1e-4 * rng.normal(size=(12, 12))
    size = [np.max(np.abs(np.abs(refine(a, rough, n)[1].astype(float).T @ exact[:, ::-1]) - np.eye(12))) for n in (1, 2, 4)]
    assert size[0] > size[1] and size[2] < 1e-13


def test_odd_rows(spark):
    from pyspark.sql import functions as F
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -2.0]), (2, [0.5, 7.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (8, [1.0]), (9, [3e38, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"component": F.lit(3), "v": F.lit("x"), "id": F.lit(None), "n": F.lit(1)})
    got = whitened(df).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == sorted((i, c) for i in (1, 1, -1, 2) for c in (1, 2))
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-12 for r in got)
    assert whitened(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitened(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows,real", [([(1, [1.0, 2.0, 3.0])], 0), ([(1, [1.0, 2.0, 5.0]), (2, [2.0, 2.0, 1.0])], 1), ([(i, [1.0, 1.0, 1.0]) for i in range(20)], 0)])
def test_zero_eigenvalues(spark, rows, real):
    got = whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 * len(rows)
    assert all((r.whitened is None) == (r.component > real) and (r.explained > 0) == (r.component <= real) for r in got)
    assert all((r.identity_error is None) == (real == 0) for r in got)
