"""Whitening against a plain eigendecomposition, and its odd cases."""

import math

import numpy as np
import pytest
from odd_rows import SMALL
from pyspark.sql import functions as F

from cytolake.llm import queries, whitening

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def plain(rows, components=4):
    """``{vec_id: (deviation, whitened)}``, n and variances, from one covariance matrix."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in good)
    x = {}
    for k, (i, v) in enumerate(good):
        if len(v) == width:
            x[k] = (i, [math.floor(256 * float(np.float32(c))) for c in v])
    fit = sorted({tuple(v) for _, v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], float) / n
    e, vectors = np.linalg.eigh(a.T @ a / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = []
    for i, v in x.values():
        y = np.array([n * c - s for c, s in zip(v, sums)], float) / n
        out.append((i, sum((n * c - s) ** 2 for c, s in zip(v, sums)), [float(y @ vectors[:, k] / np.sqrt(e[k])) for k in range(components) if e[k] > 1e-9 * e[0]]))
    return out, n, e


def _same(got, want):
    """Equal ids and deviations, equal numbers up to one sign per component."""
    got, want = (sorted(map(tuple, rows), key=lambda r: repr(r[:2])) for rows in (got, want))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    a, b = np.array([g[2] for g in got]), np.array([w[2] for w in want])
    assert a.shape == b.shape
    for k in range(a.shape[1]):
        assert min(np.abs(a[:, k] - b[:, k]).max(), np.abs(a[:, k] + b[:, k]).max()) < 1e-7


def test_query_equals_plain(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want, n, e = plain([(r.vec_id, r.embedding) for r in table.collect()])
    got = queries.QUERIES["op12_whitening"](spark, SMALL).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.component):
        by.setdefault(r.vec_id, [r.vec_id, r.deviation, []])[2].append(r.whitened)
        assert r.n == n and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-10
    _same(list(by.values()), want)


def test_copies_count_once_and_odd_rows_go(spark):
    dice = np.random.default_rng(1)
    rows = [(i, dice.normal(size=6).tolist()) for i in range(50)]
    rows += [(100 + k, rows[3][1]) for k in range(40)]  # copies
    rows += [(3, rows[3][1]), (None, rows[4][1])]  # a repeated row, a row without id
    bad = [(200, None), (201, []), (202, [1.0] * 5), (203, [None] + [1.0] * 5), (204, [float("nan")] * 6), (205, [float("-inf")] + [0.0] * 5)]
    table = spark.createDataFrame([(i, 0, v) for i, v in rows + bad], SCHEMA).withColumn("x", F.lit(1)).withColumn("id", F.lit("a"))
    out, found = whitening.whiten(table)
    want, n, _ = plain([(i, v) for i, v in rows])
    assert found.n == n == 50 and found.identity_error < 1e-12
    _same([(r.id, r.deviation, r.whitened) for r in out.collect()], want)


@pytest.mark.parametrize("shape", ["constant", "dependent", "narrow", "two"])
def test_vectors_that_vary_in_few_directions(spark, shape):
    dice = np.random.default_rng(2)
    base = dice.normal(size=(200, 3))
    if shape == "constant":
        rows = np.hstack([base, np.full((200, 2), 0.5)])
    elif shape == "dependent":
        rows = np.hstack([base, base])
    elif shape == "narrow":
        rows = base[:, :2]
    else:
        rows = np.vstack([np.zeros(8), np.arange(8) / 4.0])
    table = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rows)], SCHEMA)
    out, found = whitening.whiten(table)
    want, _, _ = plain([(i, v.tolist()) for i, v in enumerate(rows)], min(4, rows.shape[1]))
    assert found.axes.shape[1] == {"constant": 3, "dependent": 3, "narrow": 2, "two": 1}[shape]
    _same([(r.id, r.deviation, r.whitened) for r in out.collect()], want)
    assert found.identity_error < 1e-8


def test_small_variances_keep_their_digits(spark):
    """Variances 14 orders apart, where one Gram matrix has lost the smallest."""
    dice = np.random.default_rng(3)
    base = dice.integers(-50, 50, size=(300, 3))
    x = np.stack([base[:, 0] * 10**9, base[:, 0] * 10**9 + base[:, 1], base[:, 2] * 10**4], axis=1)
    table = spark.createDataFrame([(i, (v / 256.0).tolist()) for i, v in enumerate(x.astype(float))], "vec_id bigint, embedding array<double>")
    _, found = whitening.whiten(table, components=3)
    a = x - x.mean(axis=0)
    want = np.linalg.svd(a, compute_uv=False) ** 2 / len(a)
    assert np.allclose(found.variances, want, rtol=1e-6) and found.identity_error < 1e-4


def test_no_usable_row(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for table in (empty, spark.createDataFrame([(1, 0, None), (2, 0, [])], SCHEMA)):
        out, found = whitening.whiten(table)
        assert out.count() == 0 and found.n == 0
    out, found = whitening.whiten(spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])], SCHEMA))
    assert [(r.deviation, r.whitened) for r in out.collect()] == [(0, []), (0, [])] and found.n == 1


def test_huge_entries_stay_exact():
    big = 1 << 61
    found = whitening.Whitening(2, [big + 1, 0])
    x = np.array([[big, 0], [1, 0]])
    assert found.deviations(x) == [None, None]
    assert whitening.Whitening(2, [5, 0]).deviations(np.array([[3_000_000_000, 0]])) == [None]
    assert whitening.Whitening(1, [0]).deviations(np.array([[3_000_000_000]])) == [9 * 10**18]
    assert found.centred(x)[0, 0] == (big - 1) / 2
