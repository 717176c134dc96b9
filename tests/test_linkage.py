"""Merge tables of reciprocal nearest neighbours against one merge after the other."""

import numpy as np
import pytest

from cytolake.operators import linkage as L


def literal(d, linkage):
    """(kept, gone, height, size) of plain agglomeration of a distance matrix."""
    d, members, out = d.copy(), {i: [i] for i in range(len(d))}, []
    while len(members) > 1:
        names = sorted(members)
        height, a, b = min((d[i, j], i, j) for i in names for j in names if i < j)
        for k in names:
            if k in (a, b):
                continue
            na, nb, nk = len(members[a]), len(members[b]), len(members[k])
            new = {
                "single": min(d[a, k], d[b, k]), "complete": max(d[a, k], d[b, k]), "average": (na * d[a, k] + nb * d[b, k]) / (na + nb),
                "ward": np.sqrt(((na + nk) * d[a, k] ** 2 + (nb + nk) * d[b, k] ** 2 - nk * height**2) / (na + nb + nk)),
            }[linkage]
            d[a, k] = d[k, a] = new
        members[a] += members.pop(b)
        out.append((f"f{a:02d}", f"f{b:02d}", height, len(members[a])))
    return out


def matrix(n, seed):
    dice = np.random.default_rng(seed)
    base = dice.normal(size=(n, 40))
    for i in range(1, n):
        if i % 3:
            base[i] += 1.5 * base[i - i % 3]
    return np.corrcoef(base)


@pytest.fixture(scope="module")
def corr(spark):
    r = matrix(9, 2)
    rows = [(f"f{i:02d}", f"f{j:02d}", float(r[i, j])) for i in range(9) for j in range(9)]
    return r, spark.createDataFrame(rows, "feature_a string, feature_b string, r double")


@pytest.mark.parametrize("linkage, absolute", [("complete", True), ("average", False), ("ward", False)])
def test_merges_equal_the_literal_ones(corr, linkage, absolute):
    r, table = corr
    d = 1 - (np.abs(r) if absolute else r)
    want = sorted(literal(d, linkage))
    got = sorted(tuple(m) for m in L.merge_table(L.correlation_distances(table, absolute), linkage).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_any_threshold_cuts_the_table(spark, corr):
    r, table = corr
    merges = L.merge_table(L.correlation_distances(table), "ward")
    features = table.selectExpr("feature_a as feature")
    cuts = [0.3, 0.9, 1.5, 5.0]
    found = {}
    for row in L.representatives(features, merges, cuts).collect():
        found.setdefault(row.threshold, set()).add(row.feature)
    for t in (0.9, 5.0):
        stands = {row.feature: row.representative for row in L.clusters(features, merges, t).collect()}
        assert len(stands) == 9 and set(stands.values()) == found[t]
    assert [len(found[t]) for t in cuts] == sorted((len(found[t]) for t in cuts), reverse=True) and found[5.0] == {"f00"}
    order = [row.feature for row in sorted(L.ranking(features, merges).collect(), key=lambda x: (x.until is not None, -(x.until or 0), x.feature))]
    assert all(set(order[: len(found[t])]) == found[t] for t in cuts)


def test_ties_constants_and_few_features(spark):
    flat = [(a, b, None if a != b else 1.0) for a in "abc" for b in "abc"]  # constant features: all at distance 1
    merges = L.merge_table(L.correlation_distances(spark.createDataFrame(flat, "feature_a string, feature_b string, r double")), "average")
    assert sorted((m.kept, m.gone, m.height, m.size) for m in merges.collect()) == [("a", "b", 1.0, 2), ("a", "c", 1.0, 3)]
    one = spark.createDataFrame([("a", "a", 1.0)], "feature_a string, feature_b string, r double")
    assert L.merge_table(L.correlation_distances(one)).count() == 0
    with pytest.raises(ValueError, match="unknown linkage"):
        L.merge_table(L.correlation_distances(one), "median")
