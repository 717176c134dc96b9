"""Boruta by batches and levels against one round, one tree and one node at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import boruta as B


@pytest.fixture(scope="module")
def samples(spark):
    dice = np.random.default_rng(4)
    label = dice.integers(0, 2, 150)
    x = np.round(dice.normal(size=(150, 8)), 2)
    x[:, 1] += 3.0 * label
    x[:, 4] -= 2.0 * label
    x[:, 7] = 3.0
    rows = [(i, f"f{j}", int(label[i]), float(x[i, j])) for i in range(150) for j in range(8)]
    return spark.createDataFrame(rows, "slide_id int, feature string, label int, value double")


def literal_tree(matrix, weights, labels, seed, r, t, max_depth, columns):
    """Gains by column of one tree, grown node by node."""
    gains = np.zeros(columns)

    def impurity(mask):
        a, b = (weights[mask & (labels == c)].sum() for c in (0, 1))
        return 2 * a * b / (a + b) if a + b > 0 else 0.0

    def grow(mask, node, depth):
        if depth == max_depth:
            return
        best = (0.0, 0, 0)
        for column in B.tried(seed, r, t, node, columns):
            for last in range(B.BINS - 1):
                left, right = mask & (matrix[column] <= last), mask & (matrix[column] > last)
                if weights[left].sum() > 0 and weights[right].sum() > 1e-9:
                    gain = round(impurity(mask) - impurity(left) - impurity(right), B.GAIN_DECIMALS)
                    best = max(best, (gain, -int(column), -last))
        if best[0] > 0:
            gains[-best[1]] += best[0]
            goes = matrix[-best[1]] <= -best[2]
            grow(mask & goes, 2 * node, depth + 1)
            grow(mask & ~goes, 2 * node + 1, depth + 1)

    grow(weights > 0, 1, 0)
    return gains


def literal_boruta(columns, labels, names, rounds, max_depth, trees, seed, alpha=0.05):
    """One block of samples, one round at a time, rejected features leave at once."""
    n = len(labels)
    balance = np.array([n / (2 * (labels == c).sum()) for c in (0, 1)])
    hits, decision, done = dict.fromkeys(names, 0), dict.fromkeys(names, "tentative"), 0
    while done < rounds and "tentative" in decision.values():
        done += 1
        active = [i for i, f in enumerate(names) if decision[f] != "rejected"]
        matrix = np.array([columns[i] for i in active] + [columns[i][B.shadow_order(seed, done, i, 0, n)] for i in active])
        total = np.zeros(2 * len(active))
        for t in range(trees):
            own = literal_tree(matrix, B.drawn(seed, done, t, 0, n) * balance[labels], labels, seed, done, t, max_depth, len(total))
            total += own / own.sum() if own.sum() else 0
        total = np.round(total / trees, 12)
        for i, f in enumerate(active):
            hits[names[f]] += int(total[i] > total[len(active) :].max())
        decision = B.decide(hits, decision, done, alpha)
    return {f: (hits[f], done, decision[f]) for f in names}


@pytest.mark.parametrize("max_depth, batch, seen", [(1, 5, {"rejected"}), (3, 8, {"confirmed", "rejected"})])
def test_batches_and_levels_equal_the_literal_rounds(samples, max_depth, batch, seen):
    names = [f"f{j}" for j in range(8)]
    cells, own, _ = B.binned(samples, names, 7, B.BINS, B.BLOCK_SAMPLES)
    columns = [np.array(r.bins) for r in cells.orderBy("f").collect()]
    labels = np.array(own.first().labels)
    want = literal_boruta(columns, labels, names, 16, max_depth, 10, 7)
    got = B.boruta(samples, rounds=16, max_depth=max_depth, trees=10, seed=7, batch=batch).collect()
    assert {r.feature: (r.hits, r.rounds, r.decision) for r in got} == want
    assert {d for _, _, d in want.values()} >= seen


def test_result_does_not_hang_on_batches(samples):
    runs = [sorted(map(tuple, B.boruta(samples, rounds=14, max_depth=2, trees=8, seed=3, batch=b, block_samples=40).collect())) for b in (1, 9)]
    assert runs[0] == runs[1]


def test_no_round_is_grown_in_vain_where_a_round_fills_the_cluster(samples, monkeypatch):
    """Many blocks: every round grown counts, and the result is that of batches of one round."""
    grown, importances = [], B.Forests.importances

    def counted(self, layout, rounds):
        grown.extend(rounds)
        return importances(self, layout, rounds)

    monkeypatch.setattr(B.Forests, "importances", counted)
    run = lambda batch: sorted(map(tuple, B.boruta(samples, rounds=14, max_depth=1, trees=20, seed=3, batch=batch, block_samples=10).collect()))
    found = run(10)
    assert any(r[3] == "rejected" for r in found)
    assert grown == list(range(1, found[0][2] + 1))
    assert run(1) == found


def test_open_rounds_bound_the_next_rejection():
    names, dice = ["a", "b", "c"], np.random.default_rng(1)
    for _ in range(200):
        hits, decision, done = dict.fromkeys(names, 0), dict.fromkeys(names, "tentative"), 0
        while done < 40 and "tentative" in decision.values():
            first = B.open_rounds(hits, decision, done, 0.05, 40)
            assert done < first <= 40
            while done < first:
                done += 1
                before = dict(decision)
                for f, p in zip(names, (0.02, 0.5, 0.98)):
                    hits[f] += int(decision[f] != "rejected" and dice.random() < p)
                decision = B.decide(hits, decision, done, 0.05)
                changed = [f for f in names if decision[f] == "rejected" != before[f]] or "tentative" not in decision.values()
                assert not changed or done == first
                if changed:
                    break


def test_shadows_hold_the_values_of_their_feature(spark, samples):
    """Blocks of unequal size: every shadow is a permutation of the feature over all samples."""
    names = [f"f{j}" for j in range(8)]
    cells, own, blocks = B.binned(samples, names, 1, B.BINS, 40)
    assert blocks == 4 and sorted(r.size for r in own.collect()) == [37, 37, 38, 38]
    layout = B._layout(cells, own, blocks, 150, [0, 3, 4], [1, 2], 1).collect()
    assert len(layout) == 8
    values = {f: sorted(b for r in cells.where(F.col("f") == f).collect() for b in r.bins) for f in (0, 3, 4)}
    for r in (1, 2):
        for k, f in enumerate((0, 3, 4)):
            moved = [b for row in layout if row.round == r for b in row.shadows[k * len(row.labels) : (k + 1) * len(row.labels)]]
            assert sorted(moved) == values[f]
    firsts = {tuple(row.shadows[: len(row.labels)]) for row in layout}
    assert len(firsts) > 2  # blocks change places


def test_a_missing_value_is_an_error_and_no_rows_are_none(spark, samples):
    with pytest.raises(Exception, match="lacks a value"):
        B.boruta(samples.where("not (slide_id = 3 and feature = 'f2')"), rounds=1, trees=2, max_depth=1).collect()
    assert B.boruta(samples.limit(0), rounds=2, trees=2).collect() == []


def test_tail_and_size():
    assert B.binomial_tail(9, 10) == pytest.approx(11 / 1024) and B.forest_size(128, 1) == int(100 * math.sqrt(128))
