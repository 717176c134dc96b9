import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import distance as D
from cytolake.operators import mask as M
from cytolake.operators import regions as R


def located(spark, points):
    return spark.createDataFrame(points, "slide_id string, region_id int, cell_ord bigint, cx double, cy double, cell_type int")


def brute(points, steps=None):
    """Nearest target per source; with steps, within the first box that holds any target."""
    out = {}
    for s, g, o, x, y, a in points:
        for target in range(a + 1, 7):
            best = None
            for s2, g2, _, u, v, b in points:
                if b == target and s2 == s and g2 == g:
                    m = 1
                    if steps:
                        m = max(1, math.ceil(round(max(abs(x - int(u)) / steps[0], abs(y - int(v)) / steps[1]), 9)))
                    key = (m, math.hypot(int(x) - int(u), int(y) - int(v)))
                    best = key if best is None or key < best else best
            if best:
                out[(s, g, o, target)] = best[1]
    return out


def found(df):
    return {(r["slide_id"], r["region_id"], r["cell_ord"], r["target"]): r["dist"] for r in df.collect()}


def cloud(seed, n=220):
    """A dense clump, a sparse cloud, far outliers and many copies of one spot."""
    rng = np.random.default_rng(seed)
    spots = np.concatenate([
        rng.uniform(1000, 1060, (n // 2, 2)), rng.uniform(0, 9000, (n // 3, 2)), np.full((n // 4, 2), 1030.25), [[60000.5, 3.0]]
    ])
    return [
        (f"s{i % 2}", 1 + i % 3, i, round(float(x), 2), round(float(y), 2), int(rng.integers(1, 5)))
        for i, (x, y) in enumerate(spots)
    ]


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_nearest(spark, seed):
    points = cloud(seed)
    got, want = found(D.nearest_targets(located(spark, points), [1, 2, 3, 4])), brute(points)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_box_search(spark):
    points = cloud(7)
    steps = (160.0, 90.0)
    boxes = located(spark, points).select("slide_id", "region_id").distinct().select(
        "*", F.lit(steps[0]).alias("step_x"), F.lit(steps[1]).alias("step_y")
    )
    got, want = found(D.nearest_targets(located(spark, points), [1, 2, 3, 4], boxes)), brute(points, steps)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert got != brute(points)  # the box search is not the true nearest


def test_known_distances(cells7, mask100):
    regions = R.label_regions(M.mask_runs(mask100))
    spots = D.located_cells(cells7, regions, [1, 2, 3], 1)
    nearest = D.nearest_targets(spots, [1, 2, 3])
    row = {(r["source"], r["target"]): r for r in D.distance_summary(cells7, spots, nearest, [1, 2, 3]).collect()}
    d = np.array([math.hypot(10, 30), math.hypot(20, 29), math.hypot(10, 30)])
    assert row[(1, 2)]["n"] == 3
    assert row[(1, 2)]["mean"] == pytest.approx(d.mean()) and row[(1, 2)]["median"] == pytest.approx(np.median(d))
    assert row[(1, 2)]["std"] == pytest.approx(d.std()) and row[(1, 2)]["MAD"] == pytest.approx(np.abs(d - d.mean()).mean())
    assert row[(1, 3)]["mean"] == 0 and row[(2, 3)]["kurt"] == 0  # class 3 is not inside
    assert D.mean_distances(nearest).first()["mean_dist"] == pytest.approx(d.mean())


def test_classes_in_different_regions_have_no_distance(spark, cells7):
    spots = located(spark, [("s", 1, 0, 5.0, 5.0, 1), ("s", 2, 1, 6.0, 5.0, 2)])
    nearest = D.nearest_targets(spots, [1, 2])
    row = D.distance_summary(cells7, spots, nearest, [1, 2]).first()
    assert row["n"] == 0 and row["mean"] is None


def test_carry_over(spark):
    points = [("s", 1, 0, 0.0, 0.0, 1), ("s", 2, 1, 50.0, 0.0, 1), ("s", 1, 2, 30.0, 0.0, 1), ("s", 1, 3, 30.0, 4.0, 2), ("s", 1, 4, 30.0, 4.0, 1)]
    spots = located(spark, points)
    out = D.carried_distances(spots, D.nearest_targets(spots, [1, 2]), [1, 2])
    got = {r["cell_ord"]: r["dist"] for r in out.collect()}
    # cell 1 has no target in its region and repeats cell 0; the zero of cell 4 is dropped
    assert got == {0: pytest.approx(math.hypot(30, 4)), 1: pytest.approx(math.hypot(30, 4)), 2: 4.0}


def test_pairs_go_from_lower_to_higher():
    assert D.class_pairs([5, 1, 3]) == [(1, 3), (1, 5), (3, 5)]
