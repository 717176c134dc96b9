"""Small regions are searched whole, large ones by squares, with the same answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import distance as D
from test_distances import brute, cloud, found, located

CLASSES = [1, 2, 3, 4]


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("direct", [0, 60, D.DIRECT])
def test_regions_on_both_sides_of_the_bound(spark, direct):
    points = cloud(3)
    few = [(s, 9, 1000 + o, x, y, a) for s, _, o, x, y, a in points[:20]]
    same(found(D.nearest_targets(located(spark, points + few), CLASSES, direct=direct)), brute(points + few))


@pytest.mark.parametrize("direct", [0, D.DIRECT])
def test_boxes_on_both_sides_of_the_bound(spark, direct):
    points, steps = cloud(5), (0.25, 90.0)  # copies sit on the edges of boxes
    boxes = located(spark, points).select("slide_id", "region_id").distinct().select(
        "*", F.lit(steps[0]).alias("step_x"), F.lit(steps[1]).alias("step_y")
    )
    same(found(D.nearest_targets(located(spark, points), CLASSES, boxes, direct=direct)), brute(points, steps))


def test_pairs_of_a_region_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PAIRS", 500)
    points = cloud(4)
    same(found(D.nearest_targets(located(spark, points), CLASSES)), brute(points))


def test_small_regions_need_one_shuffle_and_no_pyramid(spark):
    df = D.nearest_targets(located(spark, cloud(6)), CLASSES)
    plan = df._jdf.queryExecution().toString()
    assert plan.count("FlatMapGroupsInArrow") and "Join" not in plan


def test_cells_without_position_or_region_have_no_row(spark):
    points = [("s", 1, 0, 1.0, 1.0, 1), ("s", 1, 1, None, 1.0, 1), ("s", None, 2, 1.0, 1.0, 1), ("s", 1, 3, 4.0, 5.0, 2), ("s", 1, 4, 0.0, None, 2), ("s", 1, 5, 1.0, 1.0, None)]
    for direct in (0, D.DIRECT):
        assert found(D.nearest_targets(located(spark, points), CLASSES, direct=direct)) == {("s", 1, 0, 2): 5.0}


def test_one_slide_of_many_cells(spark):
    rng = np.random.default_rng(0)
    points = [("s", 1, i, float(x), float(y), int(k)) for i, (x, y, k) in enumerate(zip(rng.integers(0, 900, 5000), rng.integers(0, 900, 5000), rng.integers(1, 5, 5000)))]
    rows = located(spark, points)
    same(found(D.nearest_targets(rows, CLASSES)), found(D.nearest_targets(rows, CLASSES, direct=10_000)))
