import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import segmentation as S


def tile(spark, truth, pred, true_class=None, pred_class=None):
    truth, pred = np.array(truth), np.array(pred)
    tc = np.array(true_class) if true_class is not None else (truth > 0).astype(int)
    pc = np.array(pred_class) if pred_class is not None else (pred > 0).astype(int)
    rows = [
        ("t", r, c, int(truth[r, c]), int(pred[r, c]), int(tc[r, c]), int(pc[r, c]))
        for r in range(truth.shape[0])
        for c in range(truth.shape[1])
    ]
    return spark.createDataFrame(rows, "tile_id string, row int, col int, true_inst int, pred_inst int, true_class int, pred_class int")


def blank():
    return np.zeros((5, 5), dtype=int)


def test_perfect_and_disjoint(spark):
    a = blank()
    a[0:2, 0:2], a[3:5, 3:5] = 1, 2
    same = S.panoptic_quality(tile(spark, a, a)).first()
    assert same["dq"] == 1 and same["sq"] == pytest.approx(1) and same["pq"] == pytest.approx(1)
    b = blank()
    b[0:2, 3:5] = 1
    assert S.panoptic_quality(tile(spark, a, b)).first()["pq"] == 0


def test_partial_overlap_and_miss(spark):
    a, b = blank(), blank()
    a[0, 0:5], b[0, 0:4] = 1, 1
    assert S.iou_pairs(tile(spark, a, b)).first()["iou"] == pytest.approx(0.8)
    a[3, 0:3] = 2  # no partner
    row = S.panoptic_quality(tile(spark, a, b)).first()
    assert row["dq"] == pytest.approx(1 / 1.5) and row["sq"] == pytest.approx(0.8, abs=1e-5)
    left = S.unpaired(tile(spark, a, b), S.match_pairs(S.iou_pairs(tile(spark, a, b)))).collect()
    assert [(r["side"], r["inst"]) for r in left] == [("true", 2)]


def test_low_threshold_pairs(spark):
    a, b = blank(), blank()
    a[0:2, 0:2], b[1:3, 1:3] = 1, 1
    pairs = S.iou_pairs(tile(spark, a, b))
    assert pairs.first()["iou"] == pytest.approx(1 / 7)
    assert S.match_pairs(pairs, 0.5).count() == 0 and S.match_pairs(pairs, 0.1).count() == 1
    with pytest.raises(ValueError):
        S.match_pairs(pairs, -0.1)


def test_greedy_pairs_are_one_to_one(spark):
    rows = [("t", 1, 1, 5, 0.4), ("t", 1, 2, 5, 0.3), ("t", 2, 1, 5, 0.35), ("t", 3, 2, 5, 0.3), ("t", 2, 2, 5, 0.2)]
    pairs = spark.createDataFrame(rows, "tile_id string, true_inst int, pred_inst int, inter int, iou double")
    got = {(r["true_inst"], r["pred_inst"]) for r in S.match_pairs(pairs, 0.1).collect()}
    assert got == {(1, 1), (3, 2)}


def _best_total(pairs):
    """Greatest total by trying every subset, one truth after the other."""
    truths = sorted({t for t, _, _ in pairs})

    def best(i, used):
        if i == len(truths):
            return 0.0
        taken = [w + best(i + 1, used | {p}) for t, p, w in pairs if t == truths[i] and p not in used]
        return max([best(i + 1, used), *taken])

    return best(0, frozenset())


def test_best_assignment_reaches_the_greatest_total():
    dice = np.random.default_rng(5)
    for _ in range(300):
        pairs = [(t, p, round(float(dice.random()), 2)) for t in range(6) for p in range(6) if dice.random() < 0.5]
        got = S.best_assignment(pairs)
        assert len({t for t, _, _ in got}) == len({p for _, p, _ in got}) == len(got) and set(got) <= set(pairs)
        assert sum(w for _, _, w in got) == pytest.approx(_best_total(pairs))


def test_pairs_of_the_greatest_total_beat_greedy_ones(spark):
    rows = [("t", 1, 1, 5, 0.40), ("t", 1, 2, 5, 0.38), ("t", 2, 1, 5, 0.35), ("u", 1, 1, 5, 0.05), ("u", 2, 1, 5, 0.45)]
    pairs = spark.createDataFrame(rows, "tile_id string, true_inst int, pred_inst int, inter int, iou double")
    got = lambda df: sorted((r["tile_id"], r["true_inst"], r["pred_inst"]) for r in df.collect())
    assert got(S.match_pairs(pairs, 0.1)) == [("t", 1, 1), ("u", 2, 1)]
    assert got(S.assign_pairs(pairs, 0.1)) == [("t", 1, 2), ("t", 2, 1), ("u", 2, 1)]
    assert got(S.assign_pairs(pairs, 0.36)) == [("t", 1, 2), ("u", 2, 1)]  # chosen first, then filtered
    assert S.assign_pairs(pairs.limit(0), 0.1).count() == 0


def test_the_background_of_a_tile_is_not_an_instance(spark):
    """Background overlaps are dealt out: areas are those of the instances all the same."""
    a, b = blank(), blank()
    a[0:2, 0:4], b[0:2, 2:6], b[4, 0:3] = 1, 1, 2
    got = S.iou_pairs(tile(spark, a, b)).collect()
    assert [(r["true_inst"], r["pred_inst"], r["inter"]) for r in got] == [(1, 1, 4)] and got[0]["iou"] == pytest.approx(4 / 10)


def test_class_rules(spark):
    a, b = blank(), blank()
    a[0:2, 0:2], a[3:5, 3:5] = 1, 2
    b[0:2, 0:2], b[3:5, 0:2] = 1, 2
    tc = np.where(a == 1, 1, np.where(a == 2, 2, 0))
    pc = np.where(b == 1, 1, np.where(b == 2, 3, 0))
    got = {r["class"]: r["pq"] for r in S.class_panoptic_quality(tile(spark, a, b, tc, pc)).collect()}
    assert got[1] == pytest.approx(1) and got[2] == 0 and got[3] is None and got[4] is None
    mean = {r["class"]: (r["n_tiles"], r["mean_pq"]) for r in S.mean_panoptic_quality(S.class_panoptic_quality(tile(spark, a, b, tc, pc))).collect()}
    assert mean[2] == (1, 0) and mean[3] == (0, None)


def test_contiguous_labels(spark):
    ids = spark.createDataFrame([("t", 2, 4), ("t", 4, 9), ("t", 6, 4), ("t", 0, 50)], "tile_id string, inst int, area int")
    plain = {r["inst"]: r["new_inst"] for r in S.remap_labels(ids).collect()}
    assert plain == {2: 1, 4: 2, 6: 3}
    assert {r["inst"]: r["new_inst"] for r in S.remap_labels(ids, True).collect()} == {4: 1, 2: 2, 6: 3}
    assert {r["inst"]: r["new_inst"] for r in S.relabel_global(ids).collect()} == plain


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (3, 2)], "t int, p int")
    got = {(r["t"], r["p"]): r for r in S.confusion_matrix(df).collect()}
    assert len(got) == 9 and got[(1, 1)]["n"] == 2 and got[(2, 2)]["n"] == 0
    assert got[(1, 2)]["truth_text"] == "1 (33.33%)" and got[(3, 2)]["pred_text"] == "1 (50.00%)"
    assert got[(2, 1)]["of_truth"] == 0


def test_majority_ties_and_fallback(spark):
    inst, cls = blank(), blank()
    inst[0, 0:4], inst[2, 0:2], inst[4, 0:3] = 1, 2, 3
    cls[0, 0:4] = [2, 1, 1, 2]  # tie, class 2 is met first
    cls[4, 0:3] = [0, 3, 3]
    cls[1, 0:3] = 1
    got = {r["inst"]: r["class"] for r in S.majority_class(tile(spark, inst, inst, cls), "pred_inst", "true_class").collect()}
    assert got == {1: 2, 2: 1, 3: 3}  # instance 2 has no class and takes the tile's


def test_layers_from_channels(spark):
    rows = [("t", 0, c, ch, v) for c, vs in enumerate([(5, 7, 0, 9), (1, 0, 0, 9), (4, 0, 0, 9), (0, 0, 6, 0)]) for ch, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "tile_id string, row int, col int, channel int, value int")
    got = [(r["inst"], r["type"]) for r in S.layers_from_channels(df, 3).orderBy("col").collect()]
    # later channel wins; instance 1 and type 1 are cleared
    assert got == [(7, 2), (0, 0), (4, 0), (6, 3)]


def test_counts_roll_up(spark):
    a = blank()
    a[0:2, 0:2], a[3:5, 3:5] = 1, 2
    got = {(r["tile_id"], r["class"]): r["n"] for r in S.cell_counts(tile(spark, a, a, a)).collect()}
    assert got == {("t", 1): 1, ("t", 2): 1, (None, 1): 1, (None, 2): 1, (None, None): 2}
