"""Joint fits of all folds and feature counts against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import evaluation as E
from cytolake.operators import matrix as MX
from cytolake.operators import models as ML
from cytolake.operators import prefix_models as PM

NAMES = [f"f{j}" for j in range(6)]
ORDER = {0: ["f3", "f0", "f1", "f5", "f2", "f4"], 1: ["f1", "f3", "f2"], 2: ["f5", "f4", "f3", "f2", "f1", "f0"]}


@pytest.fixture(scope="module")
def long(spark):
    dice = np.random.default_rng(6)
    label = (dice.random(120) < 0.4).astype(int)
    x = dice.normal(size=(120, 6))
    x[:, 3] += label
    x[:, 1] -= 0.5 * label
    rows = [(i, i % 3, int(label[i]), f"f{j}", float(x[i, j])) for i in range(120) for j in range(6)]
    return spark.createDataFrame(rows, "slide_id int, fold int, label int, feature string, value double")


def single(long, fold, k, model, **params):
    """(coefficients, balanced accuracy) of Spark's own model on one fold and count."""
    names = ORDER[fold][:k]
    wide = MX.to_vectors(long.where(F.col("feature").isin(names)), names, ["slide_id", "fold", "label"])
    rows = ML.balanced_weights(wide.where(F.col("fold") != fold)).withColumn("signed", (F.col("label") * 2 - 1).cast("double"))
    fitted = ML.fit(rows, model, **params)
    last = fitted.stages[0]
    score = E.balanced_accuracy(ML.predict(fitted, wide.where(F.col("fold") == fold))).first()[0]
    return np.r_[last.intercept, last.coefficients.toArray()], score


@pytest.mark.parametrize("model, own, tight", [
    ("logistic", {"C": 1.0}, {"tol": 1e-14, "maxIter": 1000}), ("logistic", {"C": 0.05}, {"tol": 1e-14, "maxIter": 1000}), ("ridge", {}, {}), ("ridge", {"alpha": 3.0}, {}),
])
def test_every_prefix_equals_its_single_fit(long, model, own, tight):
    rows = PM.sample_rows(long, NAMES)
    found = PM.JOINT[model](rows, NAMES, ORDER, range(1, 7), **own)
    assert sorted(found) == sorted((f, k) for f in ORDER for k in range(1, len(ORDER[f]) + 1))
    scores = {(r.fold, r.k): r.score for r in PM.prefix_scores(rows, NAMES, ORDER, range(1, 7), model, **own).collect()}
    for fold, k in [(0, 1), (0, 6), (1, 2), (1, 3), (2, 4)]:
        want, score = single(long, fold, k, model, **own, **tight)
        assert np.allclose(found[fold, k], want, atol=1e-6) and scores[fold, k] == pytest.approx(score)


def test_no_penalty_on_separable_classes_ends(spark):
    """Coefficients without a finite optimum: steps are bounded and the score is that of the separating line."""
    rows = [(i, i % 2, int(i >= 20), "f0", float(i - 19.5)) for i in range(40)]
    long = spark.createDataFrame(rows, "slide_id int, fold int, label int, feature string, value double")
    scores = PM.prefix_scores(PM.sample_rows(long, ["f0"]), ["f0"], {0: ["f0"], 1: ["f0"]}, [1], "logistic", C=1e12)
    assert all(r.score >= 0.95 for r in scores.collect())


def test_dependent_features_and_missing_values(spark, long):
    double = long.unionByName(long.where("feature = 'f0'").withColumn("feature", F.lit("g")))
    names = [*NAMES, "g"]
    order = {0: ["f0", "g", "f3"]}
    found = PM.ridge_prefixes(PM.sample_rows(double, names), names, order, [1, 2, 3])
    assert found[0, 2][1:].sum() == pytest.approx(found[0, 1][1])
    with pytest.raises(Exception, match="lacks a value"):
        PM.sample_rows(long.where("not (slide_id = 1 and feature = 'f2')"), NAMES).collect()
    with pytest.raises(ValueError, match="no joint fit"):
        PM.prefix_scores(PM.sample_rows(long, NAMES), NAMES, ORDER, [1], "forest")
    assert PM.prefix_scores(PM.sample_rows(long, NAMES), NAMES, {0: []}, [1], "ridge").count() == 0
