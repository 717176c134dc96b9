"""Registered queries run the whole of their operator."""

import inspect

import pytest
from pyspark.sql import functions as F

from cytolake.operators import folds as FO
from cytolake.operators import models as ML
from cytolake.operators import evaluation as E
from cytolake.operators import matrix as MX
from cytolake.operators import selection as SE
from cytolake.plans import cross_validation as CV
from workloads import inputs as I
from workloads import learning

SMALL = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def test_the_sweep_tries_every_count(spark, monkeypatch):
    def sweep(fm, labels, folds, ranker, model, ks, **params):
        raise Seen(sorted(ks))

    monkeypatch.setattr(CV, "sweep", sweep)
    every = len(MX.feature_names(I.feature_matrix(spark, SMALL)))
    with pytest.raises(Seen) as seen:
        learning.sweep(spark, SMALL)
    assert seen.value.args[0] == list(range(1, every + 1))


def test_sliced_vectors_score_as_their_own_matrix(spark):
    some = I.feature_matrix(spark, SMALL)
    fm = some.where(F.col("feature").isin(MX.feature_names(some)[:4])).cache()
    labels = I.sample_labels(spark, SMALL).cache()
    folds = FO.stratified_folds(labels.select("slide_id", "label", F.col("slide_id").alias("sample_ord")), 3).cache()
    scores, ranks = CV.sweep(fm, labels, folds, CV.mann_whitney, "logistic", [1, 3])
    names = [r.feature for r in ranks.where("fold = 0 and rank <= 3").orderBy("rank").collect()]
    rows = MX.to_vectors(fm.where(F.col("feature").isin(names)), names).join(labels.select("slide_id", "label"), "slide_id").join(
        folds.select("slide_id", "fold"), "slide_id"
    )
    fitted = ML.fit(ML.balanced_weights(rows.where("fold <> 0")), "logistic")
    want = E.balanced_accuracy(ML.predict(fitted, rows.where("fold = 0"))).first()[0]
    assert abs(scores.where("fold = 0 and k = 3").first().score - want) < 1e-6


def test_boruta_runs_all_rounds_with_the_configured_depth(spark, monkeypatch):
    kinds = inspect.signature(SE.boruta)

    def boruta(*args, **kw):
        given = kinds.bind(*args, **kw)
        given.apply_defaults()
        raise Seen(given.arguments)

    monkeypatch.setattr(SE, "boruta", boruta)
    with pytest.raises(Seen) as seen:
        learning.boruta(spark, SMALL)
    got = seen.value.args[0]
    # rounds of the operator; depth, seed and number of trees as the published scripts configure them
    assert (got["rounds"], got["trees"], got["max_depth"], got["seed"]) == (100, None, 1, 0)
