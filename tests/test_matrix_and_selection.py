import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import describe as DS
from cytolake.operators import documents as DOC
from cytolake.operators import evaluation as E
from cytolake.operators import folds as FO
from cytolake.operators import matrix as MX
from cytolake.operators import models as ML
from cytolake.operators import selection as SE
from cytolake.plans import cross_validation as CV
from cytolake.plans import feature_matrix as FMP
from cytolake.sources import sinks as K
from cytolake.sources import tables as ST


def leaves(spark, doc):
    return DOC.document_leaves(spark.createDataFrame([("s", json.dumps(doc))], "slide_id string, doc string"))


def values(flat):
    return {r["feature"]: r["value"] for r in DOC.numeric_features(flat).collect()}


def test_flattening(spark):
    doc = {"A": {"B": {"c": 1, "d": 2}}, "P1": {"x": 1}, "P2": {"x": 2}, "E": {}, "t": "text"}
    got = leaves(spark, doc)
    assert values(DOC.flatten_full(got, ["slide_id"])) == {"A_B_c": 1, "A_B_d": 2, "P1_x": 1, "P2_x": 2, "t": None}
    assert values(DOC.flatten_leaf(got, ["slide_id"])) == {"c": 1, "d": 2, "x": 2, "t": None}
    assert "A/B/c" in values(DOC.flatten_full(got, ["slide_id"], "/"))
    renamed = values(DOC.rename_by_ancestors(got, ["slide_id"], ["x"], 1))
    assert renamed["P1_x"] == 1 and renamed["P2_x"] == 2 and renamed["c"] == 1
    three = leaves(spark, {"M": {"G": {"areas_mean": 1.5}, "L": {"areas_mean": 2}}})
    assert values(DOC.rename_by_ancestors(three, ["slide_id"])) == {"M_G_areas_mean": 1.5, "M_L_areas_mean": 2}


def test_matrix_stays_aligned_when_values_are_missing(spark):
    docs = spark.createDataFrame(
        [("a", '{"S": {"x": 1, "y": "Not calculated"}}'), ("b", '{"S": {"x": 2, "y": 5}}')], "slide_id string, doc string"
    )
    got = {(r["slide_id"], r["feature"]): r["value"] for r in FMP.matrix_from_documents(docs).collect()}
    assert got == {("a", "x"): 1, ("b", "x"): 2, ("b", "y"): 5}


def test_ranking_documents_and_topk(spark):
    docs = spark.createDataFrame([('{"f2": {"count": 3}, "f1": 1, "f9": 0}',)], "doc string")
    ranking = ST.ranking_from_documents(docs)
    assert [(r["rank"], r["feature"]) for r in ranking.orderBy("rank").collect()] == [(1, "f2"), (2, "f1"), (3, "f9")]
    fm = spark.createDataFrame([("s", "f1", 1.0), ("s", "f2", 2.0), ("s", "f3", 3.0)], "slide_id string, feature string, value double")
    assert {r["feature"] for r in MX.topk_predefined(fm, ranking, 2).collect()} == {"f1", "f2"}
    with pytest.raises(Exception, match="unknown feature"):
        MX.topk_predefined(fm, ranking, 50).collect()


def test_names_and_lists(spark):
    df = spark.createDataFrame(list(enumerate("abac")), "pos bigint, name string")
    assert {r["name"]: r["id"] for r in MX.ordered_ids(df, "name", "pos").collect()} == {"a": 1, "b": 2, "c": 3}
    spots = MX.positions_by_value(df, "name", "pos").where("name = 'a'").orderBy("nth").collect()
    assert [r["pos"] for r in spots] == [0, 2]
    lists = spark.createDataFrame([(0, [1]), (1, [1, 2, 3]), (2, [1, 2])], "pos int, items array<int>")
    assert MX.closest_sized(lists, 2).first()["pos"] == 2
    assert MX.closest_sized(lists.where("pos < 2"), 2).first()["pos"] == 0


def test_both_classes_needed(spark):
    with pytest.raises(Exception, match="both label classes"):
        MX.require_both_classes(spark.createDataFrame([("a", 1)], "slide_id string, label int")).collect()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    n = 90
    y = np.arange(n) % 2
    x = rng.normal(0, 1, (n, 6))
    x[:, 1] += 1.6 * y
    x[:, 2] = x[:, 1] + rng.normal(0, 0.05, n)
    x[:, 3] += 0.9 * y
    x[:, 5] = 2.0
    rows = [(i, f"f{j}", int(y[i]), float(x[i, j])) for i in range(n) for j in range(6)]
    return x, y, spark.createDataFrame(rows, "slide_id bigint, feature string, label int, value double").cache()


def test_correlations(labelled):
    x, _, df = labelled
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in MX.correlations(df).collect()}
    for i in range(5):
        for j in range(5):
            assert got[(f"f{i}", f"f{j}")] == pytest.approx(np.corrcoef(x[:, i], x[:, j])[0, 1])
    assert got[("f5", "f0")] is None
    groups = {r["feature"]: r["representative"] for r in SE.correlation_groups(MX.correlations(df), 0.9).collect()}
    assert groups["f2"] == "f1" and groups["f3"] == "f3" and groups["f5"] == "f5"


def test_mrmr_prefers_what_is_new(labelled):
    x, y, df = labelled
    f = {r["feature"]: r["f_stat"] for r in SE.anova_f(df).collect()}
    a, b = x[y == 0, 1], x[y == 1, 1]
    grand = x[:, 1].mean()
    between = len(a) * (a.mean() - grand) ** 2 + len(b) * (b.mean() - grand) ** 2
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert f["f1"] == pytest.approx(between / (within / (len(y) - 2))) and f["f5"] is None
    ranked = [r["feature"] for r in SE.mrmr_ranking(df, 3).orderBy("rank").collect()]
    names = [f"f{j}" for j in range(5)]
    r = np.maximum(np.abs(np.corrcoef(x[:, :5].T)), 0.001)
    chosen = [max(range(5), key=lambda j: f[names[j]])]
    while len(chosen) < 3:
        rest = [j for j in range(5) if j not in chosen]
        chosen.append(max(rest, key=lambda j: f[names[j]] / np.mean([r[j, c] for c in chosen])))
    assert ranked == [names[j] for j in chosen]


def test_mann_whitney(spark, labelled):
    x, y, df = labelled
    got = {r["feature"]: r for r in SE.mann_whitney(df).collect()}
    for j in (0, 1):
        a, b = x[y == 0, j], x[y == 1, j]
        u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
        assert got[f"f{j}"]["u"] == u
        mu, sigma = 45 * 45 / 2, math.sqrt(45 * 45 * 91 / 12)
        z = (max(u, 45 * 45 - u) - mu - 0.5) / sigma
        assert got[f"f{j}"]["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert got["f5"]["p"] is None  # constant: no spread to test
    assert SE.best_by_p(SE.mann_whitney(df), 1).first()["feature"] in ("f1", "f2")
    tiny = spark.createDataFrame([(i, "f", int(i > 1), float(i)) for i in range(4)], "slide_id int, feature string, label int, value double")
    assert SE.mann_whitney(tiny).first()["p"] == pytest.approx(2 / 6)


def test_boruta_finds_the_signal(labelled):
    _, _, df = labelled
    got = {r["feature"]: r["decision"] for r in SE.boruta(df, rounds=8, max_depth=3, trees=20).collect()}
    assert got["f1"] == "confirmed" and got["f5"] == "rejected"


def test_stratified_folds(spark):
    y = [1, 1, 0, 1, 0, 2, 1, 1, 0, 2, 1]
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(y)], "slide_id int, label int, sample_ord int")
    got = {r["slide_id"]: r["fold"] for r in FO.stratified_folds(df, 3).collect()}
    # classes by first appearance: 1 x 6, 0 x 3, 2 x 2, laid end to end and dealt to folds
    order = sorted(range(11), key=lambda i: ([1, 0, 2].index(y[i]), i))
    quota = {(c, f): sum(1 for p, i in enumerate(order) if y[i] == c and p % 3 == f) for c in (0, 1, 2) for f in range(3)}
    want = {}
    for c in (0, 1, 2):
        folds = [f for f in range(3) for _ in range(quota[(c, f)])]
        want.update(zip([i for i in range(11) if y[i] == c], folds))
    assert got == want


def test_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "label int, pred int")
    assert E.balanced_accuracy(df).first()[0] == pytest.approx((2 / 3 + 1) / 2)
    assert E.accuracy(df).first()[0] == 0.75
    sweep = spark.createDataFrame([(0, 3, 0.5), (0, 2, 0.5), (0, 1, 0.9), (1, 3, 0.7), (1, 2, 0.7)], "fold int, k int, score double")
    by_k = E.score_by_count(E.common_counts(sweep))
    assert {r["k"] for r in by_k.collect()} == {2, 3}
    assert E.best_count(by_k).first()["k"] == 3
    ranks = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c")], "fold int, rank int, feature string")
    got = {r["feature"]: (r["count"], r["score"]) for r in E.consensus_ranking(ranks, 2).collect()}
    assert got["b"] == (2, pytest.approx(math.log10(110))) and got["a"] == (1, pytest.approx(2)) and got["c"] == (1, pytest.approx(1))
    wide = spark.createDataFrame([(0, i, f"f{i}") for i in range(1, 401)], "fold int, rank int, feature string")
    assert E.consensus_ranking(wide, 400).where("feature = 'f1'").first()["score"] == pytest.approx(400)


def test_roc(spark):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([(0, int(a), float(b)) for a, b in zip(y, s)], "fold int, label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    points = E.roc_points(df)
    assert E.roc_auc(points).first()["auc"] == pytest.approx(want)
    cuts = np.unique(s)[::-1]
    fpr = np.r_[0, [(neg >= c).mean() for c in cuts]]
    tpr = np.r_[0, [(pos >= c).mean() for c in cuts]]
    grid = np.linspace(0, 1, 100)
    curve = np.interp(grid, fpr, tpr)
    curve[0], curve[-1] = 0, 1
    got = [r["mean_tpr"] for r in E.mean_roc(points).orderBy("fpr").collect()]
    assert len(got) == 100 and np.allclose(got, curve)


def test_description(spark, labelled):
    x, y, df = labelled
    t = {r["feature"]: r for r in DS.t_test(df).collect()}["f3"]
    a, b = x[y == 0, 3], x[y == 1, 3]
    pooled = (a.var() * len(a) + b.var() * len(b)) / 88
    assert t["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(pooled * (2 / 45))) and t["df"] == 88
    assert t["stars"] == "***"
    box = DS.box_stats(df.where("feature = 'f0' and label = 1")).first()
    v = x[y == 1, 0]
    q1, q3 = np.quantile(v, [0.25, 0.75])
    assert box["q1"] == pytest.approx(q1) and box["high_whisker"] == v[v <= q3 + 1.5 * (q3 - q1)].max()
    curve = DS.density_curve(df.where("feature = 'f0'"), 40, 0.5).where("label = 0").orderBy("i").collect()
    at = np.array([r["x"] for r in curve])
    want = np.exp(-0.5 * ((at[:, None] - x[y == 0, 0]) / 0.5) ** 2).sum(1) / (45 * 0.5 * math.sqrt(2 * math.pi))
    assert np.allclose([r["density"] for r in curve], want)


def test_models_learn_store_and_load(spark, labelled, tmp_path):
    _, _, df = labelled
    names = ["f0", "f1", "f3"]
    vectors = MX.to_vectors(df.where(F.col("feature").isin(names)), names)
    rows = ML.training_rows(vectors, df.select("slide_id", "label").distinct()).cache()
    for model, params in (("logistic", {}), ("forest", {"maxDepth": 3}), ("ridge", {}), ("boosted_trees", {"maxIter": 3, "maxDepth": 2})):
        assert E.accuracy(ML.predict(ML.fit(rows, model, **params), rows)).first()[0] > 0.7
    fitted = ML.fit(rows, "logistic")
    ML.save(fitted, str(tmp_path / "model"))
    again = ML.predict(ML.load(str(tmp_path / "model")), rows).orderBy("slide_id").collect()
    assert [r["proba"] for r in again] == [r["proba"] for r in ML.predict(fitted, rows).orderBy("slide_id").collect()]
    with pytest.raises(ValueError, match="unknown classifier"):
        ML.fit(rows, "nothing")
    _, shares = ML.principal_components(vectors, 2)
    assert shares[0] >= shares[1] > 0


def test_sweep_and_report(labelled):
    _, _, df = labelled
    labels = df.select("slide_id", "label").distinct()
    folds = FO.stratified_folds(labels.withColumn("sample_ord", F.col("slide_id")), 3)
    scores, ranks = CV.sweep(df.select("slide_id", "feature", "value"), labels, folds, CV.mrmr, "logistic", [1, 3])
    assert scores.count() == 6
    top = CV.report(scores, ranks, 3).orderBy(F.col("count").desc(), F.col("score").desc()).first()
    assert top["feature"] in ("f1", "f2") and top["best_mean"] > 0.6


def test_matrix_files(spark, labelled, tmp_path):
    _, _, df = labelled
    fm = df.select("slide_id", "feature", "value")
    K.write_matrix(fm, df.select("slide_id", "label").distinct(), MX.correlations(fm), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "names")).count() == 6
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "correlations")).count() == 36
