"""What used to be capped: document depth, buckets of a group, silent cells; and penalties that mean what they say."""

import json
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cytolake.functions import ordering
from cytolake.operators import documents as DOC
from cytolake.operators import models as ML
from cytolake.sources import cells as SC
from cytolake.sources import sinks as K


@pytest.mark.parametrize("depth", [1, 6, 9, 15])
def test_documents_of_any_depth_survive(spark, depth):
    names = [f"n{i}" for i in range(depth - 1)]
    rows = [("s", [*names, "a"], 1.5), ("s", [*names, "b"], 2.0), ("s", ["top"] if depth > 1 else ["c"], float("nan")), ("s", [*names, "z"], None)]
    features = spark.createDataFrame(rows, "slide_id string, path array<string>, value double")
    doc = K.feature_documents(features)
    text = doc.first()["doc"]
    held = json.loads(text)
    for n in names:
        held = held[n]
    assert held["a"] == 1.5 and held["b"] == 2.0 and held["z"] is None and "NaN" not in text
    leaves = {tuple(r["path"]): r["raw"] for r in DOC.document_leaves(doc).collect()}
    assert leaves[(*names, "a")] == "1.5" and len(leaves) == 4


def test_braces_inside_strings_are_not_levels(spark):
    docs = spark.createDataFrame([("s", json.dumps({"a": 'x{{{"}', "b": {"c": 1}}))], "slide_id string, doc string")
    assert DOC.deepest_object(docs) == 2
    assert {tuple(r["path"]) for r in DOC.document_leaves(docs).collect()} == {("a",), ("b", "c")}


def test_large_groups_get_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 10)
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 2003).alias("v"), F.lit(1).alias("one"))
    bounds = ordering._bucket_bounds(df, ["g"], "v", 4)
    assert all(len(r["_bounds"]) == 99 for r in bounds.collect())
    got = ordering.running_totals(df, ["g"], "v", {"upto": "one"}, 4).collect()
    for g in (0, 1):
        own = sorted((r["v"], r["upto"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(1, 1001))


@pytest.mark.parametrize("record", ['{"nuc": {"": {"centroid": [1.0, 2.0], "type": 1}}}', '{"nuc": {"7": {"centroid": null, "type": 1}}}'])
def test_broken_nuclei_fail(spark, record):
    docs = spark.createDataFrame([("s", record)], "slide_id string, doc string")
    with pytest.raises(Exception, match="nucleus without"):
        SC.cells_from_documents(docs).collect()


def _samples(spark, n=200):
    random = np.random.default_rng(2)
    x = random.normal(size=(n, 3))
    label = (x @ [1.0, -2.0, 0.5] + random.normal(size=n) > 0.3).astype(int)
    rows = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, label))], "slide_id int, v array<double>, label int")
    vectors = rows.select("slide_id", array_to_vector("v").alias("features"))
    return ML.training_rows(vectors, rows), x, label


def test_ridge_equals_its_closed_form(spark):
    rows, x, label = _samples(spark)
    y = 2.0 * label - 1
    for alpha in (0.0, 3.0):
        fitted = ML.fit(rows, "ridge", alpha=alpha).stages[0]
        centred = x - x.mean(axis=0)
        want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - y.mean()))
        # Spark scales the penalty by the label's deviation over n - 1
        assert np.allclose(fitted.coefficients.toArray(), want, atol=1e-6 if alpha == 0 else 2e-4)


def test_logistic_penalty_counts_samples(spark):
    """At the optimum of the summed loss the penalty balances the gradient: w = C X' (y - p), weighted."""
    rows, x, label = _samples(spark)
    n = len(label)
    weight = np.where(label == 1, n / (2 * label.sum()), n / (2 * (n - label.sum())))
    for c in (0.1, 1.0):
        fitted = ML.fit(rows, "logistic", C=c, tol=1e-12, maxIter=500).stages[0]
        w = fitted.coefficients.toArray()
        p = 1 / (1 + np.exp(-(x @ w + fitted.intercept)))
        assert np.allclose(w, c * x.T @ (weight * (label - p)), atol=1e-4)


def _counted(tmp_path, ignored, before=""):
    """(queries, numbered ones, with the pipeline, with SQL) of a copy of the repository without some files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", *ignored))
    code = before + "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
    total, numbered, pipeline, sql = done.stdout.split()
    return int(total), int(numbered), pipeline, int(sql)


@pytest.mark.parametrize("ignored", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_the_rest_works_without_the_corpus_operators(tmp_path, ignored):
    """The subpackage can be deleted, with or without the pipeline; all other queries stay."""
    total, numbered, pipeline, sql = _counted(tmp_path, ignored)
    assert total > 130 and numbered == 0 and pipeline == "False" and sql > 120


def test_the_rest_works_without_an_optional_package(tmp_path):
    """A machine without a package that only the corpus operators need keeps all other queries."""
    total, numbered, pipeline, sql = _counted(tmp_path, [], "import sys; sys.modules['xxhash'] = None; ")
    assert total > 130 and numbered == 0 and pipeline == "False" and sql > 120
