"""Classifiers over the feature matrix, built from Spark ML."""

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# name -> estimator factory; parameters may be overridden by keyword
ESTIMATORS = {
    "boosted_trees": lambda **kw: GBTClassifier(
        **{"maxIter": 100, "stepSize": 0.3, "maxDepth": 6, "seed": 0, "labelCol": "label", **kw}
    ),
    "boosted_trees_slow": lambda **kw: GBTClassifier(
        **{"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "seed": 42, "labelCol": "label", **kw}
    ),
    "logistic": lambda **kw: LogisticRegression(
        **{"elasticNetParam": 0.0, "standardization": False, "weightCol": "weight", "labelCol": "label", **kw}
    ),
    "forest": lambda **kw: RandomForestClassifier(
        **{"numTrees": 10, "maxDepth": 30, "seed": 84, "weightCol": "weight", "labelCol": "label", **kw}
    ),
    "ridge": lambda **kw: LinearRegression(
        **{"elasticNetParam": 0.0, "standardization": False, "solver": "normal", "labelCol": "signed", **kw}
    ),
}

# penalties as the sum over samples: inverse strength C of the logistic model, alpha of ridge
DEFAULT_C = 1.0
DEFAULT_ALPHA = 0.0


def penalties(rows: DataFrame, model: str, params: Mapping) -> dict:
    """Spark's penalty per unit of weight: 1 / (C n) for logistic and alpha / n for ridge regression.

    Spark divides the penalty of a regression by the deviation of the label, which is taken back. ``C`` and ``alpha``
    are taken from ``params``; a ``regParam`` given there is left as it is.
    """
    out = {k: v for k, v in params.items() if k not in ("C", "alpha")}
    if model in ("logistic", "ridge") and "regParam" not in out:
        n = rows.count()  # balanced weights add up to n as well
        strength = 1.0 / params.get("C", DEFAULT_C) if model == "logistic" else params.get("alpha", DEFAULT_ALPHA)
        spread = rows.agg(F.stddev_pop("signed")).first()[0] or 1.0 if model == "ridge" and strength else 1.0
        out["regParam"] = float(strength) * spread / max(n, 1)
    return out


def balanced_weights(samples: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes * class size)."""
    counts = samples.groupBy(label).agg(F.count("*").alias("_c"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    weights = counts.select(
        label, (F.sum("_c").over(every) / (F.count("*").over(every) * F.col("_c"))).alias("weight")
    )
    return samples.join(weights, label)


def training_rows(vectors: DataFrame, labels: DataFrame, key: str = "slide_id") -> DataFrame:
    """Vectors with label, balanced weight, and the label as -1 / +1 for regression-based classifiers."""
    joined = vectors.join(labels.select(key, "label"), key)
    return balanced_weights(joined).withColumn("signed", (F.col("label") * 2 - 1).cast("double"))


def fit(rows: DataFrame, model: str, **params) -> PipelineModel:
    if model not in ESTIMATORS:
        raise ValueError(f"unknown classifier {model}; choose one of {sorted(ESTIMATORS)}")
    return Pipeline(stages=[ESTIMATORS[model](**penalties(rows, model, params))]).fit(rows)


def predict(fitted: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``proba`` of class 1 (for ridge: the signed score moved to 0..1 scale) and ``pred``."""
    out = fitted.transform(rows)
    if "probability" in out.columns:
        out = out.withColumn("proba", vector_to_array("probability")[1])
    else:
        out = out.withColumn("proba", (F.col("prediction") + 1) / 2)
    return out.withColumn("pred", (F.col("proba") > threshold).cast("int")).drop(
        "rawPrediction", "probability", "prediction"
    )


def save(fitted: PipelineModel, path: str) -> None:
    fitted.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def grid_search(
    rows: DataFrame, model: str, grid: Mapping[str, Sequence], folds: int = 3, parallelism: int = 4, **params
) -> CrossValidatorModel:
    """Parameter search by k-fold balanced accuracy (recall averaged by weight)."""
    estimator = ESTIMATORS[model](**penalties(rows, model, params))
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    scorer = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label", weightCol="weight")
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(), evaluator=scorer, numFolds=folds,
        parallelism=parallelism, seed=0,
    ).fit(rows)


def principal_components(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """Standardised rows projected on k components (``pca``), and the explained variance shares."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    fitted = Pipeline(stages=[scaler, PCA(k=k, inputCol="scaled", outputCol="pca")]).fit(vectors)
    return fitted.transform(vectors).drop("scaled"), [float(v) for v in fitted.stages[1].explainedVariance]
