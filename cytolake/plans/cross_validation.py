"""Feature-count sweeps over cross-validation folds."""

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.operators import evaluation as E
from cytolake.operators import linkage as LK
from cytolake.operators import matrix as MX
from cytolake.operators import models as ML
from cytolake.operators import prefix_models as PM
from cytolake.operators import selection as S
from cytolake.runtime import cut

# name -> ranker(labelled training rows, k) -> (rank, feature, ..)
Ranker = Callable[[DataFrame, int], DataFrame]


def mrmr(train: DataFrame, k: int) -> DataFrame:
    return S.mrmr_ranking(train, k)


def mann_whitney(train: DataFrame, k: int) -> DataFrame:
    rows = [r["feature"] for r in S.best_by_p(S.mann_whitney(train), k).collect()]
    return train.sparkSession.createDataFrame(list(enumerate(rows, 1)), "rank int, feature string")


def boruta_ranker(rounds: int, **params) -> Ranker:
    """Confirmed features, most hits first; possibly none."""

    def rank(train: DataFrame, k: int) -> DataFrame:
        found = S.boruta(train, rounds=rounds, **params).where(F.col("decision") == "confirmed")
        rows = [r["feature"] for r in found.orderBy(F.col("hits").desc(), "feature").limit(k).collect()]
        return train.sparkSession.createDataFrame(list(enumerate(rows, 1)), "rank int, feature string")

    return rank


def group_ranker(linkage: str = "ward", absolute: bool = False) -> Ranker:
    """Features by how long they stand for their cluster: the representatives at any threshold are the first ones."""

    def rank(train: DataFrame, k: int) -> DataFrame:
        merges = LK.merge_table(LK.correlation_distances(MX.correlations(train.select("slide_id", "feature", "value")), absolute), linkage)
        order = LK.ranking(train, merges).orderBy(F.col("until").desc_nulls_first(), "feature").limit(k)
        rows = [r["feature"] for r in order.collect()]
        return train.sparkSession.createDataFrame(list(enumerate(rows, 1)), "rank int, feature string")

    return rank


def sweep(
    fm: DataFrame,
    labels: DataFrame,
    folds: DataFrame,
    ranker: Ranker,
    model: str,
    ks: Sequence[int],
    parallelism: int = 4,
    **params,
) -> tuple[DataFrame, DataFrame]:
    """(fold, k, score) and the rankings (fold, rank, feature) of a k sweep.

    Features are ranked on a fold's training part only. The linear models of all folds and counts are fitted together, in a
    handful of jobs. The fits of other models are independent Spark jobs, started from a small thread pool; for them
    the matrix is pivoted once per fold, in rank order, and sliced for each k.
    """
    spark = fm.sparkSession
    labelled = cut(fm.join(labels.select("slide_id", "label"), "slide_id").join(folds.select("slide_id", "fold"), "slide_id"))
    numbers = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]

    def ranking(fold: int) -> list[str]:
        train = labelled.where(F.col("fold") != fold).drop("fold")
        return [r["feature"] for r in ranker(train, max(ks)).orderBy("rank").collect()]

    def parts(fold: int) -> tuple[DataFrame, DataFrame]:
        names = ranked[fold]
        vectors = MX.to_vectors(labelled.where(F.col("feature").isin(names)), names, ["slide_id", "label", "fold"])
        signed = cut(vectors.withColumn("signed", (F.col("label") * 2 - 1).cast("double")).withColumnRenamed("features", "ranked"))
        train = cut(ML.balanced_weights(signed.where(F.col("fold") != fold)))  # weights of the training part alone
        return train, signed.where(F.col("fold") == fold)

    def score(job: tuple[int, int]) -> tuple[int, int, float | None]:
        fold, k = job
        first = VectorSlicer(inputCol="ranked", outputCol="features", indices=list(range(k)))
        train, test = map(first.transform, split[fold])
        scored = ML.predict(ML.fit(train, model, **params), test)
        return fold, k, E.balanced_accuracy(scored).first()[0]

    with ThreadPoolExecutor(parallelism) as pool:
        ranked = dict(zip(numbers, pool.map(ranking, numbers)))
        ranks = [(f, i, n) for f in numbers for i, n in enumerate(ranked[f], 1)]
        rankings = spark.createDataFrame(ranks, "fold int, rank int, feature string")
        filled = [f for f in numbers if ranked[f]]
        if model in PM.JOINT and set(params) <= {"C", "alpha"}:
            used = sorted({n for own in ranked.values() for n in own})
            rows = PM.sample_rows(labelled.where(F.col("feature").isin(used)), used)
            return cut(PM.prefix_scores(rows, used, ranked, sorted(set(ks)), model, **params)), rankings
        split = dict(zip(filled, pool.map(parts, filled)))
        jobs = [(f, k) for f in filled for k in sorted(set(ks), reverse=True) if 0 < k <= len(ranked[f])]
        results = list(pool.map(score, jobs))
    return spark.createDataFrame(results, "fold int, k int, score double"), rankings


def model_table(train: DataFrame, test: DataFrame, selections: Mapping[str, Sequence[str]], models: Sequence[str], **params) -> DataFrame:
    """(selection, model, n_features, accuracy, balanced_accuracy) of every model on every selection of features.

    ``train`` and ``test`` are long rows (slide_id, label, feature, value); models are fitted on the one and scored on the
    other. An empty selection has no rows. The fits are independent jobs, as many as there are models and selections.
    """
    spark = train.sparkSession
    rows = []
    for name, features in selections.items():
        if not features:
            continue
        keys = ["slide_id", "label"]
        vectors = [MX.to_vectors(part.where(F.col("feature").isin(list(features))), list(features), keys) for part in (train, test)]
        fitted_on = cut(ML.balanced_weights(vectors[0].withColumn("signed", (F.col("label") * 2 - 1).cast("double"))))
        held_out = cut(vectors[1])
        for model in models:
            scored = cut(ML.predict(ML.fit(fitted_on, model, **params.get(model, {})), held_out))
            rows.append((name, model, len(features), E.accuracy(scored).first()[0], E.balanced_accuracy(scored).first()[0]))
    return spark.createDataFrame(rows, "selection string, model string, n_features int, accuracy double, balanced_accuracy double")


def final_features(rankings: DataFrame, best_k: int, count: int) -> DataFrame:
    """(position, feature, count, score): the consensus features in order, the first ``count`` of them."""
    ranked = E.consensus_ranking(rankings, best_k).orderBy(F.col("count").desc(), F.col("score").desc(), "feature").limit(count)
    rows = [(i, r["feature"], r["count"], r["score"]) for i, r in enumerate(ranked.collect(), 1)]  # `count` rows
    return rankings.sparkSession.createDataFrame(rows, "position int, feature string, count bigint, score double")


def write_report(scores: DataFrame, rankings: DataFrame, all_features: int, path: str) -> None:
    """The report as one JSON line per feature."""
    report(scores, rankings, all_features).write.mode("overwrite").json(path)


def report(scores: DataFrame, rankings: DataFrame, all_features: int) -> DataFrame:
    """Best mean score and its feature count, the mean with all features, and the consensus features."""
    by_count = E.score_by_count(E.common_counts(scores))
    best = E.best_count(by_count).select(F.col("k").alias("best_k"), F.col("mean").alias("best_mean"))
    full = by_count.where(F.col("k") == all_features).select(F.col("mean").alias("all_mean"))
    head = best.collect()[0]  # one row
    whole = full.collect()
    ranked = E.consensus_ranking(rankings, head["best_k"])
    return ranked.select(
        "feature",
        "count",
        "score",
        F.lit(head["best_k"]).alias("best_k"),
        F.lit(head["best_mean"]).alias("best_mean"),
        F.lit(whole[0]["all_mean"] if whole else None).cast("double").alias("all_mean"),
    )
