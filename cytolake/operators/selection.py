"""Feature ranking and selection on the long matrix.

Work over slides runs as Spark aggregates; only per-feature or feature-pair summaries (a few
hundred features by construction) are looked at one by one.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions.graph import connected_components
from cytolake.functions.ordering import running_totals
from cytolake.functions.pvalues import mann_whitney_p
from cytolake.operators.boruta import boruta  # noqa: F401  one of the selections
from cytolake.operators.matrix import correlations
from cytolake.runtime import cut

# Smallest redundancy, and the mean redundancy that rules a feature out.
REDUNDANCY_FLOOR = 0.001
REDUNDANT = 1.0


def anova_f(labelled: DataFrame) -> DataFrame:
    """One-way ANOVA F per feature of (feature, label, value)."""
    groups = labelled.groupBy("feature", "label").agg(
        F.count("value").alias("_n"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v")
    )
    classes = Window.partitionBy("feature")  # one row per class
    grand = F.sum(F.col("_n") * F.col("_m")).over(classes) / F.sum("_n").over(classes)
    parts = groups.withColumn("_g", grand).groupBy("feature").agg(
        F.sum(F.col("_n") * (F.col("_m") - F.col("_g")) * (F.col("_m") - F.col("_g"))).alias("_between"),
        F.sum(F.col("_n") * F.col("_v")).alias("_within"),
        F.count("*").alias("_k"),
        F.sum("_n").alias("_n"),
    )
    f = F.try_divide(F.col("_between") * (F.col("_n") - F.col("_k")), F.col("_within") * (F.col("_k") - 1))
    return parts.select("feature", f.alias("f_stat"))


def mrmr_ranking(labelled: DataFrame, k: int) -> DataFrame:
    """(rank, feature, score): greedy relevance over mean redundancy.

    Relevance is the F statistic, redundancy the absolute correlation to the features chosen before.
    """
    spark = labelled.sparkSession
    relevance = {r["feature"]: r["f_stat"] for r in anova_f(labelled).orderBy("feature").collect() if (r["f_stat"] or 0) > 0}
    pairs = correlations(labelled.select("slide_id", "feature", "value"), sorted(relevance)).collect()
    redundancy = {
        (r["feature_a"], r["feature_b"]): max(REDUNDANCY_FLOOR, abs(r["r"]) if r["r"] is not None else REDUNDANCY_FLOOR)
        for r in pairs
    }
    left, spent, chosen = dict(relevance), dict.fromkeys(relevance, 0.0), []
    while left and len(chosen) < k:
        def score(name: str) -> float:
            if not chosen:
                return left[name]
            mean = spent[name] / len(chosen)
            return 0.0 if mean == REDUNDANT else left[name] / mean

        best = max(left, key=score)
        chosen.append((len(chosen) + 1, best, float(score(best))))
        del left[best]
        for name in left:
            spent[name] += redundancy[(name, best)]
    return spark.createDataFrame(chosen, "rank int, feature string, score double")


def mann_whitney(labelled: DataFrame, with_p: bool = True) -> DataFrame:
    """Mann-Whitney U of label 0 against label 1 per feature, with average ranks for ties.

    ``u`` belongs to label 0, ``z`` to the larger U with tie and continuity correction. The p-value is
    exact for a group of at most 8 without ties, else normal.
    """
    tally = cut(
        labelled.where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("_t"), F.count_if(F.col("label") == 0).alias("_t0"))
    )
    ranked = running_totals(tally, ["feature"], "value", {"_upto": "_t"})
    avg_rank = F.col("_upto") - (F.col("_t") - 1) / 2
    cube = F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")
    sums = ranked.groupBy("feature").agg(
        F.sum("_t0").alias("n0"),
        F.sum(F.col("_t") - F.col("_t0")).alias("n1"),
        F.sum(F.col("_t0") * avg_rank).alias("_r0"),
        F.sum(cube.cast("double")).alias("_ties"),
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    u0 = F.col("_r0") - n0 * (n0 + 1) / 2
    high = F.greatest(u0, n0 * n1 - u0)
    sigma = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    out = sums.select(
        "feature",
        "n0",
        "n1",
        u0.alias("u"),
        high.alias("_high"),
        F.try_divide(high - n0 * n1 / 2 - F.lit(0.5), sigma).alias("z"),
        (F.col("_ties") > 0).alias("_tied"),
    )
    if with_p:
        out = out.withColumn("p", mann_whitney_p("z", "_high", "n0", "n1", "_tied"))
    return out.drop("_high", "_tied")


def best_by_p(tests: DataFrame, k: int) -> DataFrame:
    """The k features with the smallest p-value, ties by name."""
    return tests.orderBy(F.col("p").asc_nulls_last(), "feature").limit(k)


def correlated_pairs(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    return corr.where((F.col("feature_a") < F.col("feature_b")) & (F.abs("r") > threshold))


def correlation_groups(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(feature, representative): features linked by |r| above the threshold share the first name of their group."""
    edges = correlated_pairs(corr, threshold).select(F.col("feature_a").alias("u"), F.col("feature_b").alias("v"))
    linked = connected_components(edges)
    return (
        corr.select(F.col("feature_a").alias("feature"))
        .distinct()
        .join(linked, F.col("feature") == F.col("node"), "left")
        .select("feature", F.coalesce("root", "feature").alias("representative"))
    )


def threshold_scan(corr: DataFrame, thresholds: Sequence[float]) -> dict[float, DataFrame]:
    """Representatives for each threshold of a scan."""
    held = cut(corr)
    return {
        t: correlation_groups(held, t).select(F.col("representative").alias("feature")).distinct() for t in thresholds
    }
