"""Fold assignment for cross-validation: (slide_id, fold)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions.ordering import positions


def stratified_folds(samples: DataFrame, n_folds: int) -> DataFrame:
    """Unshuffled stratified k-fold of (slide_id, label, sample_ord).

    With classes laid end to end in order of first appearance, fold i is owed one sample of a class for each
    of its places p with p mod k = i; a class hands its samples to the folds in turn, in sample order.
    """
    classes = samples.groupBy("label").agg(F.min("sample_ord").alias("_first"), F.count("*").alias("_n"))
    # one row per class
    before = Window.partitionBy(F.lit(0)).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    fold_of = F.sequence(F.lit(0), F.lit(n_folds - 1))
    owed = F.transform(
        fold_of,
        lambda i: F.floor((F.col("_s") + F.col("_n") - 1 - i) / F.lit(n_folds))
        - F.floor((F.col("_s") - 1 - i) / F.lit(n_folds)),
    )
    quotas = classes.withColumn("_s", start).withColumn("_owed", owed)
    upto = F.transform(
        fold_of,
        lambda i: F.aggregate(F.slice("_owed", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x),
    )
    quotas = quotas.select("label", upto.alias("_upto"))
    numbered = positions(samples.select("slide_id", "label", "sample_ord"), ["label"], "sample_ord", "_j")
    return numbered.join(quotas, "label").select(
        "slide_id", "label", "sample_ord", F.size(F.filter("_upto", lambda u: u < F.col("_j"))).alias("fold")
    )


def leave_one_group_out(samples: DataFrame, group: str = "cohort_id") -> DataFrame:
    """One fold per group, numbered by group id."""
    ids = positions(samples.select(group).distinct(), [], group, "_g")
    return samples.join(ids, group).select("slide_id", group, (F.col("_g") - 1).cast("int").alias("fold"))
