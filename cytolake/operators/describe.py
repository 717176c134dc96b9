"""Descriptive tables behind the figures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.pvalues import student_p
from cytolake.functions.summary import exact_quantiles

_KEYS = ["feature", "label"]

# Names of the grades 0, 1, 2, and significance bands.
GRADES = ["-", "+", "++/+++"]
STARS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]


def grade_name(grade: Column) -> Column:
    out = None
    for i, name in enumerate(GRADES):
        out = F.when(grade == i, name) if out is None else out.when(grade == i, name)
    return out


def stars(p: Column) -> Column:
    out = None
    for limit, mark in STARS:
        out = F.when(p < limit, mark) if out is None else out.when(p < limit, mark)
    return out.otherwise("ns")


def box_stats(labelled: DataFrame) -> DataFrame:
    """Quartiles and whiskers (extreme values within 1.5 IQR of the box) per feature and label."""
    q = exact_quantiles(labelled, _KEYS, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    v = F.col("value")
    return (
        labelled.join(q, _KEYS)
        .groupBy(*_KEYS, "q1", "median", "q3")
        .agg(
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("low_whisker"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("high_whisker"),
            F.count_if((v < F.col("q1") - reach) | (v > F.col("q3") + reach)).alias("n_outliers"),
        )
    )


def t_test(labelled: DataFrame, with_p: bool = True) -> DataFrame:
    """Two-sample equal-variance t statistic of label 0 against label 1 per feature."""
    side = lambda c, agg: agg(F.when(F.col("label") == c, F.col("value")))
    s = labelled.groupBy("feature").agg(
        *[f(c, a).alias(n) for c in (0, 1) for f, a, n in (
            (side, F.count, f"_n{c}"), (side, F.avg, f"_m{c}"), (side, F.var_pop, f"_v{c}"))]
    )
    df = F.col("_n0") + F.col("_n1") - 2
    pooled = F.try_divide(F.col("_n0") * F.col("_v0") + F.col("_n1") * F.col("_v1"), df)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), "_n0") + F.try_divide(F.lit(1.0), "_n1")))
    out = s.select(
        "feature", F.try_divide(F.col("_m0") - F.col("_m1"), error).alias("t"), df.alias("df")
    )
    if with_p:
        out = out.withColumn("p", student_p("t", F.col("df").cast("double"))).withColumn("stars", stars(F.col("p")))
    return out


def density_curve(labelled: DataFrame, grid: int = 50, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density per feature and label on an even grid over the feature's range.

    Default bandwidth: Scott's rule, std * n^(-1/5). Equal values are counted first and each distinct
    value meets the fixed grid on the map side, so only grid sums are shuffled.
    """
    stats = labelled.groupBy(*_KEYS).agg(F.count("value").alias("_n"), F.stddev_samp("value").alias("_sd"))
    span = labelled.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = F.lit(bandwidth) if bandwidth is not None else F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    params = stats.join(span, "feature").withColumn("_h", width)
    tally = labelled.where(F.col("value").isNotNull()).groupBy(*_KEYS, "value").agg(F.count("*").alias("_w"))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / F.lit(float(grid - 1))
    z = F.try_divide(at - F.col("value"), F.col("_h"))
    return (
        tally.join(params, _KEYS)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
        .groupBy(*_KEYS, "i", "_n", "_h", at.alias("x"))
        .agg(F.sum(F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias("_s"))
        .select(*_KEYS, "i", "x", F.try_divide("_s", F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())).alias("density"))
    )
