"""Hierarchical clustering of features: a merge table that any threshold cuts.

In a round every cluster finds its nearest neighbour, and all pairs that are nearest to each other merge at once. The linkages offered are
reducible: a merge never brings two clusters closer than their parts were, so these merges are those of one merge after the other, at the
same heights. Distances of merged clusters follow from those of their parts, first on one side of the pair table, then on the other. The
pair table stays distributed; a row per cluster reaches the driver in each round.
"""

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.graph import connected_components
from cytolake.runtime import cut

LINKAGES = ("single", "complete", "average", "ward")


def correlation_distances(corr: DataFrame, absolute: bool = False) -> DataFrame:
    """(a, b, distance) of all ordered pairs: 1 - r, or 1 - |r|; a constant feature correlates with none."""
    r = F.coalesce(F.abs("r") if absolute else F.col("r"), F.lit(0.0))
    pairs = corr.where("feature_a <> feature_b")
    return pairs.select(F.col("feature_a").alias("a"), F.col("feature_b").alias("b"), (F.lit(1.0) - r).alias("distance"))


def _joined(linkage: str) -> Column:
    """Distance of a merged cluster to another one from its parts': ``d1, n1``, ``d2, n2``, their own ``gap`` and the other's ``n``."""
    d1, d2, n1, n2, n, gap = (F.col(c) for c in ("d1", "d2", "n1", "n2", "n", "gap"))
    if linkage == "single":
        return F.least(d1, d2)
    if linkage == "complete":
        return F.greatest(d1, d2)
    if linkage == "average":
        return (n1 * d1 + n2 * d2) / (n1 + n2)
    return F.sqrt(F.greatest(F.lit(0.0), ((n1 + n) * d1 * d1 + (n2 + n) * d2 * d2 - n * gap * gap) / (n1 + n2 + n)))


def _side(pairs: DataFrame, parts: DataFrame, linkage: str) -> DataFrame:
    """``(b, a, distance, nb, na)``: the clusters of column ``a`` merged by ``parts`` (a, low, partner, gap), and the columns turned round."""
    told = pairs.join(F.broadcast(parts), "a", "left").where("partner is null or partner <> b")  # at most a row per cluster
    second = F.col("a") != F.coalesce("low", "a")
    of = lambda c, which: F.max(F.when(which, F.col(c)))
    both = told.groupBy(F.coalesce("low", "a").alias("to"), "b").agg(
        of("distance", ~second).alias("d1"), of("na", ~second).alias("n1"), of("distance", second).alias("d2"), of("na", second).alias("n2"),
        F.max("nb").alias("n"), F.max("gap").alias("gap"),
    )
    alone = F.col("d2").isNull()
    return both.select(
        F.col("b").alias("a"), F.col("to").alias("b"), F.when(alone, F.col("d1")).otherwise(_joined(linkage)).alias("distance"),
        F.col("n").alias("na"), (F.col("n1") + F.coalesce("n2", F.lit(0))).alias("nb"),
    )


def merge_table(distances: DataFrame, linkage: str = "ward") -> DataFrame:
    """(kept, gone, height, size) of every merge: the cluster is named after its first member, ``kept``.

    ``distances`` holds (a, b, distance) of all ordered pairs. Of equally near pairs the first by names merges first.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage}; choose one of {LINKAGES}")
    spark, kind, one = distances.sparkSession, distances.schema["a"].dataType.simpleString(), F.lit(1).cast("bigint")
    pairs = cut(distances.select("a", "b", F.col("distance").cast("double").alias("distance"), one.alias("na"), one.alias("nb")))
    found = []
    while True:
        to = F.min(F.struct("distance", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), (F.col("na") + F.col("nb")).alias("size")))
        nearest = [r["to"] for r in pairs.groupBy("a").agg(to.alias("to")).collect()]  # a row per cluster
        if not nearest:
            break
        named = Counter((n["low"], n["high"]) for n in nearest)
        of_pair = {(n["low"], n["high"]): n for n in sorted(nearest, reverse=True)}
        merges = [of_pair[p] for p, times in named.items() if times == 2] or [min(nearest)]
        found += [(m["low"], m["high"], m["distance"], m["size"]) for m in merges]
        rows = [(a, m["low"], b, m["distance"]) for m in merges for a, b in ((m["low"], m["high"]), (m["high"], m["low"]))]
        parts = spark.createDataFrame(rows, f"a {kind}, low {kind}, partner {kind}, gap double")
        pairs = cut(_side(_side(pairs, parts, linkage), parts, linkage))
    return cut(spark.createDataFrame(found, f"kept {kind}, gone {kind}, height double, size bigint"))


def clusters(features: DataFrame, merges: DataFrame, threshold: float) -> DataFrame:
    """(feature, representative): merges up to the height of the threshold; a cluster's first member stands for it."""
    edges = merges.where(F.col("height") <= threshold).select(F.col("kept").alias("u"), F.col("gone").alias("v"))
    linked = connected_components(edges)
    return features.select("feature").distinct().join(linked, F.col("feature") == F.col("node"), "left").select(
        "feature", F.coalesce("root", "feature").alias("representative")
    )


def representatives(features: DataFrame, merges: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, feature): the representatives at each threshold.

    A feature stands for its cluster until it is the one that goes in a merge, so one pass serves all thresholds.
    """
    until = features.select("feature").distinct().join(merges.select(F.col("gone").alias("feature"), "height"), "feature", "left")
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    held = F.filter(cuts, lambda t: F.col("height").isNull() | (F.col("height") > t))
    return until.select(F.explode(held).alias("threshold"), "feature")


def ranking(features: DataFrame, merges: DataFrame) -> DataFrame:
    """(feature, until): the features by the height at which they go, the last first; null never goes.

    The representatives at any threshold are the first ones of this order.
    """
    return features.select("feature").distinct().join(merges.select(F.col("gone").alias("feature"), F.col("height").alias("until")), "feature", "left")
