"""The long feature matrix ``fm(slide_id, feature, value)`` and its row and column operations."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.ordering import positions, running_totals
from cytolake.functions.summary import exact_quantiles
from cytolake.runtime import cut


def drop_missing(fm: DataFrame) -> DataFrame:
    return fm.where(F.col("value").isNotNull() & ~F.isnan("value"))


def project_features(fm: DataFrame, features: DataFrame) -> DataFrame:
    return fm.join(features.select("feature").distinct(), "feature", "left_semi")


def topk_predefined(fm: DataFrame, ranking: DataFrame, k: int = 19) -> DataFrame:
    """Features among the first k of a ranking; a ranked name the matrix lacks is an error."""
    wanted = ranking.where(F.col("rank") <= k).select("feature", "rank")
    known = fm.select("feature").distinct().withColumn("_known", F.lit(True))
    checked = wanted.join(known, "feature", "left").select(
        F.when(F.col("_known"), F.col("feature"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown feature: "), F.col("feature"))).cast("string"))
        .alias("feature"),
        "rank",
    )
    return fm.join(checked, "feature")


def require_both_classes(labels: DataFrame) -> DataFrame:
    """(n0, n1); an error when either class is missing."""
    n = labels.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    ok = (F.col("n0") > 0) & (F.col("n1") > 0)
    fail = F.raise_error(F.lit("both label classes are needed")).cast("bigint")
    return n.select(F.when(ok, F.col("n0")).otherwise(fail).alias("n0"), "n1")


def trim_outliers(labelled: DataFrame, p: float = 0.1, reference_label: int | None = None) -> DataFrame:
    """Values strictly between the p/2 and 1-p/2 quantiles of their feature.

    With ``reference_label`` the quantiles of that class bound every class.
    """
    base = labelled if reference_label is None else labelled.where(F.col("label") == reference_label)
    q = exact_quantiles(base, ["feature"], "value", {"_low": p / 2, "_high": 1 - p / 2})
    return labelled.join(q, "feature").where("value > _low and value < _high").drop("_low", "_high")


def convert_unit(value: Column, factor: float = 0.053) -> Column:
    """Square pixels to square micrometres by default."""
    return value * F.lit(factor)


def feature_names(fm: DataFrame) -> list[str]:
    """Feature names, sorted. A few hundred by construction of the catalogue."""
    return [r[0] for r in fm.select("feature").distinct().orderBy("feature").collect()]


def to_wide(fm: DataFrame, names: Sequence[str], keys: Sequence[str] = ("slide_id",)) -> DataFrame:
    return fm.groupBy(*keys).pivot("feature", list(names)).agg(F.first("value"))


def to_vectors(fm: DataFrame, names: Sequence[str], keys: Sequence[str] = ("slide_id",)) -> DataFrame:
    """Wide matrix with a ``features`` vector; rows with a missing feature are an error."""
    wide = to_wide(fm, names, keys)
    cols = [f"_x{i}" for i in range(len(names))]
    plain = wide.select(*keys, *[F.col(f"`{n}`").alias(c) for n, c in zip(names, cols)])
    return VectorAssembler(inputCols=cols, outputCol="features").transform(plain).select(*keys, "features")


def correlations(fm: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of all feature pairs (feature_a, feature_b, r), both orders and the diagonal.

    Every partition centres its rows on the feature means, adds up its cross products in one matrix product and emits
    the sums of each unordered pair; slides never meet each other, and the other order of a pair is the same row read the
    other way round. Pairs use the slides that have both values; a constant feature gives NULL.
    """
    known = {r["feature"]: r["m"] for r in fm.groupBy("feature").agg(F.avg("value").alias("m")).collect()}  # a row per feature
    names = list(names) if names is not None else sorted(known)
    size, centre = len(names), np.array([known.get(n) or 0.0 for n in names])
    wide = to_wide(fm, names).drop("slide_id").toDF(*[f"x{i}" for i in range(size)])
    columns = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = None
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64) - centre
            held = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x)
            now = np.stack([held.T @ held, x.T @ held, held.T @ x, (x * x).T @ held, held.T @ (x * x), x.T @ x])
            parts = now if parts is None else parts + now
        if parts is not None:
            i, j = np.triu_indices(size)
            values = {c: p[i, j] for c, p in zip(columns, parts)}
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), **values})

    cells = (
        wide.mapInPandas(sums, "i int, j int, " + ", ".join(f"{c} double" for c in columns))
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in columns])
    )
    c = F.col
    var_x, var_y = c("n") * c("sxx") - c("sx") * c("sx"), c("n") * c("syy") - c("sy") * c("sy")
    tiny = F.lit(1e-12)
    spread = (var_x > tiny * c("n") * c("sxx")) & (var_y > tiny * c("n") * c("syy"))
    r = F.when(spread, (c("n") * c("sxy") - c("sx") * c("sy")) / F.sqrt(var_x * var_y))
    listed = F.array(*[F.lit(n) for n in names])
    one, other = F.struct(c("i").alias("a"), c("j").alias("b")), F.struct(c("j").alias("a"), c("i").alias("b"))
    orders = F.when(c("i") == c("j"), F.array(one)).otherwise(F.array(one, other))
    return cells.select(r.alias("r"), F.explode(orders).alias("p")).select(
        listed[c("p.a")].alias("feature_a"), listed[c("p.b")].alias("feature_b"), "r"
    )


def sample_order(slides: DataFrame, key: str = "slide_id") -> DataFrame:
    """Slides numbered from 0 by name. One row per slide, range-sorted by Spark.

    For a numeric ``key`` use :func:`numeric_sample_order`, which needs no global sort.
    """
    ordered = slides.select(key).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key)
    held = cut(ordered.select(key, F.monotonically_increasing_id().alias("_mono")))
    return positions(held, [], "_mono", "sample_ord").withColumn("sample_ord", F.col("sample_ord") - 1).drop("_mono")


def numeric_sample_order(slides: DataFrame, key: str = "slide_id") -> DataFrame:
    return positions(slides.select(key).distinct(), [], key, "sample_ord").withColumn(
        "sample_ord", F.col("sample_ord") - 1
    )


def random_holdout(samples: DataFrame, percent: float = 15.0, seed: int = 0, key: str = "slide_id") -> DataFrame:
    """Mark ``int(n * percent / 100)`` samples as held out, by the order of a salted MD5 of their name."""
    ids = samples.select(key).distinct()
    taken = int(ids.count() * percent / 100.0)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    # 13 hex digits; two samples sharing them are ordered by name
    hashed = ids.withColumn("_h", F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint"))
    tied = hashed.groupBy("_h").agg(F.sort_array(F.collect_list(key)).alias("_ids"))
    ranked = running_totals(tied.withColumn("_k", F.size("_ids").cast("bigint")), [], "_h", {"_upto": "_k"})
    pos = (F.col("_upto") - F.size("_ids") + F.col("_i") + 1).alias("pos")
    each = ranked.select("_upto", "_ids", F.posexplode("_ids").alias("_i", key)).select(key, pos)
    return each.select(key, "pos", (F.col("pos") <= taken).alias("held_out"))


def closest_sized(lists: DataFrame, size: int) -> DataFrame:
    """The list whose length is nearest to ``size``; the first on a tie."""
    return lists.orderBy(F.abs(F.size("items") - F.lit(size)), "pos").limit(1)


def positions_by_value(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Positions of every value in rising order: (value, nth, pos), nth from 0.

    Long form, as a frequent value may have more positions than fit into one row. ``pos`` is a unique
    number.
    """
    numbered = positions(df.select(value, pos), [value], pos, "nth")
    return numbered.select(value, (F.col("nth") - 1).alias("nth"), pos)


def ordered_ids(df: DataFrame, name: str, pos: str) -> DataFrame:
    """Names numbered from 1 in order of first appearance: (name, id)."""
    first = df.groupBy(name).agg(F.min(pos).alias("_first"))
    return positions(first, [], "_first", "id").drop("_first")
