"""Ordered computations that never put a whole group into one task.

A plain window over a group sorts that group in a single task. These helpers cut each
group into value buckets first, so one group holding a third of the table is
spread over many tasks and only per-bucket totals are put in order per group. Where all groups are small, a plain window does.
"""

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.runtime import cut

#: buckets of a group at first, and rows of a bucket beyond which a group gets more of them
BUCKETS = 64
BUCKET_ROWS = 1_000_000
#: rows of the largest group up to which a plain window orders all of them
PLAIN_ROWS = 10_000


def _bucket_bounds(df: DataFrame, group: list[str], order: str, buckets: int) -> DataFrame:
    """Per group the values that cut it into buckets, as many as its size asks for.

    The bounds come from a mergeable quantile sketch; its accuracy grows with the number of buckets.
    """

    def bounds_of(n: int) -> DataFrame:
        cuts = [i / n for i in range(1, n)]
        return cut(df.groupBy(*group).agg(F.percentile_approx(order, cuts, max(1000, 20 * n)).alias("_bounds"), F.count(F.lit(1)).alias("_rows")))

    bounds = bounds_of(buckets)
    wanted = -(-(bounds.agg(F.max("_rows")).first()[0] or 0) // BUCKET_ROWS)
    return (bounds_of(wanted) if wanted > buckets else bounds).drop("_rows")


def _small_groups(df: DataFrame, keys: list[str]) -> bool:
    if not keys:
        return False
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows"))
    return (largest.first()[0] or 0) <= PLAIN_ROWS


def _without_null(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group with a null among its keys meet no bucket."""
    return df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, str],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``name`` = sum of ``column`` over the rows up to and including this one.

    ``totals`` maps new name -> column. ``order`` is numeric, not null and unique within ``keys``
    (aggregate ties away first). Bucket bounds come from a mergeable quantile sketch
    and are materialised, so that every branch of the plan cuts at the same places.
    """
    keys = list(keys)
    if _small_groups(df, keys):
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return _without_null(df, keys).withColumns({n: F.sum(c).over(whole) for n, c in totals.items()})
    anchored = df.withColumn("_all", F.lit(1)) if not keys else df
    group = keys or ["_all"]
    bounds = _bucket_bounds(anchored, group, order, buckets)
    if not keys:  # exactly one row of `buckets` numbers
        bounds = F.broadcast(bounds)
    tagged = anchored.join(bounds, group).withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(order)))
    ).drop("_bounds")

    per_bucket = tagged.groupBy(*group, "_bucket").agg(
        *[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()]
    )
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals],
    )
    within = (
        Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = tagged.join(offsets, group + ["_bucket"])
    for n, c in totals.items():
        out = out.withColumn(n, F.col(f"_off_{n}") + F.sum(c).over(within))
    drop = ["_bucket", *[f"_off_{n}" for n in totals]] + ([] if keys else ["_all"])
    return out.drop(*drop)


def positions(df: DataFrame, keys: Sequence[str], order: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """1-based row number within ``keys`` by the unique numeric column ``order``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, keys, order, {name: "_one"}, buckets).drop("_one")


def last_value_before(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, buckets: int = BUCKETS
) -> DataFrame:
    """Carry the last non-null ``value`` forward along ``order`` (this row included)."""
    keys = list(keys)
    if _small_groups(df, keys):
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return _without_null(df, keys).withColumn(name, F.last(value, ignorenulls=True).over(whole))
    bounds = _bucket_bounds(df, keys, order, buckets)
    tagged = df.join(bounds, keys).withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(order)))
    ).drop("_bounds")
    ends = tagged.where(F.col(value).isNotNull()).groupBy(*keys, "_bucket").agg(
        F.max_by(value, order).alias("_end")
    )
    # buckets without any value still need what the earlier ones ended with
    seen = tagged.groupBy(*keys, "_bucket").agg(F.lit(1).alias("_seen")).join(ends, keys + ["_bucket"], "left")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    within = (
        Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        tagged.join(carried, keys + ["_bucket"])
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carry")))
        .drop("_bucket", "_carry")
    )


def linear_position(n: Column, p: float) -> Column:
    """0-based fractional rank of quantile ``p`` under linear interpolation."""
    return F.lit(float(p)) * (n - F.lit(1))
