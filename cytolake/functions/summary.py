"""Exact distribution summaries of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here each wanted rank has an open interval
of values it lies in, at first all of its group. While an interval holds more values than a task should sort, a histogram of
the interval, with about as many values in each bin, gives two bounds close to the rank; exact counts below, on and between them
narrow the interval, or settle the rank if it falls on a bound, as it does where values repeat. What is left
of an interval is sorted by one task. Groups of few values need no narrowing, but take the same way.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.joins import counted_side
from cytolake.functions.ordering import linear_position
from cytolake.runtime import cut

#: values of an interval that one task sorts
SORTED = 20_000
#: bins of a histogram, and the accuracy of the sketch that finds their bounds
BINS = 256
ACCURACY = 10_000


def _values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    number = F.col(value).cast("double")
    return df.where(F.col(value).isNotNull() & ~F.isnan(number)).select(*keys, number.alias("_v"))


def _ranks(probs: Sequence[float]) -> Column:
    """The two order statistics around each quantile: number and 0-based rank."""
    out = []
    for i, p in enumerate(probs):
        low = F.floor(linear_position(F.col("_n"), p)).cast("bigint")
        out += [(2 * i, low), (2 * i + 1, F.least(low + 1, F.col("_n") - 1))]
    return F.array(*[F.struct(F.lit(j).alias("j"), r.alias("at")) for j, r in out])


def _inside(values: DataFrame, intervals: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``values`` next to each interval of their group that holds them; a bound that is null is none."""
    held = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    return values.join(counted_side(intervals, rows), keys).where(held)


def _narrowed(values: DataFrame, large: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``(keys, j, at, _lo, _hi, _v)``: intervals of at most ``most`` values, or the value of the rank itself."""
    state = cut(large)
    rank = [*keys, "j"]
    while True:
        open_ = cut(state.where((F.col("_left") > most) & F.col("_value").isNull()))
        rows = open_.count()
        if not rows:
            return state
        grid = [i / BINS for i in range(BINS + 1)]
        bounds = _inside(values, open_, keys, rows).groupBy(*rank).agg(F.percentile_approx("_v", grid, ACCURACY).alias("_bounds"))
        at = F.floor(F.col("at") * BINS / F.col("_left")).cast("int")  # 0 to BINS - 1
        near = open_.join(bounds, rank).withColumns({
            "_a": F.get("_bounds", F.greatest(at - 1, F.lit(0))), "_b": F.get("_bounds", F.least(at + 2, F.lit(BINS))),
        }).drop("_bounds")
        near = cut(near)
        v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
        counts = _inside(values, near, keys, rows).groupBy(*rank).agg(
            F.count_if(v < a).alias("_below"), F.count_if(v == a).alias("_on_a"),
            F.count_if((v > a) & (v < b)).alias("_between"), F.count_if((v == b) & (b > a)).alias("_on_b"),
        )
        ends = [F.col("_below"), F.col("_below") + F.col("_on_a")]
        ends += [ends[1] + F.col("_between"), ends[1] + F.col("_between") + F.col("_on_b")]
        place = F.col("at")

        def chosen(*five: Column) -> Column:
            """What goes for a rank below the first bound, on it, between them, on the second bound and above it."""
            out = F.when(place < ends[0], five[0])
            for end, c in zip(ends[1:], five[1:4]):
                out = out.when(place < end, c)
            return out.otherwise(five[4])

        zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
        told = near.join(counts, rank).select(
            *rank, (place - chosen(zero, place, ends[1], place, ends[3])).alias("at"),
            chosen(F.col("_lo"), none, a, none, b).alias("_lo"), chosen(a, none, b, none, F.col("_hi")).alias("_hi"),
            chosen(F.col("_below"), zero, F.col("_between"), zero, F.col("_left") - ends[3]).alias("_left"),
            chosen(none, a, none, b, none).alias("_value"),
        )
        state = cut(state.where((F.col("_left") <= most) | F.col("_value").isNotNull()).unionByName(told))


def _picked(values: DataFrame, moments: DataFrame, keys: list[str], probs: Sequence[float], most: int, *sums: Column) -> DataFrame:
    """A row per group: columns ``_q0, _q1 ..`` with the order statistics of ``probs``, and ``sums`` over the group.

    ``moments`` is stored and has the number of values as ``_n``; its columns are there for the sums.
    """
    about = moments.agg(F.count(F.lit(1)).alias("rows"), F.max("_n").alias("largest")).first()
    none = F.lit(None).cast("double")
    wanted = F.when(F.col("_n") <= most, _ranks(probs)).otherwise(F.array().cast("array<struct<j:int,at:bigint>>"))
    intervals = moments.withColumns({"_lo": none, "_hi": none, "_whole": F.lit(True), "_wanted": wanted})
    settled, rows = None, about["rows"]
    if (about["largest"] or 0) > most:
        large = moments.where(F.col("_n") > most).select(*keys, F.col("_n").alias("_left"), F.inline(_ranks(probs)))
        state = _narrowed(values, large.select(*keys, "j", "at", none.alias("_lo"), none.alias("_hi"), "_left", none.alias("_value")), keys, most)
        settled = state.where(F.col("_value").isNotNull()).select(*keys, "j", F.col("_value").alias("value"))
        parts = state.where(F.col("_value").isNull()).groupBy(*keys, "_lo", "_hi").agg(F.collect_list(F.struct("j", "at")).alias("_wanted"))
        parts = parts.join(moments, keys).withColumn("_whole", F.lit(False))
        intervals = cut(intervals.unionByName(parts.select(*intervals.columns)))
        rows += len(probs) * 2 * rows
    listed = F.sort_array(F.collect_list(F.when(F.size("_wanted") > 0, F.col("_v"))))
    each = _inside(values, intervals, keys, rows).groupBy(*keys, "_lo", "_hi", "_whole").agg(
        listed.alias("_list"), F.first("_wanted").alias("_wanted"), *[F.sum(s).alias(f"_sum{i}") for i, s in enumerate(sums)]
    )
    found = F.transform("_wanted", lambda w: F.struct(w["j"].alias("j"), F.get("_list", w["at"].cast("int")).alias("value")))
    told = each.select(*keys, "_whole", found.alias("_found"), *[f"_sum{i}" for i in range(len(sums))])
    if settled is not None:
        one = F.array(F.struct("j", "value"))
        told = told.unionByName(settled.select(*keys, F.lit(False).alias("_whole"), one.alias("_found")), allowMissingColumns=True)
    of = lambda j: F.max(F.get(F.filter("_found", lambda x: x["j"] == j), F.lit(0))["value"]).alias(f"_q{j}")
    whole = [F.max(F.when(F.col("_whole"), F.col(f"_sum{i}"))).alias(f"_sum{i}") for i in range(len(sums))]
    return told.groupBy(*keys).agg(*[of(j) for j in range(2 * len(probs))], *whole)


def _quantile(i: int, p: float) -> Column:
    """Linear interpolation between the order statistics around a quantile."""
    low, high = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
    part = linear_position(F.col("_n"), p) - F.floor(linear_position(F.col("_n"), p))
    return low + F.when(part > 0, (high - low) * part).otherwise(F.lit(0.0))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], most: int = SORTED) -> DataFrame:
    """One row per group with each named quantile (linear interpolation), NULL/NaN ignored."""
    keys, ps = list(keys), list(probs.values())
    values = _values(df, keys, value)
    moments = cut(values.groupBy(*keys).agg(F.count("_v").alias("_n")))
    picked = _picked(values, moments, keys, ps, most).join(moments, keys)
    return picked.select(*keys, *[_quantile(i, p).alias(n) for i, (n, p) in enumerate(probs.items())])


STATS = ["mean", "std", "median", "MAD", "skewness", "kurt", "iqr"]


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str, most: int = SORTED) -> DataFrame:
    """Seven statistics per group: mean, population std, median, mean absolute deviation
    about the mean, population skewness, excess kurtosis, inter-quartile range."""
    keys, ps = list(keys), [0.25, 0.5, 0.75]
    values = _values(df, keys, value)
    moments = cut(
        values.groupBy(*keys).agg(
            F.count("_v").alias("_n"), F.avg("_v").alias("_mean"), F.stddev_pop("_v").alias("_std"), F.skewness("_v").alias("_skew"),
            F.kurtosis("_v").alias("_kurt"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        )
    )
    picked = _picked(values, moments, keys, ps, most, F.abs(F.col("_v") - F.col("_mean"))).join(moments, keys)
    flat = F.col("_least") == F.col("_most")
    return picked.select(
        *keys,
        F.col("_n").alias("n"),
        F.col("_mean").alias("mean"),
        F.col("_std").alias("std"),
        _quantile(1, 0.5).alias("median"),
        (F.col("_sum0") / F.col("_n")).alias("MAD"),
        F.when(~flat, F.col("_skew")).alias("skewness"),
        F.when(~flat, F.col("_kurt")).alias("kurt"),
        (_quantile(2, 0.75) - _quantile(0, 0.25)).alias("iqr"),
    )
