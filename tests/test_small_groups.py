"""Groups of few rows are ordered by one window, larger ones by buckets, with the same rows."""

import pytest
from pyspark.sql import functions as F

from cytolake.functions import ordering as O


def rows(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 31 != 0, F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 100003).alias("o"),
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"),
    )


@pytest.mark.parametrize("run", [
    lambda df: O.positions(df, ["g"], "o", "nth"),
    lambda df: O.last_value_before(df, ["g"], "o", "v", "carried"),
    lambda df: O.running_totals(df, ["g"], "o", {"total": "o"}),
])
def test_both_ways_agree_and_small_groups_need_no_buckets(spark, monkeypatch, run):
    df = rows(spark, 700)
    plain = run(df)
    assert "Join" not in plain._jdf.queryExecution().toString()
    monkeypatch.setattr(O, "PLAIN_ROWS", 0)
    dealt = run(df)
    assert plain.dtypes == dealt.dtypes and plain.count() == dealt.count()
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()
