import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.functions import ordering as O
from cytolake.functions import pvalues as PV
from cytolake.functions.graph import connected_components
from cytolake.functions.summary import distribution_summary, exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most of the rows and a third of them equal, a small group, a constant one."""
    rng = np.random.default_rng(1)
    hot = np.concatenate([rng.lognormal(0, 2, 40000), np.full(20000, 1.25)])
    data = {"hot": hot, "small": rng.normal(0, 1, 11), "flat": np.full(9, 0.1), "one": np.array([3.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    return data, spark.createDataFrame(rows, "g string, v double").repartition(8).cache()


@pytest.mark.parametrize("whole", [20000, 5])
def test_exact_quantiles(skewed, whole):
    data, df = skewed
    probs = {"a": 0.05, "b": 0.25, "c": 0.5, "d": 0.95}
    for r in exact_quantiles(df, ["g"], "v", probs, whole).collect():
        want = np.quantile(data[r["g"]], list(probs.values()))
        assert np.allclose([r["a"], r["b"], r["c"], r["d"]], want, rtol=1e-12)


def test_distribution_summary(skewed):
    data, df = skewed
    for r in distribution_summary(df, ["g"], "v").collect():
        v = data[r["g"]]
        d = v - v.mean()
        assert r["n"] == len(v)
        assert r["mean"] == pytest.approx(v.mean()) and r["MAD"] == pytest.approx(np.abs(d).mean(), abs=1e-12)
        assert r["median"] == pytest.approx(np.median(v)) and r["std"] == pytest.approx(v.std(), abs=1e-12)
        assert r["iqr"] == pytest.approx(np.subtract(*np.quantile(v, [0.75, 0.25])), abs=1e-12)
        if r["g"] in ("flat", "one"):
            assert r["skewness"] is None and r["kurt"] is None
        else:
            m2 = (d**2).mean()
            assert r["skewness"] == pytest.approx((d**3).mean() / m2**1.5)
            assert r["kurt"] == pytest.approx((d**4).mean() / m2**2 - 3)


def test_quantiles_of_a_group_of_millions(spark):
    """No task sorts more than a thousand of its values; a third of them are equal and the rest spans 40 orders of magnitude."""
    number = F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.exp((F.xxhash64("id") % 1000) / 22.0) + F.col("id") * 1e-7)
    df = spark.range(2_000_000).select(F.lit("g").alias("g"), number.alias("v"))
    want = np.sort(np.array([r[0] for r in df.select("v").toPandas().itertuples(index=False)]))
    probs = {"a": 0.0, "b": 0.1, "c": 1 / 3, "d": 0.5, "e": 0.987654321, "f": 1.0}
    got = exact_quantiles(df, ["g"], "v", probs, 1000).first()
    assert np.allclose([got[n] for n in probs], np.quantile(want, list(probs.values())), rtol=1e-12)


def test_missing_values_are_ignored(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)], "g string, v double")
    assert exact_quantiles(df, ["g"], "v", {"m": 0.5}).first()["m"] == 2


def test_running_totals_and_positions(spark):
    rng = np.random.default_rng(2)
    x = rng.permutation(5000)
    rows = [("hot" if v % 10 else "cold", int(v), int(v) % 13) for v in x]
    df = spark.createDataFrame(rows, "g string, o bigint, w bigint")
    for g in ("hot", "cold"):
        mine = sorted((o, w) for k, o, w in rows if k == g)
        want = np.cumsum([w for _, w in mine]).tolist()
        got = O.running_totals(df, ["g"], "o", {"t": "w"}, 16).where(F.col("g") == g).orderBy("o").collect()
        assert [r["t"] for r in got] == want
    numbered = O.positions(df, [], "o", "p").orderBy("o").collect()
    assert [r["p"] for r in numbered] == list(range(1, 5001))


def test_last_value_is_carried_over_empty_buckets(spark):
    rows = [("a", i, 7.0 if i == 3 else (8.0 if i == 900 else None)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o bigint, v double")
    got = [r["c"] for r in O.last_value_before(df, ["g"], "o", "v", "c", 16).orderBy("o").collect()]
    assert got == [None] * 3 + [7.0] * 897 + [8.0] * 100


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    noise = [tuple(int(v) for v in rng.integers(2000, 2400, 2)) for _ in range(250)]
    edges = chain + star + noise
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: find(n) for n in parent}


def test_tail_probabilities():
    assert PV.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    # n1 = n2 = 2: U in 0..4 with 1, 1, 2, 1, 1 of 6 orders
    assert PV._u_law(2, 2) == (1, 1, 2, 1, 1)
    assert PV.exact_u_two_sided(4, 2, 2) == pytest.approx(2 / 6)
    assert sum(PV._u_law(5, 7)) == math.comb(12, 5)
    # t with 1 degree of freedom is the Cauchy law, with 2 it has a closed form
    assert PV.student_two_sided(1.0, 1) == pytest.approx(0.5)
    assert PV.student_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6))
    assert PV.student_two_sided(0.0, 5) == 1.0
    assert PV.student_two_sided(1.96, 1e6) == pytest.approx(PV.normal_two_sided(1.96), abs=1e-5)
