"""Approximate profiles and correlations of many columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsheet.operators import profile


def test_an_approximate_profile_takes_one_exchange(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate", "l_comment" if "l_comment" in spark.read.parquet(f"{sf}/lineitem.parquet").columns else "l_linestatus")
    about = profile.profile(lines, exact=False)
    plan = about._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    true = {r["column"]: r for r in profile.profile(lines).collect()}
    for r in about.collect():
        t = true[r["column"]]
        assert (r["type"], r["count"], r["nulls"], r["min"], r["max"]) == (t["type"], t["count"], t["nulls"], t["min"], t["max"])
        assert abs(r["unique"] - t["unique"]) <= max(2, 0.08 * t["unique"])
        if t["median"] is not None:
            values = sorted(float(x[0]) for x in lines.select(r["column"]).collect())
            for name, share in (("median", 0.5), ("q1", 0.25), ("q3", 0.75)):
                low, high = np.searchsorted(values, r[name], "left"), np.searchsorted(values, r[name], "right")
                assert low / len(values) - 0.01 <= share <= high / len(values) + 0.01
            assert sum(r["histogram"]) == len(values) and max(abs(a - b) for a, b in zip(r["histogram"], t["histogram"], strict=True)) <= 0.02 * len(values)
        else:
            assert r["median"] is None and r["histogram"] is None


def test_approximate_profiles_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 5.0, [1], float("nan")), (None, 5.0, None, float("inf"))], "none long, one double, items array<long>, far double")
    found = {r["column"]: r for r in profile.profile(df, exact=False).collect()}
    assert found["none"]["median"] is None and found["none"]["histogram"] is None and found["none"]["unique"] == 0
    assert (found["one"]["median"], found["one"]["histogram"][-1] + found["one"]["histogram"][0]) == (5.0, 2) and found["items"]["unique"] == 1 and found["far"]["min"] is None
    assert {r["count"] for r in profile.profile(df.limit(0), exact=False).collect()} == {0}


def test_correlations_of_many_columns(spark):
    """500 columns, some with missing values, one constant, one far from zero; exact to many digits for a sample of pairs."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 5))
    x = base @ rng.normal(size=(5, 500)) + rng.normal(size=(300, 500))
    x[:, 7], x[:, 8] = 3.0, 1e9 + x[:, 9]
    x[rng.random(x.shape) < 0.02] = np.nan
    names = [f"c{k}" for k in range(500)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in names)).repartition(4)
    found = {(r["a"], r["b"]): r["r"] for r in profile.correlations(df).collect()}
    assert len(found) == 499 * 498 + 500 and found["c7", "c7"] == 1.0 and ("c7", "c1") not in found
    for i, j in [(8, 9), (0, 499), *rng.integers(10, 500, (200, 2)).tolist()]:
        if i != j:
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert found[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7 if 8 in (i, j) else 1e-12)


def test_correlations_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, None, 5.0)], "a double, b double, c double")
    assert sorted(map(tuple, profile.correlations(df).collect())) == [("a", "a", 1.0), ("b", "b", 1.0), ("c", "c", 1.0)]
    assert profile.correlations(df.limit(0)).count() == 3 and profile.correlations(df.select(F.col("a"))).count() == 0


def test_an_approximate_median_keeps_to_its_side_of_a_gap(spark):
    """Columns of which just over half the rows are 0, in twelve orders: a rank that is off by a few rows would give 1."""
    n = 30_000
    place = lambda k: F.col("id") * k % n
    steps = [7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47]  # prime to n, so that each order has every place once
    columns = [F.when(place(k) < n // 2 + 3, 0).otherwise(1).alias(f"c{k}") for k in steps]
    halves = F.when(place(7) < n // 2, 0).otherwise(1).alias("halves")
    rare = F.when(place(7) < n // 2 - 5, 0.0).when(place(7) < n // 2 + 5, 40.0).otherwise(100.0).alias("rare")
    quarter = F.when(place(11) < n // 4 + 3, -5e9).otherwise(F.rand(3)).alias("quarter")
    far = (F.when(place(13) < n // 2 + 3, F.randn(5)).otherwise(500 + F.randn(6))).alias("far")
    df = spark.range(0, n, 1, 16).select(*columns, halves, rare, quarter, far)
    found = {r["column"]: r for r in profile.profile(df, exact=False).collect()}
    assert [found[f"c{k}"]["median"] for k in steps] == [0.0] * len(steps)
    assert found["halves"]["median"] == 0.5 and found["rare"]["median"] == pytest.approx(40.0) and found["quarter"]["q1"] == -5e9
    assert found["far"]["median"] < 10 and found["far"]["q3"] > 490


def test_approximate_quantiles_keep_their_ranks(spark):
    """Shapes whose values lie close to each other in places: whole numbers, few far ones, most in one bin, and one value in many parts."""
    n = 40_000
    shapes = [F.floor(F.rand(1) * 50).alias("whole"), F.exp(3 * F.randn(2)).alias("skewed"), F.when(F.col("id") == 5, 1e300).otherwise(F.randn(3)).alias("outlier"), F.when(F.col("id") % 2 == 0, 1e15 + F.floor(F.rand(4) * 3)).otherwise(1e15).alias("large"), F.lit(0.1).alias("one")]
    df = spark.range(0, n, 1, 300).select(*shapes).localCheckpoint()
    rows = np.array(df.collect(), dtype=float)
    found = {r["column"]: r for r in profile.profile(df, exact=False).collect()}
    for k, name in enumerate(df.columns):
        values = np.sort(rows[:, k])
        for q, share in (("median", 0.5), ("q1", 0.25), ("q3", 0.75)):
            v = found[name][q]
            assert np.searchsorted(values, v, "left") / n - 0.01 <= share <= np.searchsorted(values, v, "right") / n + 0.01, (name, q, v)
    assert found["one"]["median"] == 0.1 and found["whole"]["median"] == np.median(rows[:, 0])
