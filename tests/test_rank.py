"""Positional ranking against pandas' sort_values/iloc semantics."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlens.operators.rank import nth, top_k

ROWS = [("a", 3.0), ("b", None), ("c", 1.0), ("d", 3.0), ("e", 2.0)]


def pandas_nth(rows, p):
    df = pd.DataFrame(rows, columns=["lbl", "v"])
    # tie rule: ascending by (value, label); NaN last, as pandas does
    df = df.sort_values(["v", "lbl"], na_position="last", kind="mergesort")
    if p >= len(df) or -p > len(df):
        return None
    r = df.iloc[p]
    return r["lbl"], (None if pd.isna(r["v"]) else r["v"])


@pytest.mark.parametrize("p", [0, 1, 2, 3, 4, -1, -2, -3, -5, 5, -6])
def test_nth_matches_pandas(spark, p):
    df = spark.createDataFrame(ROWS, "lbl string, v double")
    got = nth(df, [("v", True), ("lbl", True)], [p], ["lbl", "v"]).collect()
    want = pandas_nth(ROWS, p)
    if want is None:
        assert got == []
    else:
        assert len(got) == 1 and got[0]["pos"] == p
        assert (got[0]["lbl"], got[0]["v"]) == want


def test_all_null_group_is_highest(spark):
    df = spark.createDataFrame([("x", None), ("y", 5.0)], "lbl string, v double")
    got = nth(df, [("v", True), ("lbl", True)], [-1, 0], ["lbl"]).collect()
    assert {r["pos"]: r["lbl"] for r in got} == {-1: "x", 0: "y"}


def test_descending_keeps_nulls_last(spark):
    df = spark.createDataFrame(ROWS, "lbl string, v double")
    got = nth(df, [("v", False), ("lbl", False)], [0, 1, -1], ["lbl"]).collect()
    assert {r["pos"]: r["lbl"] for r in got} == {0: "d", 1: "a", -1: "b"}


def test_top_k(spark):
    df = spark.createDataFrame(ROWS, "lbl string, v double")
    got = [r["lbl"] for r in top_k(df, [("v", False), ("lbl", False)], 3).collect()]
    assert got == ["d", "a", "e"]


def test_plan_is_take_ordered(spark):
    df = spark.createDataFrame(ROWS, "lbl string, v double")
    plan = nth(df, [("v", True), ("lbl", True)], [0, -1], ["lbl"])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_group_stats_quantiles_with_a_hot_group(spark):
    import numpy as np
    from airlens.functions.stats import group_stats
    rng = np.random.default_rng(0)
    rows = [("hot", float(np.round(v, 3))) for v in rng.gamma(2, 20, 3000)]
    rows += [("ties", 5.0)] * 50 + [("ties", 7.0)] * 51 + [("one", -3.5)] + [("none", None)] * 3
    rows += [(None, 2.0), (None, 4.0)] + [("neg", float(v)) for v in rng.normal(0, 1, 100)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["lbl"]: r for r in group_stats(df, F.col("k"), {
        "mean": ("mean", "v"), "median": ("median", "v"), "q25": ("q25", "v"), "q75": ("q75", "v"),
        "low": ("median", F.when(F.col("v") < 3, F.col("v")))}).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        v = [x for kk, x in rows if kk == k and x is not None]
        low = [x for x in v if x < 3]
        want = [np.mean(v), np.median(v), *np.quantile(v, [0.25, 0.75])] if v else [None] * 4
        want.append(np.median(low) if low else None)
        for have, w in zip(got[k][1:], want):
            assert (have is None and w is None) or abs(have - w) < 1e-9
    plan = group_stats(df, F.col("k"), {"m": ("median", "v")})._jdf.queryExecution().toString()
    assert "percentile" not in plan
