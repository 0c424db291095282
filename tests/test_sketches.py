"""Stored sketches: the error bound, and merges in any order."""

import numpy as np
from pyspark.sql import functions as F

from airlens.operators import sketches as sk


def _frame(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(i) % 30, float(v), f"s{int(i) % 700}") for i, v in enumerate(rng.lognormal(2, 2, 4000))]
    rows += [("signs", int(i) % 5, float(v), "x") for i, v in enumerate(rng.normal(0, 50, 500))]
    rows += [("zero", 0, 0.0, "x")] * 3 + [("zero", 1, -4.0, None), ("none", 0, None, "y"), ("none", 0, float("nan"), "y")]
    return rows, spark.createDataFrame(rows, "k string, d int, v double, s string")


def test_quantiles_are_within_the_bound_after_merging(spark):
    rows, df = _frame(spark)
    asked = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    direct = sk.quantiles(sk.value_sketch(df, ["k"], "v"), ["k"], asked)
    fine = sk.value_sketch(df, ["k", "d"], "v")
    merged = sk.quantiles(sk.merged(fine.repartition(7).orderBy(F.desc("d")), ["k"]), ["k"], asked)
    got = {r["k"]: r for r in merged.collect()}
    assert got == {r["k"]: r for r in direct.collect()}
    assert set(got) == {"hot", "signs", "zero"}
    for k, r in got.items():
        v = sorted(x for kk, _, x, _ in rows if kk == k)
        assert r["n"] == len(v)
        for name, q in asked.items():
            want = v[int(np.floor(q * (len(v) - 1)))]
            assert abs(r[name] - want) <= sk.ERROR * abs(want) + 1e-9


def test_distinct_merges_in_any_order(spark):
    rows, df = _frame(spark)
    cells = sk.distinct_sketch(df, ["k", "d"], "s")
    for order in (F.asc("d"), F.desc("d")):
        got = {r["k"]: r["n_distinct"] for r in sk.distinct_estimate(
            cells.repartition(5).sortWithinPartitions(order), ["k"]).collect()}
        for k, n in got.items():
            want = len({s for kk, _, _, s in rows if kk == k and s is not None})
            assert abs(n - want) <= 0.05 * want
