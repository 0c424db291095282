"""Snapshot differences and threshold counts against brute force, null keys and a hot key included."""

from collections import Counter

import numpy as np

from airlens.operators.changes import count_above, keyed_difference, multiset_difference


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k string, d int, v double")


def test_keyed_difference(spark):
    before = [("a", 1, 1.0), ("a", 2, None), ("b", 1, 3.0), (None, 1, 4.0), ("c", None, 5.0)]
    after = [("a", 1, 1.0), ("a", 2, 2.0), (None, 1, 4.5), ("c", None, 5.0), ("d", 7, None)]
    got = {(r["k"], r["d"]): r["change"] for r in keyed_difference(
        _frame(spark, before), _frame(spark, after), ["k", "d"]).collect()}
    assert got == {("a", 2): "changed", ("b", 1): "removed", (None, 1): "changed", ("d", 7): "added"}
    assert keyed_difference(_frame(spark, []), _frame(spark, []), ["k"]).count() == 0


def test_multiset_difference(spark):
    rng = np.random.default_rng(1)
    rows = lambda n: [(None if x == 0 else str(x), int(x) % 2, None if x == 3 else 1.0)
                      for x in rng.integers(0, 6, n)]
    a, b = rows(300), rows(200)
    got = {tuple(r["row"]): (r["n_removed"], r["n_added"], r["n_common"])
           for r in multiset_difference(_frame(spark, a), _frame(spark, b)).collect()}
    ca, cb = Counter(a), Counter(b)
    assert got == {x: (max(ca[x] - cb[x], 0), max(cb[x] - ca[x], 0), min(ca[x], cb[x])) for x in ca | cb}


def test_count_above_with_a_hot_key(spark):
    rng = np.random.default_rng(2)
    vals = [("hot", 0, float(np.round(v, 1))) for v in rng.normal(0, 20, 2000)]
    vals += [("b", 0, 5.0), ("b", 0, 5.0), ("b", 0, None), (None, 0, 9.0)]
    asks = [("hot", i, float(np.round(v, 1))) for i, v in enumerate(rng.normal(0, 40, 200))]
    asks += [("b", 1, 5.0), ("b", 2, 4.9), ("b", 3, -100.0), ("none", 4, 0.0), ("b", 5, None), (None, 6, 1.0)]
    got = sorted((r["k"], r["d"], r["n_above"]) for r in count_above(
        _frame(spark, vals), _frame(spark, asks), "k", "v", "v").collect())
    want = sorted((k, d, sum(1 for kk, _, x in vals if kk == k and x is not None and x > v))
                  for k, d, v in asks if k is not None and v is not None)
    assert got == want
    plan = count_above(_frame(spark, vals), _frame(spark, asks), "k", "v", "v")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
