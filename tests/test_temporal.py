"""Chunked time operators against plain Python, with a city that holds most rows and small chunks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airlens.operators import lattice, temporal


def days(rnd, n, share):
    return sorted(d for d in range(-40, n) if rnd.random() < share)


@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_episodes_across_chunks(spark, chunk):
    rnd = random.Random(chunk)
    rows = [("hot", d, float(d % 7)) for d in days(rnd, 400, 0.8)]
    for c in range(6):
        rows += [(f"c{c}", d, float(rnd.randint(0, 9))) for d in days(rnd, 60, 0.5)]
    rows += [(None, 3, 1.0), ("hot", None, 1.0)]
    got = temporal.episodes(spark.createDataFrame(rows, "city string, day int, v double"), "city", "day", "v", chunk)
    want, by = [], defaultdict(dict)
    for c, d, v in rows:
        if c is not None and d is not None:
            by[c][d] = v
    for c, own in by.items():
        for d in own:
            if d - 1 not in own:
                e = d
                while e + 1 in own:
                    e += 1
                v = [own[x] for x in range(d, e + 1)]
                want.append((c, d, e, len(v), sum(v), max(v)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_asof_join_carries_over_empty_chunks(spark, chunk):
    rnd = random.Random(chunk + 1)
    right = [("hot", d, d * 10) for d in days(rnd, 300, 0.05)] + [("b", 0, 5), (None, 1, 1), ("c", 500, 9)]
    left = [(i, rnd.choice(["hot", "hot", "hot", "b", "c", "none", None]), rnd.choice([None, *range(-60, 320)]))
            for i in range(500)]
    got = temporal.asof_join(spark.createDataFrame(left, "id int, k string, day int"),
                             spark.createDataFrame(right, "k string, day int, v int"), ["k"], "day", ["v"], chunk)
    want = []
    for i, k, d in left:
        at = [x for x in right if k is not None and d is not None and x[0] == k and x[1] <= d]
        best = max(at, key=lambda x: x[1], default=(None, None, None))
        want.append((i, k, d, best[1], best[2]))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("width", [1, 6, 64])
def test_overlap_join_gives_each_pair_once(spark, width):
    rnd = random.Random(width + 2)

    def spans(n, p):
        return [(f"{p}{i}", rnd.choice("xxxy"), (s := rnd.randint(-50, 200)), s + rnd.randint(-3, 40)) for i in range(n)]

    a, b = spans(80, "a"), spans(60, "b")
    df = temporal.overlap_join(spark.createDataFrame(a, "a string, k string, s int, e int"),
                               spark.createDataFrame(b, "b string, k string, t int, f int"), ["k"], ("s", "e"), ("t", "f"), width)
    want = [(x[0], y[0]) for x in a for y in b
            if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted((r["a"], r["b"]) for r in df.collect()) == sorted(want)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_sliding_frames_reach_into_the_chunk_before(spark):
    rnd = random.Random(9)
    rows = [("hot", d, rnd.randint(1, 50), rnd.randint(1, 4)) for d in days(rnd, 300, 0.6)] + [("b", 3, 8, 2), (None, 1, 1, 1)]
    got = temporal.sliding(spark.createDataFrame(rows, "city string, day int, s int, n int"), "city", "day", "s", "n",
                           (7, 30), 8).collect()
    assert len(got) == len(rows) - 1
    for r in got:
        for k in (7, 30):
            own = [x for x in rows if x[0] == r["city"] and r["day"] - k < x[1] <= r["day"]]
            assert r[f"days_{k}"] == len(own)
            assert r[f"mean_{k}"] == pytest.approx(sum(x[2] for x in own) / sum(x[3] for x in own))


def test_no_window_is_over_a_whole_city(spark):
    d = spark.range(10).select(F.lit("c").alias("city"), F.col("id").cast("int").alias("day"), F.lit(1).alias("s"), F.lit(1).alias("n"))
    plan = temporal.sliding(d, "city", "day", "s", "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if x.strip(" +-:").startswith("Window ")]
    assert windows and all("chunk#" in x for x in windows)


def test_lattice_reads_the_readings_once(spark):
    from airlens.sources.tables import tables
    from tests.conftest import SF_SMALL
    t = tables(spark, SF_SMALL)
    for df in (lattice.v2(t),):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1
    assert len({s[0] for level in lattice.SHAPES.values() for s in level}) >= 27
