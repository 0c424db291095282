import numpy as np

from airlens.llm import neighbours
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, r string, key double"


def brute(rows, k=10, every=100):
    seen = {(i, tuple(v)) for i, v in rows}
    out = {}
    for i, v in seen:
        if i % every:
            continue
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in seen if j != i)
        out[i] = near[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v],
                                   1, "r", 0.5) for i, v in rows], SCHEMA)


def compare(got, want):
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(mine[r["query_id"]])
    found = sum(len({j for _, j in mine.get(i, [])} & {j for _, j in w}) for i, w in want.items())
    return mine, found / max(1, sum(map(len, want.values())))


def test_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    mine, recall = compare(neighbours.search(df).collect(), brute(rows))
    assert recall >= 0.9
    exact = brute(rows, k=len(rows))
    for i, near in mine.items():
        scores = {j: d for d, j in exact[i]}
        assert all(abs(scores[j] - d) < 1e-12 for d, j in near)
        assert near == sorted(near)


def test_several_query_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.search(table(spark, rows), every=10, query_block=20, sample=200).collect()
    _, recall = compare(got, brute(rows, every=10))
    assert recall >= 0.9


def test_ties_repeats_and_rows_that_take_no_part(spark):
    one, two = [1.0, 0.0, 0.5], [0.0, 1.0, 0.5]
    good = [(i, one) for i in range(0, 300, 7)] + [(i, two) for i in range(1, 200, 9) if i % 7 and i != 100] + [(100, [0.9, 0.1, 0.5])]
    good = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in good]
    bad = [(200, None), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]),
           (600, [float("inf"), 1.0, 1.0]), (700, [1.0]), (800, []), (None, one)]
    got = neighbours.search(table(spark, good + good[:5] + bad)).collect()
    mine, _ = compare(got, {})
    want = brute(good)
    assert mine.keys() == want.keys()
    for i in want:
        assert mine[i] == [(d, j) for d, j in want[i]] or np.allclose(mine[i], want[i], atol=1e-12)


def test_few_or_no_rows(spark):
    assert neighbours.search(table(spark, [])).count() == 0
    assert neighbours.search(table(spark, [(0, [1.0, 2.0])])).count() == 0
    got = neighbours.search(table(spark, [(0, [1.0, 2.0]), (5, [1.0, 3.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 5, 1.0)]


def test_clusters_of_unequal_scale_get_all_their_rows(spark):
    """Tight far clusters teach a small radius; a few loose points about the mean need a wide one."""
    rng = np.random.default_rng(3)
    far = rng.normal(size=(4, 16)) * 100
    far = np.concatenate([far, -far])
    x = np.concatenate([far[rng.integers(8, size=3985)] + rng.normal(size=(3985, 16)) * 0.01,
                        rng.normal(size=(15, 16)) * 6]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, every=4)
    assert any(np.linalg.norm(x[i]) < 100 for i in want)
    got = neighbours.search(table(spark, rows), every=4, sample=1000).collect()
    mine, recall = compare(got, want)
    assert mine.keys() == want.keys()
    assert all(len(mine[i]) == 10 for i in want)
    assert recall >= 0.9


def test_an_id_with_two_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist(), 1, None, None) for i in range(1, 100)]
    x = rng.normal(size=6)
    rows += [(0, x.tolist(), 1, None, None), (0, (x + 1e-3).tolist(), 1, None, None)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA)).collect()
    ranks = sorted(r["rank"] for r in got)
    assert ranks == sorted([*range(1, 11)] * 2)
    # the other row of the id is the nearest of each
    assert [r["vec_id"] for r in got if r["rank"] == 1] == [0, 0]
    assert all(r["score"] > 0 for r in got)
