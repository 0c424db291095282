import zlib

import numpy as np

from airlens.llm import sharding
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


def test_shards_are_near_equal_and_gapless(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sharding.assign(docs).toPandas()
    sizes = {r["doc_id"]: len(r["text"].encode()) + 16 for r in docs.collect()}
    assert {int(i): int(s) for i, s in zip(got.doc_id, got["size"])} == sizes
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 40 and load.max() - load.min() <= max(sizes.values())
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_awkward_rows(spark):
    rows = H.awkward_rows()
    got = sharding.assign(H.awkward(spark), shards=3).collect()
    want = sorted(len((r[1] or "").encode()) + 16 for r in rows)
    assert sorted(r["size"] for r in got) == want
    assert {r["grown_shard"] for r in got} == {None}
    assert sharding.assign(H.empty(spark)).count() == 0


def test_rebalancing_edits_few_slots():
    rng = np.random.default_rng(0)
    size = rng.integers(50, 200, 4096)
    first = sharding.rebalance(size, sharding.first_map(4096, 40), 40)
    load = np.bincount(first, weights=size, minlength=40)
    assert load.max() - load.min() <= 2
    size[:100] += 5000                               # some slots grow
    second = sharding.rebalance(size, first, 40)
    load = np.bincount(second, weights=size, minlength=40)
    assert load.max() - load.min() <= 10
    assert (first != second).mean() < 0.5


def test_rows_alike_spread_over_the_shards(spark):
    rows = [(None, None)] * 20_000 + [(i, "x" * (i % 30)) for i in range(20_000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 40 and load.max() - load.min() <= 46
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert (got["doc_id"].isna()).sum() == 20_000


def test_sizes_and_crc_are_brute_force(spark):
    rows = H.awkward_rows()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    got = sharding.assign(H.awkward(spark)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
