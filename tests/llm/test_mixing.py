import re

import pytest
from pyspark.sql import functions as F

from airlens.llm import mixing
from airlens.llm.common import copies
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


def brute_targets(rows):
    """Water filling by repeated resharing."""
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(H.words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = {}, sum(size.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return size, capped | share
        capped |= {s: 3.0 * size[s] for s in over}


def check(rows, got):
    size, target = brute_targets(rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted(
        (str(x[0]), len(H.words(x[1]))) for x in rows)
    taken, most = {}, {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        if size[s]:
            assert r["size"] == 0 or abs(r["copies"] - target[s] / size[s]) < 1 + 1e-9
        taken[s] = taken.get(s, 0) + r["taken"]
        most[s] = max(most.get(s, 0), r["size"])
    return size, target, taken, most


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = mixing.query(docs).collect()
    _, target, taken, most = check(rows, got)
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1
    again = mixing.query(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_small_documents_meet_the_target_closely(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
        .alias("source"))
    got = mixing.mix(docs, block=8).groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert len(got) == 8
    for r in got:
        assert abs(r["t"] - r["target"]) <= 20


def test_awkward_rows(spark):
    check(H.awkward_rows(), mixing.query(H.awkward(spark)).collect())
    assert mixing.query(H.empty(spark)).count() == 0
    docs = H.awkward(spark)
    out = mixing.documents_taken(docs)
    assert out.columns == docs.columns
    copies = {str((r["doc_id"], r["source"], r["h"])): (r["copies"], r["n"]) for r in mixing.mix(docs).collect()}
    assert out.count() == sum(c for c, n in copies.values())
    assert mixing.documents_taken(H.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.query(H.awkward(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_rows_alike_reach_their_target_too(spark):
    rows = [H.row(1, "one two three", source="a")] * 400 + [
        H.row(10 + i, "w " * (i % 7 + 1), source="b") for i in range(300)]
    got = mixing.query(spark.createDataFrame(rows, H.DOCS)).collect()
    _, target, taken, most = check(rows, got)
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1
    alike = [r["copies"] for r in got if r["source"] == "a"]
    assert len(alike) == 400 and max(alike) - min(alike) <= 1
    out = mixing.documents_taken(spark.createDataFrame(rows, H.DOCS))
    assert out.filter("source = 'a'").count() == sum(alike)


def test_copies_are_numbered_without_a_gap(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 9), ("e", 27)], "k string, n long")
    got = {}
    for r in copies(df, "n", "at", 9).collect():
        got.setdefault(r["k"], []).append(r["at"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "b": [0], "c": list(range(10)), "d": list(range(9)), "e": list(range(27))}
