import random

import hashlib

import pytest

from airlens.llm import decontaminate
from tests.conftest import SF_SMALL
from tests.llm import helpers as H

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def items():
    return [(1, ITEM), (2, ITEM.replace("alpha", "omega")), (3, "short one here"), (3, "same id other words"),
            (4, None), (5, ""), (6, "... !!"), (None, "nameless item"), (7, "École 日本語 x1 0")]


def documents():
    body = " ".join(f"w{i}" for i in range(30))
    texts = [ITEM, body + " " + ITEM.upper().replace(" ", ", ") + " " + body, " ".join(ITEM.split()[:9]),
             " ".join(ITEM.split()[2:]), "a short one, here! and same-id other words", "nameless ITEM",
             "École 日本語 x1 0", "école 日本語 x1", ITEM + " " + ITEM, "short one", "beta gamma"]
    return H.awkward_rows() + [H.row(200 + i, t) for i, t in enumerate(texts)]


def brute(rows, bench):
    out = []
    for r in rows:
        n, hit, found = H.covered(r[1], bench)
        names = sorted("" if f is None else str(f) for f in found)
        out.append(str((r[0], n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)))
    return sorted(out)


@pytest.mark.parametrize("block_windows", [1 << 20, 3])
def test_hits_match_brute_force(spark, block_windows):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = spark.createDataFrame(documents(), H.DOCS)
    got = decontaminate.decontaminate(docs, bench, block_windows).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(documents(), items())


def test_documents_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(
        [tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])


def test_clean_documents_stay(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = spark.createDataFrame(documents(), H.DOCS)
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    want = [str(r) for r in documents() if not H.covered(r[1], items())[1]]
    assert sorted(str(tuple(r)) for r in kept.collect()) == sorted(want)


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontaminate.decontaminate(H.empty(spark), bench).count() == 0
    none = decontaminate.decontaminate(H.awkward(spark), bench.limit(0)).collect()
    assert len(none) == len(H.awkward_rows()) and not any(r["contaminated"] for r in none)


def test_blocks_are_bounded_whatever_the_ids(spark):
    """One id for many items, one long item: blocks are dealt by window."""
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(40)) for _ in range(20)]
    long = " ".join(rnd.choice(vocab) for _ in range(900))
    items = [(None, t) for t in texts[:10]] + [("same", t) for t in texts[10:]] + [("long", long), ("short", "w1 w2 w3")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = [(i, texts[i] + " x " + long[i * 40:i * 40 + 200]) for i in range(20)] + [(99, "nothing here"), (98, None)]
    windows = decontaminate.benchmark_windows(bench).count()
    assert windows == len({(i or "", tuple(t.split()[s:s + 10])) for i, t in items for s in range(max(1, len(t.split()) - 9))})
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(df, bench, block_windows=200).collect()}
    for i, t in docs:
        n, hit, found = H.covered(t, [(k or "", x) for k, x in items])
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (n, hit, len(found))
