import importlib
import inspect
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import corpus_pipeline
from airlens.llm import binary, common, jaccard, langid
from airlens.llm.common import scratch
from tests.conftest import SF_SMALL
from tests.llm import helpers as H
from tests.llm.test_binary import library_ids
from tests.llm.test_mixing import brute_targets


def stages(spark, docs, sf_dir):
    """Each stage's input and output rows."""
    out, df = [], docs
    for _, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "stage")
        stage(spark, df, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((df, after))
        df = after
    return out


def check(spark, docs, sf_dir):
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = stages(spark, docs, sf_dir)
    for d in (d1, d2, d3, d4):
        assert d.columns == docs.columns
    r0, r1, r2, r3, r4 = ([tuple(r) for r in d.select("doc_id", "text", "lang", "source").collect()]
                          for d in (d0, d1, d2, d3, d4))
    # language ID: what is told with confidence stays
    told = langid.identify(d0).filter(f"lang_pred <> 'und' and score >= {langid.LEAST}").count()
    assert len(r1) == told and not Counter(r1) - Counter(r0)
    assert all(any(map(str.isalpha, r[1])) for r in r1)
    # Jaccard: one of each component
    label = H.components([H.shingles(r[1], corpus_pipeline.NEAR_WORDS) for r in r1], corpus_pipeline.NEAR_PERCENT)
    assert len(r2) == len(set(label))
    kept = Counter(H.components([H.shingles(r[1], corpus_pipeline.NEAR_WORDS) for r in r2],
                                corpus_pipeline.NEAR_PERCENT))
    assert not r2 or max(kept.values()) == 1
    # decontamination: exactly the rows without a window
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id", "text").collect()]
    assert Counter(r3) == Counter(r for r in r2 if not H.covered(r[1], bench)[1])
    # mix: whole copies, near the targets of its own input
    copies = Counter(r4)
    assert not set(copies) - set(r3)
    if r3 and any(H.words(r[1]) for r in r3):
        size, target = brute_targets(r3)
        for s in size:
            own = [r for r in r3 if r[3] == s and H.words(r[1])]
            taken = sum(copies[r] // r3.count(r) * len(H.words(r[1])) for r in own)
            most = max((len(H.words(r[1])) for r in own), default=0)
            assert abs(taken - target[s]) <= most / 2 + 1 or r3.count(own[0]) > 1
            assert all(copies[r] <= 3 * r3.count(r) for r in own)
    # token store: every copy, whole
    want = Counter()
    for r, ids in zip(r4, library_ids([r[1] for r in r4])):
        x = np.array([*ids, 1], "<u4")
        want[(r[0], len(x), zlib.crc32(x.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in d5.collect()) == want


def test_stages_on_documents(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    check(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"), SF_SMALL)


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert rows and [r["start"] for r in sorted(rows, key=lambda r: r["start"])][0] == 0


@pytest.mark.parametrize("rows", ["awkward", "none"])
def test_stages_on_awkward_rows(spark, tmp_path, rows):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (None, "x")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = H.awkward(spark) if rows == "awkward" else H.empty(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))


def similarity(a, b, k):
    x, y = H.shingles(a, k), H.shingles(b, k)
    return len(x & y) / len(x | y)


def near_copies():
    """Texts and copies at about the stage's threshold: text added, text cut, words edited."""
    rnd = np.random.default_rng(12)
    rows = []
    for g in range(30):
        n = int(rnd.integers(60, 400))
        base = [f"g{g}w{i}" for i in range(n)]
        for share in (0.20, 0.24, 0.26, 0.30):
            add = [f"g{g}s{share}a{i}" for i in range(int(share * n))]
            rows.append((base, base + add) if share < 0.26 else (base, add + base))
            base = [w + "x" for w in base]
        for share in (0.16, 0.19, 0.21, 0.25):
            rows.append((base, base[int(share * n):]))
            base = [w + "y" for w in base]
        for share in (0.019, 0.021, 0.023, 0.025):
            w = list(base)
            for i in np.linspace(5, n - 6, max(1, round(share * n))).astype(int):
                w[i] = "edited" + w[i]
            rows.append((base, w))
            base = [w + "z" for w in base]
    return [(" ".join(a), " ".join(b)) for a, b in rows]


def test_near_copies_at_the_stage_threshold(spark):
    """The stage's rule is 5-word shingles and 0.8; pairs just above and just below tell."""
    pairs = near_copies()
    s5 = [similarity(a, b, 5) for a, b in pairs]
    # the data tell the rule from 4 words and 0.85, and lie close on both sides of it
    assert sum(0.8 <= x and similarity(a, b, 4) < 0.85 for x, (a, b) in zip(s5, pairs)) > 20
    assert sum(0.8 <= x < 0.82 for x in s5) > 5 and sum(0.78 < x < 0.8 for x in s5) > 5
    # exactly at the threshold (40 of 50 shingles) and one word under it
    words = [f"q{i}" for i in range(54)]
    pairs += [(" ".join(words), " ".join(words[:44])),
              (" ".join(f"r{w}" for w in words), " ".join(f"r{w}" for w in words[:43]))]
    rows = [H.row(i, t) for i, t in enumerate(t for p in pairs for t in p)]
    got = {r["doc_id"] for r in corpus_pipeline.one_of_near_copies(
        spark, spark.createDataFrame(rows, H.DOCS), "").select("doc_id").collect()}
    label = H.components([H.shingles(r[1], 5) for r in rows], 80)
    assert got == set(label)


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_near_copy_stage_is_brute_force(spark, table):
    docs = (H.awkward(spark) if table == "awkward" else
            spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    sets = [H.shingles(r[1], 5) for r in rows]
    label = H.components(sets, 80)
    # H.components takes the first row's index as the label; every set without shingles is alone
    kept = corpus_pipeline.one_of_near_copies(spark, docs, "").select("doc_id", "text").collect()
    assert len(kept) == len(set(label))
    left = Counter(H.components([H.shingles(r["text"], 5) for r in kept], 80))
    assert max(left.values()) == 1


NAMES = ["id", "_id", "th", "_th", "sid", "label", "least", "rows", "win", "hit_id", "_hit_id", "hit_text", "_hit_text",
         "spans", "items", "h", "n", "source_of", "times", "copy", "copies", "_mix_id", "_mix_copies", "target", "key"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    rows = [(r[0], r[1], r[3], *range(len(NAMES))) for r in H.awkward_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(
        f"{n} int" for n in NAMES)).withColumn("lang", F.lit("en"))
    for stage in (corpus_pipeline.one_of_near_copies, corpus_pipeline.drop_contaminated, corpus_pipeline.mix_sources):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = [r.asDict() for r in out.collect()]
        assert got and all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in got)


@pytest.mark.parametrize("module, name", [("langid", "_frequencies"), ("langid", "_counts"), ("langid", "_predictor"),
                                          ("langid", "identified"), ("decontaminate", "_finder"), ("jaccard", "_overlaps"),
                                          ("jaccard", "_sift"), ("jaccard", "_cells")])
def test_steps_give_freed_memory_back(module, name):
    """Workers serve every stage, so each step has to return what it frees."""
    step = getattr(importlib.import_module(f"airlens.llm.{module}"), name)
    assert "returning(" in inspect.getsource(step)



def test_a_step_lets_go_of_what_another_step_kept(monkeypatch):
    """The token encoder's caches stay for the tasks of its own step only."""
    monkeypatch.setattr(common, "_kept", {})
    made = []
    for _ in range(2):
        assert common.kept("encoder", lambda: made.append(1) or "caches") == "caches"
        assert list(common.returning([1, 2], keep="encoder")) == [1, 2]
    assert made == [1]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c"], "th": [1]})
    assert [b.num_rows for b in jaccard._classes(2)([batch])] == [1]
    assert not common._kept


def test_the_writer_keeps_its_encoder_from_task_to_task(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words here", "more words"]})
    write = binary._writer(None, 1, 10)
    first = list(write([batch]))
    held = list(common._kept.values())
    assert len(held) == 1 and held[0].chunks
    assert list(write([batch])) == first and common._kept and list(common._kept.values())[0] is held[0]


def test_words_are_found_in_small_blocks(monkeypatch):
    """Temporary arrays of a worker follow the block, of which the words found do not depend."""
    texts = ["One, two. " * 50_000, "", "x" * 700_000 + " é" * 9, "Ünï..., y " * 40_000]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    for tail in (None, binary._MARKS):
        found = common.find_words(data, offs, tail=tail)
        for size in (1 << 12, 1 << 20):
            with monkeypatch.context() as m:
                m.setattr(common, "_BLOCK", size)
                assert all((a == b).all() for a, b in zip(common.find_words(data, offs, tail=tail), found))
    monkeypatch.setattr(common, "_powers", {})
    words = data[:offs[1]]
    tracemalloc.start()
    common.find_words(words, np.array([0, len(words)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6
