import math
from collections import Counter

import numpy as np

from airlens.llm import gru, lm
from tests.llm import helpers as H

TABLE = "/root/testdata/sf0.01"


def brute_base(rows):
    tokens = [[*H.words(r[1]), "\0end"] for r in rows]
    count = Counter()
    for r, t in zip(rows, tokens):
        if H.crc_mod(r[0], 7) != 2:
            count.update(t)
    n, v = sum(count.values()), len(count)
    return sorted((str(r[0]), H.crc_mod(r[0], 7) == 2, len(t), sum(count[x] > 0 for x in t), n,
                   round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 4))
                  for r, t in zip(rows, tokens))


def got_base(df):
    rows = df.collect()
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 4)) for r in rows)


def test_awkward_rows(spark):
    for most in (lm.TABLE, 5):                       # with and without counts to be joined
        assert got_base(lm.score_documents(H.awkward(spark), vocabulary=20, most=most)) == brute_base(
            H.awkward_rows())


def test_no_documents_or_none_to_learn_from(spark):
    assert lm.score_documents(H.empty(spark)).count() == 0
    held = next(i for i in range(100) if H.crc_mod(i, 7) == 2)
    rows = [H.row(held, "a b")]
    assert got_base(lm.score_documents(spark.createDataFrame(rows, H.DOCS))) == brute_base(rows)


def test_model_beats_the_unigram_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    rows = [r for r in lm.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def model(v=30, hidden=4):
    g = gru.Gru(np.r_[np.arange(v - 2, 0, -1) * 10.0, 20, 50], hidden=hidden)
    rng = np.random.default_rng(1)
    for k in g.p:
        g.p[k] = g.p[k] + rng.normal(size=g.p[k].shape).astype(np.float32) * 0.3
    return g


def test_outcomes_sum_to_one():
    g = model()
    total = 0.0
    for last in range(30):
        first = 7
        tokens = np.array([first, last])
        alone = g.run(np.array([first]), np.array([0, 1]))[0]
        total += math.exp(g.run(tokens, np.array([0, 2]))[0] - alone)
    assert abs(total - 1) < 1e-4


def test_state_is_carried_across_windows_and_lanes():
    g = model()
    rng = np.random.default_rng(2)
    n = rng.integers(1, 90, 40)
    tokens = rng.integers(0, 30, n.sum())
    offs = np.r_[0, np.cumsum(n)]
    one = g.run(tokens, offs, lanes=1, window=1000)
    for lanes, window in ((1, 3), (4, 7), (64, 16)):
        assert np.allclose(one, g.run(tokens, offs, lanes=lanes, window=window), rtol=1e-4)


def test_gradients_are_those_of_the_loss(monkeypatch):
    g = model(12, 3)
    for k in g.p:
        g.p[k] = g.p[k].astype(np.float64)
    tokens, offs = np.array([1, 5, 0, 9, 10, 3, 3, 10]), np.array([0, 5, 8])
    got = {}

    def keep(name, grad, rate, rows=slice(None)):
        full = np.zeros(g.p[name].shape)
        full[rows] = grad
        got[name] = full

    monkeypatch.setattr(g, "_update", keep)
    g.run(tokens, offs, train=True, lanes=2, window=50)
    scale = np.sqrt(2 * 50)
    for name, x in g.p.items():
        flat = x.reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 12)):
            old, d = flat[i], 1e-4
            flat[i] = old + d
            up = g.run(tokens, offs, lanes=2, window=50).sum()
            flat[i] = old - d
            down = g.run(tokens, offs, lanes=2, window=50).sum()
            flat[i] = old
            assert abs(-(up - down) / (2 * d) - got[name].reshape(-1)[i] * scale) < 2e-3, (name, i)
