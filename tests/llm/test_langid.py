import numpy as np
import pytest

from airlens.llm import langid
from tests.llm import helpers as H

TABLE = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = docs.select("doc_id", "lang").collect()
    held = [r for r in truth if H.crc_mod(r["doc_id"], 4) == 2]
    assert all(got[r["doc_id"]]["held_out"] == (H.crc_mod(r["doc_id"], 4) == 2) for r in truth)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    score = np.array([r["score"] for r in got.values()])
    assert ((0 <= score) & (score <= 1)).all() and score.max() < 1 + 1e-9


def test_awkward_rows(spark):
    docs = H.awkward(spark)
    got = langid.identify(docs).collect()
    rows = H.awkward_rows()
    und = sorted(str(r[0]) for r in rows if not any(map(str.isalpha, r[1] or "")))
    assert sorted(str(r["doc_id"]) for r in got if r["lang_pred"] == "und") == und
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "de", "und"}
    kept = langid.identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["lang_pred"] != "und" and r["score"] >= langid.LEAST for r in got)


def test_nothing_to_learn(spark):
    assert langid.identify(H.empty(spark)).count() == 0
    assert langid.identified(H.empty(spark)).count() == 0
    none = spark.createDataFrame([H.row(1, "some text", None)], H.DOCS)
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(none).collect()] == [("und", 0.0)]


def test_pieces_of_long_texts_add_up():
    texts = ["abc defg " * 40, "", "xyz", "é" * 100]
    whole = [np.zeros(langid.BUCKETS + 1, int) for _ in texts]
    parts = [np.zeros(langid.BUCKETS + 1, int) for _ in texts]
    for out, most in ((whole, 1 << 20), (parts, 7)):
        for b, offs, own in langid.grams_of(texts, most):
            for r, i in enumerate(own.tolist()):
                out[i] += np.bincount(b[offs[r]:offs[r + 1]], minlength=langid.BUCKETS + 1)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        y = int(rng.integers(2))
        at = np.array([y, 5, *sorted(rng.choice(np.arange(10, 500), 3, replace=False).tolist())])
        rows.append((at, np.full(len(at), 0.4), y))
    w, _ = langid.fit_ftrl(rows, 2)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert (w == 0).mean() > 0.9


def gibberish():
    rnd = np.random.default_rng(21)
    def drawn(letters, n):
        return "".join(rnd.choice(list(letters), n))
    return ([drawn("qwxzjkvbpf     ", 600) for _ in range(5)]
            + [drawn("abcdefghijklmnopqrstuvwxyz     ", 2000) for _ in range(5)]
            + [drawn("ABCDEFGHIJabcdefghijKLMNOPQRSTUVWXYZklmnopqrstuvwxyz0123456789+/", 800) for _ in range(5)]
            + [drawn([chr(c) for c in range(0x4E00, 0x9000)], 300) for _ in range(5)])


@pytest.mark.parametrize("langs", [1, 2, 4])
def test_lettered_gibberish_goes(spark, langs):
    """Unlabelled gibberish goes and prose stays, of two languages too, however many are learned."""
    table = spark.read.parquet(f"{TABLE}/documents.parquet")
    names = sorted(r[0] for r in table.select("lang").distinct().collect())[:langs]
    rows = [tuple(r) for r in table.select("doc_id", "text", "lang").collect() if r[2] in names]
    first = [next(r[1] for r in rows if r[2] == n and len(r[1]) > 400)[:400] for n in names]
    mixed = [a + " " + b for i, a in enumerate(first) for b in first[i + 1:]]
    short = [" ".join(t.split()[:6]) for t in first]
    bad = gibberish()
    rows += [(10**6 + i, t, None) for i, t in enumerate(bad)]
    rows += [(2 * 10**6 + i, t, None) for i, t in enumerate(mixed + short)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r[0] for r in langid.identified(docs).select("doc_id").collect()}
    assert not {i for i in kept if 10**6 <= i < 2 * 10**6}
    assert {r[0] for r in rows if not 10**6 <= r[0] < 2 * 10**6} <= kept


def test_sample_is_bounded_over_all_labels(spark, monkeypatch):
    """Many labels share the fitting sample; each is still learned."""
    monkeypatch.setattr(langid, "TOTAL", 120, raising=False)
    sizes, fit_ftrl, heat = [], langid.fit_ftrl, langid.temperature
    monkeypatch.setattr(langid, "fit_ftrl", lambda rows, n: sizes.append(len(rows)) or fit_ftrl(rows, n))
    monkeypatch.setattr(langid, "temperature", lambda z, y: sizes.append(len(y)) or heat(z, y))
    rows = [(i, f"{chr(0x430 + i % 20) * 4} text {i}", f"l{i % 20:02}") for i in range(800)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 20 and sum(sizes) <= 120
    assert model.predict([f"{chr(0x430 + 7) * 4} text"])[0] == ["l07"]
