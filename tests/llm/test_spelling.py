import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from airlens.llm import spelling
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


def brute_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = w.translate(H.UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(v):
    """Near words by a table of all words with one letter taken out, then by comparison."""
    holes = {}
    for w in v:
        for key in {w} | {w[:i] + "\0" + w[i + 1:] for i in range(len(w))} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            holes.setdefault(key, set()).add(w)
    near = {w: set() for w in v}
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (w, form[w], root(w), n, len(near[w]), v.get(form[w])) for w, n in v.items()}


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r for r in rows}


def table(spark, v):
    return spark.createDataFrame(list(v.items()), "word string, n long")


def test_documents_are_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    v = brute_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = found(spelling.query(docs))
    assert got == brute_variants(v)
    assert any(r[1] for r in got.values())


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzàÉÿ"])
def test_dense_vocabularies(spark, letters, monkeypatch):
    """Most words near to many, anagrams, and cells of many small blocks."""
    monkeypatch.setattr(spelling, "PIECE", 64)
    monkeypatch.setattr(spelling, "BLOCK", 2)
    rnd = random.Random(len(letters))
    v = {}
    while len(v) < 700:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice([5, 6, 7, 8, 9, 12])))
        for x in (w, w + rnd.choice(letters), w[1:] + rnd.choice(letters), w[::-1]):
            if len(x) >= 5:
                v[x] = rnd.choice([3, 4, 6, 8, 16, 16, 100])
    assert found(spelling.group_variants(table(spark, v))) == brute_variants(v)


def test_chains_ties_and_long_words(spark):
    long = "abcdefghij" * 500
    v = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96,      # a chain to the root
         "kkkkk": 5, "kkkkm": 10, "kkkkl": 10,                                            # a tie: the smaller word
         "zzzzz": 9, "zzzzy": 17,                                                         # not twice as often
         long: 4, long + "x": 8, long[:-1]: 3, long[1:] + "a": 3, "alone": 7}
    got = found(spelling.group_variants(table(spark, v)))
    assert got == brute_variants(v)
    assert got["aaaaa"][2] == "bbbbb" and got["kkkkk"][1] == "kkkkl" and got["alone"][4] == 0


def test_awkward_rows_nulls_and_empty(spark):
    docs = H.awkward(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_counts(rows)
    assert dict(map(tuple, spelling.word_counts(docs).collect())) == want
    assert found(spelling.query(docs)) == brute_variants(want)
    assert spelling.query(H.empty(spark)).count() == 0
    assert spelling.query(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_pairs_of_one_edit_by_random_words():
    rnd = np.random.default_rng(1)
    a = ["".join(rnd.choice(list("abcÿ"), 6)) for _ in range(200)]
    b = ["".join(rnd.choice(list("abcÿ"), 7)) for _ in range(200)]
    i, j = spelling.near_pairs(a, b, False)
    assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(200) for y in range(200) if one_edit(a[x], b[y])]
    i, j = spelling.near_pairs(a, a, True)
    assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(200) for y in range(x + 1, 200)
                                                   if one_edit(a[x], a[y])]
