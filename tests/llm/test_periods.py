import hashlib
import random
import zlib

import numpy as np
import pytest

from airlens.llm import periods
from airlens.llm.common import mix64
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


def brute_runs(w):
    """(start, period, end) by comparing all words at every distance."""
    seen = {}
    x = np.array([seen.setdefault(v, len(seen)) for v in w], np.int64)
    out = {}
    for q in range(1, len(w) // 2 + 1):
        e = np.zeros(len(w) - q + 2, np.int64)
        e[1:-1] = x[:-q] == x[q:]
        d = np.diff(e)
        for s, f in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()):
            if f - s >= q and f + q - s >= 12:
                out.setdefault((s, f + q), q)
    return sorted((s, q, e) for (s, e), q in out.items())


def runs_of(w):
    names = {c: k + 1 for k, c in enumerate(sorted(set(w)))}
    s, e, q = periods.find_runs(mix64(np.array([names[c] for c in w], np.uint64)))
    return list(zip(s.tolist(), q.tolist(), e.tolist()))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def random_word(rnd):
    """Repeats of repeats, cut anywhere, with stretches of small period and copies from before."""
    letters, n, w = "abcdefgh"[:rnd.choice([1, 2, 2, 3, 8])], rnd.randint(0, 500), ""
    while len(w) < n:
        u = "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 9, 17, 33, 60])))
        if rnd.random() < 0.3:
            u = (u[:3] * 40)[:rnd.randint(1, 80)]
        u *= rnd.choice([1, 1, 2, 3, 6])
        u = u[:len(u) - rnd.randint(0, min(5, len(u) - 1))]
        if w and rnd.random() < 0.3:
            x = rnd.randrange(len(w))
            u = w[x:x + rnd.randint(1, 120)] or "a"
        w += u
    return w


STRINGS = {
    "empty": "", "one": "a", "fibonacci": fibonacci(1500), "one letter": "a" * 700,
    "thue-morse": "".join(str(bin(i).count("1") % 2) for i in range(5000)),
    "two phases": "ab" * 200 + "a" + "ab" * 250, "three phases": "aab" * 100 + "b" + "aab" * 100 + "aab" * 50,
    "long roots": ("a" * 40 + "b") * 8, "roots of roots": ((("a" * 30 + "b") * 6 + "c") * 4 + "d") * 3,
    "phases in a root": ("ab" * 30 + "a") * 9 + "c" + ("ab" * 30 + "a") * 5,
    "exactly two": "abcdefghijklm" * 2, "eleven": "a" * 11, "twelve": "x" + "ab" * 6 + "x"}


@pytest.mark.parametrize("name", STRINGS)
def test_runs_of_known_strings(name):
    assert runs_of(STRINGS[name]) == brute_runs(STRINGS[name])


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_strings(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        w = random_word(rnd)
        assert runs_of(w) == brute_runs(w), w


def test_synchronising_set_is_consistent_and_dense():
    rnd = random.Random(5)
    for _ in range(30):
        w = random_word(rnd) + "zyx" * 9
        h = mix64(np.array([ord(c) for c in w], np.uint64))
        text = periods.Words(h)
        small = [periods._stretches(h[:-q] == h[q:]) for q in range(1, 6)]
        runs = tuple(np.concatenate(x) for x in zip(*[
            (a[b - a >= q], b[b - a >= q] + q, np.full(int((b - a >= q).sum()), q))
            for q, (a, b) in enumerate(small, 1)]))
        for t in (4, 8, 16):
            member = np.zeros(len(w), bool)
            member[periods.synchronising_set(text, t, runs)] = True
            seen = {}
            for i in range(len(w) - 2 * t + 1):
                assert seen.setdefault(w[i:i + 2 * t], member[i]) == member[i]
            for i in range(len(w) - 3 * t + 2):
                u = w[i:i + 3 * t - 1]
                if not any(u[:-p] == u[p:] for p in range(1, t // 3 + 1)):
                    assert member[i:i + t].any()


def test_wrong_hashes_are_found_by_comparison(monkeypatch):
    """With hashes that say equal too often, extended stretches are compared and mended."""
    real = periods.Words._ahead
    monkeypatch.setattr(periods.Words, "_ahead", lambda self, i, q: np.minimum(real(self, i, q) + 1, self.n - i - q))
    w = "abcdefghijklmn" * 3 + "xyz" + "abcdefghijklmnopqr" * 2
    assert runs_of(w) == brute_runs(w)


def brute_row(doc_id, text, planted=True):
    w = H.SPACE_WORD.findall(text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    drop = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, q, e in runs), default=None)
    first = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *first, sha("".join(f"{s},{e - s},{q}\n" for s, q, e in runs)),
            sha(" ".join(v for i, v in enumerate(w) if i not in drop)))


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_query_is_brute_force(spark, table):
    docs = H.awkward(spark) if table == "awkward" else spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted(map(str, (brute_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())))
    assert sorted(str(tuple(r)) for r in periods.query(docs).collect()) == want


def test_case_matters_and_texts_do_not_run_into_each_other(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "A a " * 8), (4, "é x " * 6), (5, "É x é x " * 3), (6, None)]
    got = {r["doc_id"]: r for r in periods.periodic_runs(
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [got[i]["n_runs"] for i in range(1, 7)] == [0, 0, 1, 1, 1, 0]
    assert got[3]["period"] == 2 and got[5]["period"] == 4
    assert [tuple(r) for r in got[4]["runs"]] == [(0, 12, 2)]


def test_empty_table(spark):
    assert periods.query(H.empty(spark)).count() == 0
