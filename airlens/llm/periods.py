"""Operator 11: maximal periodic runs of words, by string synchronising sets.

A run is a maximal stretch of words that has smallest period q and is at least
max(``LEAST``, 2 q) words long. Texts are worked on many at a time: one array of
word hashes with a unique separator behind every text, so no equality crosses one.

* Periods below ``DIRECT``: words are compared with those q behind them.
* Periods in [3 t, 6 t) for t = 4, 8, 16, ...: the t-synchronising set holds the
  positions i where the least hash of the length-t substrings that begin in
  [i, i + t] begins at i or at i + t; substrings of a period of t / 3 or less are
  left out. Membership depends on the 2 t words from i alone, so it is the same
  in all copies of a stretch. A run of such a period q begins with t positions
  one of which is in the set and whose context of 2 t words comes again q words
  on, unless the run's first q words have a period p of t / 3 or less. Every
  member is thus paired with the following members of equal context less than
  6 t words on (contexts have no small period, so these are a few), and each
  distance of 3 t or more is a proposed period.
* The omitted runs: their two first periods lie in two runs of the small period p
  that meet or overlap by less than p words, at different phases. The phases
  give q modulo p, so these q are proposed for every such pair of runs (the runs
  of small periods are known by then).

A proposal is extended to both sides by binary search on prefix hashes; what it
gives is compared word by word. Of the periods of one stretch the smallest is
its period: if another period of a run is not the smallest, it is a multiple of
it, and both have the same maximal stretch.

One pass without a shuffle; a task holds a few MB of texts or one text, and
works in n log^2 n steps of its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import AS_IS, NOT_SPACE, _power_tables, find_words, mix64, slices, utf8

LEAST = 12                # words of a run
DIRECT = 12               # periods below are found by comparison
SLICE = 2 << 20           # bytes of text worked on at once

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]          # start, end, period
_NONE = np.empty(0, np.int64)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, last + 1) of the stretches of true."""
    e = np.zeros(len(equal) + 2, np.int8)
    e[1:-1] = equal
    d = np.diff(e)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _smallest(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> Runs:
    """Every stretch once, with its smallest period."""
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return s[new], e[new], q[new]


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] values, then the same of the next ones."""
    out = np.repeat(first - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


class Words:
    """Word hashes with prefix sums, for comparing stretches."""

    def __init__(self, w: np.ndarray):
        self.w, self.n = w, len(w)
        self.up, self.down = _power_tables(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix64(w) * self.up[:self.n], out=self.sums[1:])

    def context(self, i: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each i."""
        return mix64((self.sums[i + size] - self.sums[i]) * self.down[i])

    def _ahead(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Number of words from i that equal those q on, by hash."""
        lo, hi = np.zeros(len(i), np.int64), self.n - i - q
        factor = self.up[q]
        while True:
            todo = lo < hi
            if not todo.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = (self.sums[i + mid] - self.sums[i]) * factor == self.sums[i + q + mid] - self.sums[i + q]
            lo, hi = np.where(todo & same, mid, lo), np.where(todo & ~same, mid - 1, hi)

    def _behind(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Number of words before i that equal those q on, by hash."""
        lo, hi = np.zeros(len(i), np.int64), i.copy()
        factor = self.up[q]
        while True:
            todo = lo < hi
            if not todo.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = (self.sums[i] - self.sums[i - mid]) * factor == self.sums[i + q] - self.sums[i + q - mid]
            lo, hi = np.where(todo & same, mid, lo), np.where(todo & ~same, mid - 1, hi)

    def _scan(self, i: int, q: int) -> tuple[int, int]:
        """The stretch of period q around i, word by word (where hashes were wrong)."""
        differ = np.flatnonzero(self.w[:self.n - q] != self.w[q:])
        k = int(np.searchsorted(differ, i))
        lo = int(differ[k - 1]) + 1 if k else 0
        hi = int(differ[k]) if k < len(differ) else self.n - q
        return lo, max(lo, hi) + q

    def runs(self, i: np.ndarray, q: np.ndarray) -> Runs:
        """The stretches of period q around i that are two periods long, each once."""
        s, e = i - self._behind(i, q), i + q + self._ahead(i, q)
        ok = e - s >= 2 * q
        s, e, q, i = s[ok], e[ok], q[ok], i[ok]
        key = np.unique(np.stack([s, e, q, i]), axis=1)
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:3, 1:] != key[:3, :-1]).any(axis=0)
        s, e, q, i = key[:, new]
        wrong = np.zeros(len(s), bool)
        most = 1 << 20
        size = e - s - q
        part = np.cumsum(size) // most
        for lo, hi in zip(*_edges(part)):
            at = _ragged(s[lo:hi], size[lo:hi])
            differ = self.w[at] != self.w[at + np.repeat(q[lo:hi], size[lo:hi])]
            wrong[lo:hi] = np.add.reduceat(differ, np.cumsum(size[lo:hi]) - size[lo:hi]) > 0
        wrong |= (s > 0) & (self.w[s - 1] == self.w[s - 1 + q])
        inside = np.flatnonzero(e < self.n)
        wrong[inside] |= self.w[e[inside]] == self.w[e[inside] - q[inside]]
        for k in np.flatnonzero(wrong):
            s[k], e[k] = self._scan(int(i[k]), int(q[k]))
        ok = e - s >= 2 * q
        return s[ok], e[ok], q[ok]


def _edges(part: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(part)) + 1
    return [0, *cut.tolist()][:len(part)], [*cut.tolist(), len(part)][-len(part):] if len(part) else []


def synchronising_set(text: Words, t: int, runs: Runs) -> np.ndarray:
    """Members of the t-synchronising set; ``runs`` hold all of a period of t / 3 or less."""
    n = text.n - t + 1
    if n <= t:
        return _NONE
    ids = text.context(np.arange(n), t) >> np.uint64(1)
    top = np.uint64(1 << 63)
    s, e, q = runs
    small = (q * 3 <= t) & (e - s >= t)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, s[small], 1)
    np.add.at(change, e[small] - t + 1, -1)
    ids[np.cumsum(change)[:n] > 0] = top
    least, width = ids, 1                    # least of ids[i .. i + width)
    while width < t:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    m = n - t                                # windows of t + 1
    least = np.minimum(least[:m], ids[t:])
    return np.flatnonzero((least < top) & ((least == ids[:m]) | (least == ids[t:])))


def _proposed(text: Words, t: int, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of equal contexts at distances of [3 t, 6 t)."""
    at = synchronising_set(text, t, runs)
    at = at[at + 2 * t <= text.n]
    ctx = text.context(at, 2 * t)
    order = np.argsort(ctx, kind="stable")
    at, ctx = at[order], ctx[order]
    first = np.arange(len(at))
    i_out, q_out = [_NONE], [_NONE]
    step = 1
    while len(first):
        first = first[first + step < len(at)]
        d = at[first + step] - at[first]
        near = (ctx[first + step] == ctx[first]) & (d < 6 * t)
        first, d = first[near], d[near]
        far = d >= 3 * t
        i_out.append(at[first[far]])
        q_out.append(d[far])
        step += 1
    return np.concatenate(i_out), np.concatenate(q_out)


def _omitted(text: Words, t: int, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(position, period in [3 t, 6 t)) of the runs whose periods lie in two runs of a small period."""
    s, e, q = runs
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    k = np.flatnonzero((q[1:] == q[:-1]) & (s[1:] <= e[:-1]) & (q[1:] * 3 <= t)
                       & (np.minimum(e[1:] - s[1:], e[:-1] - s[:-1]) >= 3 * t))
    i_out, q_out = [_NONE], [_NONE]
    for a1, b1, a2, b2, p in zip(s[k].tolist(), e[k].tolist(), s[k + 1].tolist(), e[k + 1].tolist(),
                                 q[k].tolist()):
        most = min(b1 - a1, b2 - a2, 6 * t - 1)
        # the p words from a2 come in the first run r words before a2, r modulo p
        one = text.w[a2:a2 + p]
        own = np.concatenate([text.w[a1:a1 + p]] * 2)
        for r in range(p):
            if own[r] == one[0] and np.array_equal(own[r:r + p], one):
                back = (a2 - a1 - r) % p
                period = np.arange(3 * t + (back - 3 * t) % p, most + 1, p)
                q_out.append(period)
                i_out.append(np.maximum(a1, a2 - period))
    return np.concatenate(i_out), np.concatenate(q_out)


def find_runs(w: np.ndarray, longest: int | None = None) -> Runs:
    """All runs of an array of word hashes, ordered by start, then period.

    ``longest`` is the number of words between separators at most (default: all).
    """
    text = Words(w)
    longest = text.n if longest is None else longest
    found: list[Runs] = []
    for q in range(1, DIRECT):
        if 2 * q <= text.n:
            a, b = _stretches(w[:-q] == w[q:])
            ok = b - a >= q
            found.append((a[ok], b[ok] + q, np.full(int(ok.sum()), q)))

    def known():
        return _smallest(*(np.concatenate([_NONE, *(r[c] for r in found)]) for c in range(3)))

    t = DIRECT // 3
    while 6 * t <= longest:
        small = known()
        found += [text.runs(*_proposed(text, t, small)), text.runs(*_omitted(text, t, small))]
        t *= 2
    s, e, q = known()
    ok = e - s >= LEAST
    s, e, q = s[ok], e[ok], q[ok]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _digests(part: pa.RecordBatch, planted: bool) -> pa.RecordBatch:
    data, offs = utf8(part.column("text"))
    if not len(data):
        data = np.zeros(1, np.uint8)
    h, at, where, size = find_words(data[:offs[-1]], offs, NOT_SPACE, AS_IS)
    n = np.diff(at)
    pick = np.arange(len(h))
    if planted:
        for k, doc in enumerate(part.column("doc_id").to_pylist()):
            c = zlib.crc32(("" if doc is None else str(doc)).encode())
            m = int(n[k])
            if c % 10 == 0 and m:
                a = c // 10 % m
                pick[at[k] + a:at[k + 1]] = at[k] + a + np.arange(m - a) % (1 + (m - a) // (3 + c // 10 % 8))
    h, where, size = h[pick], where[pick], size[pick]
    # a separator of its own behind each text
    place = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    w = np.empty(len(h) + len(n), np.uint64)
    w[place] = h
    w[at[1:] + np.arange(len(n))] = mix64(np.arange(1, len(n) + 1, dtype=np.uint64) << np.uint64(40))
    begin = at[:-1] + np.arange(len(n))
    s, e, q = find_runs(w, int(n.max(initial=0)))

    drop = np.zeros(len(w) + 1, np.int64)
    np.add.at(drop, s + q, 1)
    np.add.at(drop, e, -1)
    kept = np.cumsum(drop)[place] == 0
    # kept words, each with a space behind it
    length = (size + 1)[kept]
    first = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=first[1:])
    joined = np.full(int(first[-1]), 0x20, np.uint8)
    inner = length - 1
    joined[_ragged(first[:-1], inner)] = data[_ragged(where[kept], inner)]
    bounds = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=bounds[1:])
    bounds = first[bounds[at]].tolist()
    view = memoryview(joined)

    edge = np.searchsorted(s, np.append(begin, len(w)))
    start, long = s - np.repeat(begin, np.diff(edge)), e - s
    rows = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                            "collapsed_sha256", "runs")}
    for k in range(len(n)):
        lo, hi = int(edge[k]), int(edge[k + 1])
        runs = list(zip(start[lo:hi].tolist(), long[lo:hi].tolist(), q[lo:hi].tolist()))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        rows["n_runs"].append(len(runs))
        for c, v in zip(("start", "length", "period"), best):
            rows[c].append(v)
        rows["exponent_milli"].append(1000 * best[1] // best[2] if runs else None)
        rows["runs_sha256"].append(hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest())
        rows["collapsed_sha256"].append(
            hashlib.sha256(view[bounds[k]:max(bounds[k], bounds[k + 1] - 1)]).hexdigest())
        rows["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
    struct = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    types = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": struct}
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), *(pa.array(v, types.get(c, pa.int64())) for c, v in rows.items())],
        names=["doc_id", *rows])


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run, digests, and ``runs`` (start, length, period) of every row.

    ``planted`` makes the words of one document of ten periodic first, by the
    hash of its doc_id (null: of an empty one). A null, empty or blank text has
    no words and no run, and its digests are those of an empty string; repeated
    rows each get a row; an empty table gives no rows; other columns are not
    read. Words are compared as they are, by 64-bit hashes.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                yield _digests(part, planted)

    return docs.select("doc_id", "text").mapInArrow(run, (
        f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, "
        "runs array<struct<start:long,length:long,period:long>>"))


def query(docs: DataFrame) -> DataFrame:
    return periodic_runs(docs, planted=True).drop("runs")
