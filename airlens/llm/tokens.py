"""Operator 9: token counts by rank-synchronous array merging.

Texts fall into pre-tokens that no vocabulary piece spans. A batch of distinct
pre-tokens is held as one ragged numpy array of symbol ids; in each step every
sequence merges the pair whose piece has the best rank, all sequences at once,
until no pair is in the vocabulary; what is left is counted, a symbol outside
the vocabulary as its UTF-8 bytes. The merge table is derived from the pieces
and their scores, so the counts are those of the library for a BPE model with
byte fallback.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import utf8

LIMIT = 4096
_CACHE_MAX = 1_200_000
_NONE = np.iinfo(np.int32).max
LONG = 256                # symbols above which a sequence is merged by itself, with a heap
_RUN = re.compile("▁*[^▁]+|▁+")


class RankMerger:
    """Counts of a sentencepiece BPE model (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, model_file: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usable = [i for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        # rank 0 is the best score; a piece's own number is its rank
        order = sorted(pieces, key=lambda p: (-pieces[p], p))
        rank = {p: r for r, p in enumerate(order)}
        chars = sorted({c for p in pieces for c in p})
        number = dict(rank)
        for c in chars:                      # a character that is no piece still can be merged
            number.setdefault(c, len(number))
        self.number = {c: number[c] for c in chars}
        self.n_pieces, self.n_symbols = len(order), len(number)
        left, right, to = [], [], []
        for p in order:
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(rank[p])
        # symbols outside the vocabulary get the number n_symbols, which is in no pair
        self.base = np.int64(self.n_symbols + 1)
        key = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        by = np.argsort(key)
        self.keys, self.to = key[by], np.array(to, np.int32)[by]
        self.pair = dict(zip(self.keys.tolist(), self.to.tolist()))   # for merge_long
        bits = 18
        self.shift = np.uint64(64 - bits)
        slot = self._slot(self.keys)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[slot] = True
        multi = [p for p in order if len(p) > 1]
        self.newline_apart = not any("\n" in p for p in multi)
        self.marks_lead = not any("▁" in p.lstrip("▁") for p in multi)
        letter = str.isalpha
        self.punct_apart = not any(
            (letter(x) and not letter(y)) or (letter(y) and not letter(x) and x != "▁")
            for p in multi for x, y in zip(p, p[1:]))
        self.cache: dict[str, int] = {"": 0}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair makes; ``_NONE`` if there is none."""
        out = np.full(len(a), _NONE, np.int32)
        key = a * self.base + b
        some = np.flatnonzero(self.maybe[self._slot(key)])
        at = np.searchsorted(self.keys, key[some])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key[some]
        out[some[hit]] = self.to[at[hit]]
        return out

    def merge(self, symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The number of symbols left of each sequence, merged to the end.

        ``symbols`` holds all sequences, ``start`` where each begins (and the end).
        Each step merges in every sequence the leftmost pair of its best rank.
        """
        n = np.diff(start)
        left = n.copy()
        live = np.flatnonzero(n > 1)
        own = np.repeat(np.arange(len(n)), n)
        keep = n[own] > 1
        sym, seq = symbols[keep].astype(np.int64), own[keep]
        rank = None
        while len(live):
            if rank is None:
                rank = np.full(len(sym), _NONE, np.int32)
                same = seq[:-1] == seq[1:]
                at = np.flatnonzero(same)
                rank[at] = self._ranks(sym[at], sym[at + 1])
            head = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.r_[head, len(seq)])
            more = best != _NONE
            left[seq[head]] = size
            if not more.all():               # finished sequences leave
                stay = np.repeat(more, size)
                sym, seq, rank = sym[stay], seq[stay], rank[stay]
                if not len(sym):
                    break
                head = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
                best, size = best[more], size[more]
            pos = np.flatnonzero(rank == np.repeat(best, size))
            first = np.r_[True, seq[pos[1:]] != seq[pos[:-1]]]
            pos = pos[first]                 # leftmost of each sequence
            sym[pos] = rank[pos]
            stay = np.ones(len(sym), bool)
            stay[pos + 1] = False
            new = np.cumsum(stay)[pos] - 1
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            rank[new] = _NONE
            p = new[new + 1 < len(seq)]
            p = p[seq[p] == seq[p + 1]]
            rank[p] = self._ranks(sym[p], sym[p + 1])
            p = new[new > 0]
            p = p[seq[p] == seq[p - 1]] - 1
            rank[p] = self._ranks(sym[p], sym[p + 1])
            live = seq
        self._last = (sym, seq)
        return left

    def merge_long(self, symbols: np.ndarray) -> int:
        """One long sequence: a heap of pairs, best rank first, then leftmost."""
        import heapq
        n = len(symbols)
        sym = symbols.astype(np.int64).tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        r = self._ranks(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
        heap = [(int(r[i]), int(i), sym[i], sym[i + 1]) for i in np.flatnonzero(r != _NONE)]
        heapq.heapify(heap)
        pair, base, dead = self.pair, int(self.base), bytearray(n)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if dead[i] or sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], dead[j] = k, 1
            n_ = nxt[i] = nxt[j]
            if n_ < n:
                prv[n_] = i
                k2 = pair.get(k * base + sym[n_])
                if k2 is not None:
                    heapq.heappush(heap, (k2, i, k, sym[n_]))
            p = prv[i]
            if p >= 0:
                k2 = pair.get(sym[p] * base + k)
                if k2 is not None:
                    heapq.heappush(heap, (k2, p, sym[p], k))
        return n - sum(dead)

    def count_pieces(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        if not words:
            return np.empty(0, np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        start = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=start[1:])
        top = int(code.max()) + 1 if len(code) else 1
        table = np.full(top, self.n_symbols, np.int64)
        known = np.array([ord(c) for c in self.number], np.int64)
        own = np.array(list(self.number.values()), np.int64)
        table[known[known < top]] = own[known < top]
        sym = table[code]
        # a character that is no piece of its own stands as its bytes unless merged
        n = np.diff(start)
        size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        extra = np.where(sym >= self.n_symbols, size - 1, 0)
        sums = np.zeros(len(code) + 1, np.int64)
        np.cumsum(extra, out=sums[1:])
        out = sums[start[1:]] - sums[start[:-1]]
        short = n <= LONG
        if short.all():
            return out + self.merge(sym, start)
        pick = np.repeat(short, n)
        s2 = np.zeros(int(short.sum()) + 1, np.int64)
        np.cumsum(n[short], out=s2[1:])
        out[short] += self.merge(sym[pick], s2)
        for i in np.flatnonzero(~short):
            out[i] += self.merge_long(sym[start[i]:start[i + 1]])
        return out

    def pretokens(self, text: str) -> list[str]:
        """Parts of the marked text that no piece spans."""
        s = "▁" + text.replace(" ", "▁")
        if not self.marks_lead:
            return [s]
        if "▁▁" in s:
            if self.newline_apart:
                return [p for x in s.replace("\n", "\n\0\n").split("\n")
                        for p in (_RUN.findall(x) if x != "\0" else ["\n"])] \
                    if "\0" not in s else _RUN.findall(s)
            return _RUN.findall(s)
        if self.newline_apart and " " not in s:
            s = s.replace("\n", " \n ")
        return s.replace("▁", " ▁").split(" ")

    def _stem(self, word: str) -> tuple[str, str]:
        k = len(word)
        while k and not word[k - 1].isalpha() and word[k - 1] != "▁":
            k -= 1
        return (word[:k], word[k:]) if k and word[k - 1].isalpha() else (word, "")

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text (an empty text: 0)."""
        cache = self.cache
        if len(cache) > _CACHE_MAX:
            cache.clear()
            cache[""] = 0
        split = [self.pretokens(t) if t else [] for t in texts]
        new = set()
        for words in split:
            new.update(words)
        new -= cache.keys()
        if new:
            ends = [w for w in new if not w[-1].isalpha()] if self.punct_apart else []
            parts = {w: self._stem(w) for w in ends}
            stems = new.difference(ends)
            for a, b in parts.values():
                stems.add(a)
                stems.add(b)
            stems = list(stems - cache.keys())
            for i in range(0, len(stems), 100_000):
                some = stems[i:i + 100_000]
                cache.update(zip(some, self.count_pieces(some).tolist()))
            for w, (a, b) in parts.items():
                cache[w] = cache[a] + cache[b]
        get = cache.__getitem__
        return [sum(map(get, words)) for words in split]


_mergers: dict[str, RankMerger] = {}


def _merger(model_file: str) -> RankMerger:
    if model_file not in _mergers:
        _mergers[model_file] = RankMerger(model_file)
    return _mergers[model_file]


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def counter(model_file: str | None, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _merger(model_file or vocabulary("piece_bpe_32k.model"))
        for batch in batches:
            _, offs = utf8(batch.column("text"))
            n, i, count = batch.num_rows, 0, []
            while i < n:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + (4 << 20), "right")) - 1)
                texts = batch.column("text").slice(i, j - i).to_pylist()
                count += m.counts([t or "" for t in texts])
                i = j
            size = np.diff(offs)
            tokens = np.array(count, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, in one pass without a shuffle.

    ``model_file`` is a sentencepiece BPE model as seen by the executors (default:
    the installed 32k model). A null text is empty: 0 bytes, 0 tokens. Repeated
    rows and null ids stay as they are; an empty table gives no rows; other
    columns are not read. A worker keeps the counts of up to ``_CACHE_MAX``
    pre-tokens and starts afresh beyond that.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        counter(model_file, limit),
        f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
