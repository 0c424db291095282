"""Operator 8: benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words. Of the ``KGRAM``-word hashes inside a
window the smallest is its fingerprint, so every shared window has the same
fingerprint in a document and in the benchmark. The fingerprints are joined, and
each hit is extended by comparing the whole window; overlapping hit windows grow
into spans. A benchmark item shorter than a window is one window of its own
length, and its fingerprint is the hash of all its words (winnowing with a
window of one).

The benchmark is measured first. While it has at most ``BLOCK_WINDOWS`` windows,
its fingerprints are one broadcast and the documents are read once; a larger one
is taken in blocks of that size, one pass over the documents each, and the spans
are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import ALNUM, mix64, returning, slices, unused, utf8, word_hashes
from airlens.session import ensure_checkpoint_dir

WINDOW = 10
KGRAM = 5
BLOCK_WINDOWS = 1 << 20
SLICE = 2 << 20           # bytes of text looked through at a time

_STEP = mix64(np.arange(101, 101 + 64, dtype=np.uint64))


def grams(h: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``k`` words from each place on (from the places ``at``)."""
    if at is None:
        n = max(0, len(h) - k + 1)
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out += h[j:j + n] * _STEP[j]
    else:
        out = np.full(len(at), k, np.uint64)
        for j in range(k):
            out += h[at + j] * _STEP[j]
    return mix64(out)


def winnow(h: np.ndarray, window: int = WINDOW, k: int = KGRAM) -> np.ndarray:
    """Fingerprint of the window from each place on: its smallest k-gram hash."""
    g = grams(h, k)
    n = max(0, len(h) - window + 1)
    out = g[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(out, g[j:j + n], out=out)
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, at = word_hashes(*utf8(batch.column("text")), ALNUM)
        item, sizes, prints, windows = [], [], [], []
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            w = h[a:b]
            size = min(WINDOW, b - a)
            if size:
                full = grams(w, size)
                item.append(np.full(len(full), k))
                sizes.append(np.full(len(full), size))
                windows.append(full)
                prints.append(winnow(w)[:len(full)] if size == WINDOW else full)
        if item:
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(np.concatenate(item))), pa.array(np.concatenate(sizes)),
                 *(pa.array(np.concatenate(x).view(np.int64)) for x in (prints, windows))],
                names=["item_id", "size", "print", "win"])


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item_id (as a string), length, fingerprint and hash of every window of each item, each once."""
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_items, "item_id string, size long, print long, win long").distinct()


class Table:
    """One block of windows: per window length the fingerprints, windows and their items."""

    def __init__(self, rows):
        self.by_length: dict[int, tuple] = {}
        codes, self.names = rows["item_id"].factorize()
        for size in sorted(rows["size"].unique().tolist()):
            own = (rows["size"] == size).to_numpy()
            prints = np.unique(rows["print"].to_numpy(np.int64)[own].view(np.uint64))
            win, item = rows["win"].to_numpy(np.int64)[own].view(np.uint64), codes[own]
            order = np.lexsort((item, win))
            maybe = np.zeros(1 << 20, bool)
            maybe[prints >> np.uint64(44)] = True
            self.by_length[size] = (maybe, prints, win[order], item[order])

    def hits(self, h: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per window length: hit places (within ``h``), the length, and where their items lie in the last array."""
        out = []
        end = np.repeat(at[1:], np.diff(at))
        for size, (maybe, prints, win, item) in self.by_length.items():
            f = winnow(h) if size == WINDOW else grams(h, size)
            s = np.flatnonzero(maybe[f >> np.uint64(44)])
            s = s[s + size <= end[s]]
            k = np.minimum(np.searchsorted(prints, f[s]), len(prints) - 1)
            s = s[prints[k] == f[s]]                     # fingerprints joined
            if not len(s):
                continue
            w = grams(h, size, s)                        # extended to the whole window
            lo, hi = np.searchsorted(win, w, "left"), np.searchsorted(win, w, "right")
            hit = hi > lo
            out.append((s[hit], size, lo[hit], hi[hit], item))
        return out


def _items_of(docs, lo, hi, item):
    """(doc, item) pairs, each once; a window that a document holds often is looked up once."""
    docs, lo, hi = np.unique(np.stack([docs, lo, hi]), axis=1)
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.unique(np.stack([np.repeat(docs, n), item[at]]), axis=1).T.tolist()


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _finder(table):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            for part in returning(slices(batch, most=SLICE)):
                h, at = word_hashes(*utf8(part.column("text")), ALNUM)
                n = part.num_rows
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for places, size, lo, hi, item in t.hits(h, at):
                    docs = np.searchsorted(at, places, "right") - 1
                    for d, i in _items_of(docs, lo, hi, item):
                        items.setdefault(d, set()).add(t.names[i])
                    for d, p in zip(docs.tolist(), (places - at[docs]).tolist()):
                        s = spans.setdefault(d, [])
                        if s and s[-1]["start"] <= p <= s[-1]["end"]:
                            s[-1]["end"] = max(s[-1]["end"], p + size)
                        else:
                            s.append({"start": p, "end": p + size})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(np.diff(at)),
                     pa.array([spans.get(i, []) for i in range(n)], _SPAN),
                     pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string()))],
                    names=["doc_id", "th", "n_words", "spans", "items"])
    return find


def find_spans(docs: DataFrame, bench: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, th, n_words, spans, items): th is a hash of the text; spans count words."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    ensure_checkpoint_dir(spark)
    windows = benchmark_windows(bench).checkpoint()
    total = windows.count()
    blocks = max(1, -(-total // block_windows))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    found = []
    for b in range(blocks):
        # about block_windows windows: what is collected and broadcast has that bound
        own = windows if blocks == 1 else windows.filter(
            F.pmod(F.xxhash64("item_id", "win"), F.lit(blocks)) == b)
        table = spark.sparkContext.broadcast(Table(own.toPandas()))
        found.append(rows.mapInArrow(_finder(table), f"doc_id {kind}, th long, n_words long, "
                                     "spans array<struct<start:int,end:int>>, items array<string>"))
    if blocks == 1:
        return found[0]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    # rows alike in doc_id and text find the same, so a set holds one entry a block
    return (out.groupBy("doc_id", "th", "n_words")
            .agg((F.count(F.lit(1)) / blocks).cast("int").alias("same"),
                 F.flatten(F.collect_set("spans")).alias("spans"),
                 F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
            .withColumn("same", F.explode(F.sequence(F.lit(1), F.col("same")))).drop("same"))


_COVERED = """aggregate(array_sort(spans), named_struct('n', 0L, 'e', 0),
  (a, x) -> named_struct('n', a.n + greatest(0, x.end - greatest(x.start, a.e)),
                         'e', greatest(a.e, x.end)), a -> a.n)"""


def decontaminate(docs: DataFrame, bench: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: words, words hit, items with a window in it.

    A null or empty text has no words and no hit, a null or empty item no window;
    a null item_id counts as an empty string, repeated item_ids as one item.
    Repeated documents each get a row. An empty documents table gives no rows, an
    empty benchmark no hits. Other columns are not read; texts are read whole.
    """
    f = find_spans(docs, bench, block_windows)
    items = F.array_sort("items")
    return f.select("doc_id", "n_words", F.expr(_COVERED).alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                    (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; other columns are kept and may have any names."""
    c_id, c_text = unused(docs, "hit_id", "hit_text")
    hit = (find_spans(docs, bench).filter(F.size("spans") > 0)
           .select(F.col("doc_id").alias(c_id), F.col("th").alias(c_text)).distinct())
    return docs.join(hit.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(c_id)) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(c_text)), "left_anti")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with b as (select cast(item_id as varchar) as item_id, w, len(w) as n, least(len(w), {WINDOW}) as l
           from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
bw as (select distinct item_id, l, array_to_string(list_slice(w, s, s + l - 1), ' ') as g
       from (select *, unnest(range(1, n - l + 2)) as s from b)),
d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
dw as (select rid, l, s, array_to_string(list_slice(w, s, s + l - 1), ' ') as g
       from (select rid, w, l, unnest(range(1, len(w) - l + 2)) as s
             from d cross join (select distinct l from b))),
h as (select rid, s, l, item_id from dw join bw using (l, g)),
c as (select rid, count(distinct p) as n_hit
      from (select rid, unnest(range(s, s + l)) as p from h) group by rid),
i as (select rid, count(distinct item_id) as n_items,
             array_to_string(list_sort(list(distinct item_id)), ',') as items from h group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (rid) left join i using (rid)"""
